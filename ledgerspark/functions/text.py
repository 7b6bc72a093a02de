"""Text expressions: Column to Column, without Python on the executors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASES = {"a": "àáảãạăằắẳẵặâầấẩẫậ", "e": "èéẻẽẹêềếểễệ", "i": "ìíỉĩị", "o": "òóỏõọôồốổỗộơờớởỡợ", "u": "ùúủũụưừứửữự", "y": "ỳýỷỹỵ", "d": "đ"}
ACCENTED = "".join(_BASES.values())
PLAIN = "".join(base * len(accented) for base, accented in _BASES.items())
WORDS = r"[\p{L}\p{N}_]+"
#: White space in Unicode's sense, as (?U)\s has it.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space off both ends, in Unicode's sense."""
    return F.trim(col(c), F.lit(SPACE))


def strip_accents(c: Column | str) -> Column:
    """Lower case without Vietnamese accents."""
    return F.translate(F.lower(col(c)), ACCENTED, PLAIN)


def words(c: Column | str, least: int = 1) -> Column:
    """Lower-case words of at least so many characters, in order, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORDS), F.lit(0)), lambda w: F.length(w) >= least)


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    """Whether c holds any of the words; c is lower-cased by the caller. Never null."""
    return F.coalesce(c.rlike("|".join(re.escape(n) for n in needles)), F.lit(False)) if needles else F.lit(False)


def contains_all(c: Column, needles: Sequence[str]) -> Column:
    out = F.lit(bool(needles))
    for n in needles:
        out = out & F.contains(c, F.lit(n))
    return F.coalesce(out, F.lit(False))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def broken_lines(c: Column | str) -> Column:
    """Lines as any line break parts them: CR, LF or both, form feeds and separators, too."""
    return F.split(col(c), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")


def last_lines(c: Column | str, n: int) -> Column:
    """The last n lines of the stripped text, as an array."""
    own = lines(strip(c))
    return F.slice(own, F.greatest(F.size(own) - n + 1, F.lit(1)), F.lit(n))


def quoted(c: Column) -> Column:
    """c as a literal for a regular expression."""
    return F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")
