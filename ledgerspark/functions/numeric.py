"""Number expressions: how report cells become numbers, and how answers are scaled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BLANKS, PERCENT_WORDS, UNITS
from .text import col, contains_any, strip

NUMBER = r"^\s*\(?\s*-?\s*[\d.,]+\s*\)?\s*$"

#: Cells that stay as they are: digits alone, and texts without white space or a percent sign at their ends that have a character no number has.
SAME = r"(?Us)\A(?:[0-9]*|(?!\s)[0-9.,()\s%–—-]*+[^0-9.,()\s%–—-](?:.*[^\s%])?)\z"
THOUSANDS = r"\A[0-9]{1,3}(?:\.[0-9]{3})+\z"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c worked out once, however often f uses it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def _count(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def _drop(c: Column, mark: str) -> Column:
    return F.replace(c, F.lit(mark), F.lit(""))


def normalize_number(c: Column | str) -> Column:
    """A cell's text as a plain number, else the text.

    A trailing percent sign goes (the value isn't divided); dashes are 0; parentheses and a leading
    dash mean negative. With dots and commas, the kind that comes first later in the text is the
    decimal mark; several marks of one kind, and one before exactly three digits, separate thousands.
    Null and the empty text stay as they are. Most cells are of a form that one look decides; the others go all the way.
    """
    return let(col(c), normalized)


def normalized(raw: Column) -> Column:
    """normalize_number of what costs nothing to be read again."""
    return (
        F.when(raw.isNull() | raw.rlike(SAME), raw)
        .when(raw == "-", "0")
        .when(raw.rlike(THOUSANDS), _drop(raw, "."))
        .when(raw.rlike(r"\A\([0-9]+\)\z"), F.concat(F.lit("-"), F.substr(raw, F.lit(2), F.length(raw) - 2)))
        .otherwise(let(strip(raw), lambda t: _normalized(raw, t)))
    )


def _normalized(raw: Column, trimmed: Column) -> Column:
    def of_body(body: Column) -> Column:
        percent = trimmed.endswith("%")
        negative = (body.startswith("(") & body.endswith(")")) | body.startswith("-")
        digits = F.when(negative, strip(F.regexp_replace(body, "[()-]", ""))).otherwise(body)
        number = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), let(digits, _separated))
        return (
            F.when(raw.isNull() | (raw == ""), raw)
            .when(body.isin("-", "–", "—", ""), F.lit("0"))
            .when(~body.rlike(NUMBER), F.concat(body, F.when(percent, F.lit("%")).otherwise(F.lit(""))))
            .otherwise(number)
        )

    body = F.when(trimmed.endswith("%"), strip(F.substr(trimmed, F.lit(1), F.length(trimmed) - 1))).otherwise(trimmed)
    return let(body, of_body)


def _separated(digits: Column) -> Column:
    """digits without thousands separators, with a dot for decimals."""
    dots, commas = _count(digits, "."), _count(digits, ",")
    plain = (
        F.when((dots > 0) & (commas > 0) & (F.instr(digits, ".") > F.instr(digits, ",")), _drop(digits, ","))
        .when((dots > 0) & (commas > 0), F.replace(_drop(digits, "."), F.lit(","), F.lit(".")))
        .when(dots > 1, _drop(digits, "."))
        .when(commas > 1, _drop(digits, ","))
        .when((dots == 1) & digits.rlike(r"\.\d{3}$"), _drop(digits, "."))
        .when((commas == 1) & digits.rlike(r",\d{3}$"), _drop(digits, ","))
        .when(commas == 1, F.replace(digits, F.lit(","), F.lit(".")))
        .otherwise(digits)
    )
    return _drop(plain, " ")


def to_number(c: Column | str) -> Column:
    """A double where the text is one after commas go and (x) becomes -x; blank words and other texts are null."""
    t = strip(col(c))
    plain = _drop(F.regexp_replace(t, r"^\((.*)\)$", "-$1"), ",")
    return F.when(~F.lower(t).isin(*BLANKS) & plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))


def unit_scale(question: Column | str) -> Column:
    """The factor from đồng to the unit that a question names; 1 without one."""
    q = F.lower(col(question))
    out = F.lit(1.0)
    for some, _, factor in reversed(UNITS):
        out = F.when(contains_any(q, some), F.lit(factor)).otherwise(out)
    return out


def unit_name(question: Column | str) -> Column:
    q = F.lower(col(question))
    out = F.lit("đồng")
    for some, name, _ in reversed(UNITS):
        out = F.when(contains_any(q, some), F.lit(name)).otherwise(out)
    return out


def is_percent(question: Column | str) -> Column:
    return contains_any(F.lower(col(question)), PERCENT_WORDS)
