"""URL filters: glob rules in one multiword Shift-And automaton.

Every rule becomes a row of states; the states of all rules lie side by side in 64-bit words. One
step shifts all words by one bit (with the carry), masks them with what each state accepts for the
byte read, and keeps the states that a star holds. All rules so advance at once on each canonical
URL, which is ``.host/path`` with the host's A-Z lower-cased. A batch of URLs is stepped together,
byte column by byte column.

Globs: ``*`` any run without ``/``, ``**`` any run, ``?`` one byte other than ``/``, ``\\`` takes
the next character literally.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, table

#: Bytes of URL stepped at once.
BLOCK = 1 << 24


@dataclass(frozen=True)
class Rule:
    """A rule fits its host and all subdomains, where the path starts with the rule's."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{escape(self.host)}{escape(self.path)}**"


def escape(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


class GlobAutomaton:
    """Shift-And over all globs; for a URL, tells the first glob (in the given order) that fits."""

    def __init__(self, globs: Sequence[str]):
        parsed = [self._parse(g) for g in globs]
        bits = sum(len(tokens) + 1 for tokens, _ in parsed)
        self.words = max(1, -(-bits // 64))
        step, hold = [[0] * 256 for _ in range(2)]
        start, accept, at = 0, [], 0
        for tokens, stars in parsed:
            start |= 1 << at
            for i, token in enumerate(tokens):
                for c in range(256) if token is None else [token]:
                    if token is not None or c != 0x2F:
                        step[c] |= 1 << (at + i + 1)
            for i, wide in stars.items():
                for c in range(256):
                    if wide or c != 0x2F:
                        hold[c] |= 1 << (at + i)
            at += len(tokens) + 1
            accept.append(at - 1)
        self.start = self._split(start)
        self.step = np.stack([self._split(x) for x in step])
        self.hold = np.stack([self._split(x) for x in hold])
        self.accept = np.array(accept, dtype=np.int64)

    @staticmethod
    def _parse(glob: str) -> tuple[list[int | None], dict[int, bool]]:
        """The bytes (None: any but a slash), and by state whether a star there also takes slashes."""
        tokens: list[int | None] = []
        stars: dict[int, bool] = {}
        i = 0
        while i < len(glob):
            c = glob[i]
            if c == "*":
                wide = glob[i : i + 2] == "**"
                stars[len(tokens)] = stars.get(len(tokens), False) or wide
                i += 1 + wide
                continue
            if c == "?":
                tokens.append(None)
            else:
                if c == "\\" and i + 1 < len(glob):
                    i += 1
                    c = glob[i]
                tokens.extend(c.encode())
            i += 1
        return tokens, stars

    def _split(self, x: int) -> np.ndarray:
        return np.array([(x >> (64 * w)) & (2**64 - 1) for w in range(self.words)], dtype=np.uint64)

    def first(self, urls: Sequence[bytes]) -> np.ndarray:
        """Index of the first glob that fits each URL, else -1."""
        out = np.full(len(urls), -1, dtype=np.int64)
        lengths = np.array([len(u) for u in urls], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            n = max(1, BLOCK // max(1, int(lengths[order[at]])))
            rows = order[at : at + n]
            out[rows] = self._block([urls[i] for i in rows], lengths[rows])
            at += n
        return out

    def _block(self, urls: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """urls: longest first."""
        width = int(lengths[0])
        text = np.zeros((len(urls), width), dtype=np.uint8)
        text[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(urls), dtype=np.uint8)
        columns = np.ascontiguousarray(text.T)
        state = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        live = np.searchsorted(-lengths, -np.arange(width), side="left")
        for k in range(width):
            n = live[k]
            c, d = columns[k, :n], state[:n]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved &= self.step[c]
            d &= self.hold[c]
            d |= moved
        if not len(self.accept):
            return np.full(len(urls), -1, dtype=np.int64)
        ends = (state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64)) & one
        return np.where(ends.any(axis=1), ends.argmax(axis=1), -1)


def url_parts(url):
    """(host, path) columns: the host after the first ``://``, A-Z lower-cased; the path up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(df: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (its name, else null) and verdict; columns of these names are replaced.

    The longest rule that fits decides, of equally long ones the first; without one, ``default``.
    A null URL, and one without ``://``, has an empty host and path and so the default. Rows that
    repeat stay; an empty table gives an empty one; other columns pass through. The automaton runs
    on a batch at a time, in blocks of at most 16 MB of padded URL, so a URL of many MB is a block.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = GlobAutomaton([r.glob for r in ranked])
    names = np.array([r.name for r in ranked] + [None], dtype=object)
    actions = np.array([r.action for r in ranked] + [default], dtype=object)

    @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for canonical in batches:
            hit = automaton.first([u.encode() for u in canonical])
            yield pd.DataFrame({"rule": names[hit], "verdict": actions[hit]})

    rest = df.drop("host", "path", "rule", "verdict", "__u", "__j")
    host, path = url_parts(F.col("__u"))
    parts = rest.withColumn("__u", df[url_col]).withColumns({"host": host, "path": path})
    judged = parts.withColumn("__j", judge(F.concat(F.lit("."), "host", "path")))
    return judged.select(*rest.columns, "host", "path", "__j.rule", "__j.verdict")


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def op1_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


OP1_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
