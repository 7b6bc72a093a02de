"""Spans of regular expressions as code point offsets, in DataFrame functions only.

Spark has no function that gives the offsets of all matches. Here the text is split at the matches
and the matches are extracted; the running sum of both lengths gives the offsets, and the piece
before a match is its context. Patterns are written so that Java's matcher needs linear time and no
recursion: possessive repeats, and a look-behind where a match can only start at a run's start.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import PIECE, between, bound, pieces, states, with_states
from .common import ascii_lower


@dataclass(frozen=True)
class Kind:
    """What to look for: its pattern, a cheap test of the whole text, a test of a match and its context, the value in a match, the score by context.

    The context is that many code points before a match, a line break, and as many after it, A-Z lower-cased.
    """

    name: str
    pattern: str
    hint: str = ""
    keep: Callable[[Column, Column], Column] | None = None
    value: Callable[[Column], Column] | None = None
    score: Callable[[Column], Column] | None = None
    context: int = 0


def spans_of(text: Column, kind: Kind, place: int) -> Column:
    """array<struct(start, place, end, value, score)> of the matches that the kind keeps, in order; empty for a null text.

    Offsets and what stands before a match are running states, so time grows with the text however many matches it has.
    """
    shape = "array<struct<start:int,place:int,end:int,value:string,score:int>>"
    none = F.array().cast(shape)
    gaps, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    n = F.lit(kind.context)
    length = lambda p: F.length(p["g"]) + F.length(p["h"])
    if kind.context:
        pairs = F.filter(bound(pairs, lambda v: _with_after(v, n)), lambda p: p["h"].isNotNull())
        before = lambda s, p: F.right(F.concat(s["tail"], F.right(p["g"], n)), n)
        step = lambda s, p: F.struct((s["at"] + length(p)).alias("at"), F.right(F.concat(before(s, p), F.right(p["h"], n)), n).alias("tail"))
        told = lambda s, p: F.struct((s["at"] + F.length(p["g"])).alias("at"), p["h"].alias("h"), ascii_lower(F.concat(before(s, p), F.lit("\n"), p["a"])).alias("around"))
        found = with_states(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), step, "struct<at:int,tail:string>", told)
    else:
        pairs = F.filter(pairs, lambda p: p["h"].isNotNull())
        found = with_states(pairs, F.lit(0), lambda at, p: at + length(p), "int", lambda at, p: F.struct((at + F.length(p["g"])).alias("at"), p["h"].alias("h"), F.lit("").alias("around")))

    def span(x: Column) -> Column:
        value = kind.value(x["h"]) if kind.value else x["h"]
        score = kind.score(x["around"]) if kind.score else F.lit(0)
        return F.struct(x["at"].alias("start"), F.lit(place).alias("place"), (x["at"] + F.length(x["h"])).alias("end"), value.alias("value"), score.alias("score"))

    kept = F.filter(found, lambda x: kind.keep(x["h"], x["around"])) if kind.keep else found
    test = F.contains(text, F.lit(kind.hint)) if kind.hint else text.isNotNull()
    return F.when(test, F.transform(kept, span)).otherwise(none)


def _with_after(pairs: Column, n: Column) -> Column:
    """pairs (gap, match), the last without a match, to array<struct(g, h, a)>, a being the n code points after the match; these are gathered from the end."""
    heads = states(F.reverse(pairs), F.lit(""), lambda head, p: F.left(F.concat(F.left(p["g"], n), F.left(F.coalesce(p["h"], F.lit("")), n), head), n), "string")
    return F.zip_with(pairs, F.reverse(heads), lambda p, a: F.struct(p["g"].alias("g"), p["h"].alias("h"), a.alias("a")))


def rebuilt(text: Column, spans: Column) -> Column:
    """text with each of spans, array<struct(start, end, mark)>, replaced by its mark; of spans that overlap, all are replaced by the first one's.

    The text is cut to pieces first, so what lies between two spans is found without walking the text again.
    """

    def put(parts: Column) -> Column:
        told = lambda upto, s: F.when(s["start"] >= upto, F.concat(between(parts, upto, s["start"]), s["mark"]))
        marked = with_states(F.array_sort(spans), F.lit(0), lambda upto, s: F.greatest(upto, s["end"]), "int", told)
        last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(marked, ""), between(parts, last, F.length(text)))

    return bound(pieces(text), put)


def places_of(text: Column, value: Column) -> Column:
    """array<struct(start, end)>: where a value stands in a text, not overlapping itself."""
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    gaps = F.split(text, quoted, -1)
    own = F.slice(gaps, 1, F.size(gaps) - 1)
    after = lambda at, g: at + F.length(g) + F.length(value)
    return with_states(own, F.lit(0), after, "int", lambda at, g: F.struct((at + F.length(g)).alias("start"), after(at, g).alias("end")))


def having(spans: Column, values: Column) -> Column:
    """array<struct(start, end, value)>: those of spans whose value is one of values. Both are sorted together, not compared in pairs."""
    shape = "array<struct<value:string,side:int,start:int,end:int>>"
    no = F.lit(None).cast("int")
    one = F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(0).alias("side"), no.alias("start"), no.alias("end")))
    two = F.transform(spans, lambda s: F.struct(s["value"].alias("value"), F.lit(1).alias("side"), s["start"].alias("start"), s["end"].alias("end")))
    step = lambda last, x: F.when(x["side"] == 0, x["value"]).otherwise(last)
    told = lambda last, x: F.when((x["side"] == 1) & (x["value"] == last), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    met = with_states(F.array_sort(F.concat(one.cast(shape), two.cast(shape))), F.lit(None).cast("string"), step, "string", told)
    return F.filter(met, lambda x: x.isNotNull())


#: Every value has so many code points at least.
GRAM = 8


def strays(text: Column, spans: Column, values: Column) -> Column:
    """Those of values that may stand in the text elsewhere than at the end of one of spans, array<struct(start, end, value)>, which are all theirs.

    A value that stands elsewhere has its first GRAM code points at a place where no span's value begins,
    or another value is its beginning. Both are told from sets, however many values there are.
    """
    head = lambda v: F.left(v, F.lit(GRAM))

    def grams(parts: Column) -> Column:
        at = lambda p, k: F.concat(p, F.left(F.coalesce(F.get(parts, k + 1), F.lit("")), F.lit(GRAM - 1)))
        own = lambda q, p, k: F.transform(F.sequence(F.lit(0), F.length(p) - 1), lambda i: F.concat_ws(":", (k * PIECE + i).cast("string"), F.substr(q, i + 1, F.lit(GRAM))))
        return F.flatten(F.transform(parts, lambda p, k: bound(at(p, k), lambda q: own(q, p, k))))

    known = F.transform(spans, lambda s: F.concat_ws(":", (s["end"] - F.length(s["value"])).cast("string"), head(s["value"])))
    free = F.transform(F.array_except(bound(pieces(text), grams), known), lambda x: F.right(x, F.lit(GRAM)))
    met = F.array_intersect(free, F.transform(values, head))
    begins = lambda root, v: F.coalesce(F.startswith(v, root), F.lit(False))
    # in order, all that begin with a value follow it
    longer = with_states(F.sort_array(values), F.lit(None).cast("string"), lambda root, v: F.when(begins(root, v), root).otherwise(v), "string", lambda root, v: F.when(begins(root, v), v))
    return bound(met, lambda m: F.array_union(F.filter(values, lambda v: F.array_contains(m, head(v))), F.filter(longer, lambda v: v.isNotNull())))


def all_spans(text: Column, kinds: Sequence[Kind]) -> Column:
    """The spans of all kinds, by start, then kind as listed."""
    return F.array_sort(F.concat(*[spans_of(text, k, i) for i, k in enumerate(kinds)]))


def told(spans: Column, kinds: Sequence[Kind]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"], s["end"])), ",")


def count_of(spans: Column, place: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["place"] == place)).cast("long")


def base_digest(spans: Column, kinds: Sequence[Kind], base: int) -> Column:
    """SHA-256 of what told() says of the first ``base`` kinds."""
    return F.sha2(told(F.filter(spans, lambda s: s["place"] < base), kinds), 256)


def span_sql(kinds: Sequence[tuple[str, str, str]], context: int = 0) -> str:
    """DuckDB SQL of CTEs d (rid, documents' columns) and y (rid, place, kind, hit, ctx, s, e): the matches of (name, pattern, condition on hit and ctx)."""
    parts = [
        f"SELECT rid, {i} AS place, '{name}' AS kind, regexp_extract_all(text, '{p}', 0) AS hits, string_split_regex(text, '{p}') AS gaps FROM d"
        for i, (name, pattern, _) in enumerate(kinds)
        for p in [pattern.replace("'", "''")]
    ]
    tests = " OR ".join(f"(place = {i} AND ({test}))" for i, (_, _, test) in enumerate(kinds))
    return f"""
d AS (SELECT row_number() OVER () AS rid, * REPLACE (coalesce(text, '') AS text) FROM documents),
m AS ({' UNION ALL '.join(parts)}),
x AS (SELECT rid, place, kind, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM m),
z AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid, place ORDER BY i) AS BIGINT) AS e FROM x),
c AS ({_context_sql(context)}),
y AS (SELECT rid, place, kind, hit, ctx, e - length(hit) AS s, e FROM c WHERE {tests})"""


def _context_sql(n: int) -> str:
    if not n:
        return "SELECT *, '' AS ctx FROM z"
    start = "(e - length(hit))"
    around = f"substr(text, greatest({start} - {n}, 0) + 1, least({start}, {n})) || chr(10) || substr(text, e + 1, {n})"
    return f"SELECT z.*, translate({around}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS ctx FROM z JOIN d USING (rid)"
