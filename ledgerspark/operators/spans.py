"""Spans of a pattern with offsets, and as-of lookups, as plain DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import with_states
from ..functions.text import col


def matches(text: Column | str, pattern: str) -> Column:
    """array<struct(before, hit)>: the matches of a pattern, each with the text since the last one. Empty for null."""
    own = F.coalesce(col(text), F.lit(""))
    gaps, hits = F.split(own, pattern, -1), F.regexp_extract_all(own, F.lit(pattern), F.lit(0))
    return F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("before"), h.alias("hit"))), lambda p: p["hit"].isNotNull())


def breaks(text: Column) -> Column:
    """How many line feeds a text has."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def pattern_spans(text: Column | str, pattern: str) -> Column:
    """array<struct(start, end, line, before, hit)>: 0-based offsets, the 1-based line of the start, the text since the last match, the match. Empty for null.

    Offsets and lines are running sums over the matches, so time grows with the text however many there are.
    """

    def step(s: Column, p: Column) -> Column:
        at = s["at"] + F.length(p["before"]) + F.length(p["hit"])
        return F.struct(at.alias("at"), (s["line"] + breaks(p["before"]) + breaks(p["hit"])).alias("line"))

    def span(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["before"])
        return F.struct(start.alias("start"), (start + F.length(p["hit"])).alias("end"), (s["line"] + breaks(p["before"])).alias("line"), p["before"].alias("before"), p["hit"].alias("hit"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"))
    return with_states(matches(text, pattern), begin, step, "struct<at:int,line:int>", span)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, value: str, default=None) -> DataFrame:
    """left with ``value`` of the last row of right, by keys, whose right_at is not after left's ``at``.

    One shuffle on the keys: both sides are laid together, and the last value is carried forward.
    """
    marks = right.select(*keys, F.col(right_at).alias(at), F.col(value), F.lit(0).alias("side_"))
    rows = left.drop(value).withColumn("side_", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(at, "side_").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(value, ignorenulls=True).over(before)
    found = found if default is None else F.coalesce(found, F.lit(default))
    return both.withColumn(value, found).where("side_ = 1").select(*left.drop(value).columns, value)


def chains(df: DataFrame, keys: Sequence[str], order: Sequence[str], continues: Column, chain: str = "chain") -> DataFrame:
    """df with the number of the chain that a row is part of: a row that doesn't continue the one before begins a chain."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(chain, F.sum(F.when(continues, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
