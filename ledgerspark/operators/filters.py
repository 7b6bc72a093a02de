"""Candidate generation: questions to the tables that can answer them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col


def hard_filter(intents: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, report_type, catalog's columns) of the tables whose ticker and year a question names.

    What a question doesn't name doesn't filter; one that names neither gets the whole catalog (each
    such question reads all of it, which is what it asks for). Four branches, so that the others are
    equi-joins on their keys.
    """
    i = intents.select("id", "report_type", F.size("tickers").alias("nt"), F.size("years").alias("ny"), "tickers", "years")
    both = i.where("nt > 0 and ny > 0").select("id", "report_type", F.explode("tickers").alias("ticker"), "years").select("id", "report_type", "ticker", F.explode("years").alias("year"))
    by_ticker = i.where("nt > 0 and ny = 0").select("id", "report_type", F.explode("tickers").alias("ticker"))
    by_year = i.where("nt = 0 and ny > 0").select("id", "report_type", F.explode("years").alias("year"))
    none = i.where("nt = 0 and ny = 0").select("id", "report_type")
    columns = ["id", "report_type", *catalog.columns, "keyed"]
    parts = [
        both.join(catalog, ["ticker", "year"]).withColumn("keyed", F.lit(True)),
        by_ticker.join(catalog, "ticker").withColumn("keyed", F.lit(True)),
        by_year.join(catalog, "year").withColumn("keyed", F.lit(True)),
        none.crossJoin(catalog).withColumn("keyed", F.lit(False)),
    ]
    out = parts[0].select(columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(columns))
    return out


def prefer(df: DataFrame, keys: Sequence[str], wanted: Column, opposite: Column) -> DataFrame:
    """Per key: the wanted rows if there is any, else those that aren't opposite.

    Whether there is any is a small aggregate joined back, so a key with very many rows isn't gathered.
    """
    marked = df.withColumns({"wanted_": F.coalesce(wanted, F.lit(False)), "opposite_": F.coalesce(opposite, F.lit(False))})
    any_ = marked.groupBy(*keys).agg(F.max("wanted_").alias("any_"))
    return marked.join(any_, list(keys)).where(F.when(F.col("any_"), F.col("wanted_")).otherwise(~F.col("opposite_"))).drop("wanted_", "opposite_", "any_")


def prefer_scope(candidates: DataFrame, per_entity: bool = False) -> DataFrame:
    """candidates of the scope that their question wants, by the report's name; unkeyed questions keep all.

    The decision is a question's as a whole, or with per_entity each (ticker, year)'s.
    """
    report = F.lower("report_id")
    other = F.when(F.col("report_type") == "separate", "consolidated").otherwise("separate")
    keyed = prefer(candidates.where("keyed"), ["id", "ticker", "year"] if per_entity else ["id"], F.contains(report, F.col("report_type")), F.contains(report, other))
    return keyed.unionByName(candidates.where("not keyed"))


def is_garbage(text: Column | str) -> Column:
    """Whether an exported table's text is no table: under 50 characters, a data line at most, a header without comma, or under 4 % digits."""
    t = col(text)
    own = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return (F.length(t) < 50) | (F.size(own) <= 2) | ~F.contains(F.coalesce(F.get(own, F.lit(0)), F.lit("")), F.lit(",")) | (digits / F.greatest(F.length(t), F.lit(1)) < 0.04)


def valid_codes(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """targets (id, report_id, table_index, code) whose code stands in a cell of their table: a semi-join."""
    here = cells.select("report_id", "table_index", F.trim("text").alias("code"))
    return targets.join(here, ["report_id", "table_index", "code"], "left_semi")


def missing_codes(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """targets (id, report_id, table_index, code) whose code stands in no cell of their table: an anti-join."""
    here = cells.select("report_id", "table_index", F.trim("text").alias("code"))
    return targets.join(here, ["report_id", "table_index", "code"], "left_anti")


def metric_in_labels(metric: Column | str, labels: Column | str) -> Column:
    """2 if a label equals the metric, 1 if one holds it (five characters at least), else 0; case aside."""
    m = F.lower(F.trim(col(metric)))
    low = F.transform(col(labels), lambda x: F.lower(F.trim(x)))
    return F.when(F.array_contains(low, m), 2).when((F.length(m) >= 5) & F.exists(low, lambda x: F.contains(x, m)), 1).otherwise(0)
