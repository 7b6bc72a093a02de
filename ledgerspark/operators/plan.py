"""Plan records: which cell an answer reads, as columns. Nothing is ever evaluated as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import contains_any, strip
from .lookup import TABLE

#: Labels that a metric must equal to be answered by its code alone, or hold one of STANDARD_WORDS.
STANDARD_LABELS = tuple(label.lower() for entries in C.SECTIONS.values() for label, _ in entries)


def is_standard(metrics: Column) -> Column:
    """Whether one of the metrics is a standard one."""
    low = F.transform(metrics, lambda m: F.lower(strip(m)))
    return F.exists(low, lambda m: m.isin(*STANDARD_LABELS) | contains_any(m, C.STANDARD_WORDS))


def code_plans(intents: DataFrame, ranked: DataFrame, cells: DataFrame, roles: DataFrame) -> DataFrame:
    """(id, variable, report_id, table_index, row, code, col, factor): the cell that answers a standard metric by code.

    intents: (id, formula, metrics, codes, scaling_factor, is_percent); ranked: (id, rank, report_id,
    table_index). By table in rank order, then by code: of the rows whose code column is the code the
    first one counts, if its value column isn't blank. Questions with a formula, without codes or
    without a standard metric have no such plan.
    """
    asked = intents.where(F.col("formula").isNull() & is_standard(F.col("metrics")))
    factor = F.col("scaling_factor") * F.when(F.col("is_percent"), 100.0).otherwise(1.0)
    codes = asked.select("id", F.posexplode("codes").alias("code_pos", "code"), factor.alias("factor"))
    where = roles.where("code_col is not null").select(*TABLE, "code_col", "value_col")
    wanted = codes.join(ranked.select("id", "rank", *TABLE), "id").join(where, TABLE)
    named = cells.select(*TABLE, "row", F.col("col").alias("code_col"), strip("text").alias("code"))
    first = wanted.join(named, [*TABLE, "code_col", "code"]).groupBy(*wanted.columns).agg(F.min("row").alias("row"))
    values = cells.select(*TABLE, "row", F.col("col").alias("value_col"), strip("text").alias("value_text"))
    full = first.join(values, [*TABLE, "row", "value_col"]).where(~F.lower("value_text").isin("", "nan"))
    best = full.withColumn("k_", F.row_number().over(Window.partitionBy("id").orderBy("rank", "code_pos"))).where("k_ = 1")
    return best.select("id", F.concat(F.lit("df"), F.col("rank").cast("string")).alias("variable"), *TABLE, "row", "code", F.col("value_col").alias("col"), "factor")


def fallback_plans(intents: DataFrame, ranked: DataFrame, roles: DataFrame) -> DataFrame:
    """(id, report_id, table_index, code, keyword, match_col, col, factor): what is read where nothing better is known.

    On the best table: the first code in its code column, or without codes or such a column the first
    three words of the first metric (marks aside) in its item column.
    """
    first = ranked.where("rank = 1").select("id", *TABLE).join(roles, TABLE)
    plain = F.regexp_replace(F.coalesce(F.get("metrics", F.lit(0)), F.lit("")), r"""[()\[\]{}?!.,:'"]""", "")
    words = F.filter(F.split(strip(plain), r"(?U)\s+"), lambda w: w != "")
    coded = (F.size("codes") > 0) & F.col("code_col").isNotNull()
    return intents.join(first, "id").select(
        "id",
        *TABLE,
        F.when(coded, F.get("codes", F.lit(0))).alias("code"),
        F.when(~coded, F.array_join(F.slice(words, 1, 3), " ")).alias("keyword"),
        F.when(coded, F.col("code_col")).otherwise(F.col("item_col")).alias("match_col"),
        F.col("value_col").alias("col"),
        (F.col("scaling_factor") * F.when(F.col("is_percent"), 100.0).otherwise(1.0)).alias("factor"),
    )


def run_fallbacks(plans: DataFrame, cells: DataFrame) -> DataFrame:
    """fallback_plans() with value: the first number of the rows that the plan's cell names, times the factor; 0 without one."""
    match = cells.select(*TABLE, "row", F.col("col").alias("match_col"), F.col("text").alias("match_text"))
    hit = F.when(F.col("code").isNotNull(), strip("match_text") == F.col("code")).otherwise(F.contains(F.lower("match_text"), F.lower("keyword")))
    rows = plans.join(match, [*TABLE, "match_col"]).where(hit).select("id", *TABLE, "row", "col")
    found = rows.join(cells.where("num is not null").select(*TABLE, "row", "col", "num"), [*TABLE, "row", "col"]).groupBy("id").agg(F.min_by("num", "row").alias("num"))
    return plans.join(found, "id", "left").withColumn("value", F.coalesce("num", F.lit(0.0)) * F.col("factor")).drop("num")
