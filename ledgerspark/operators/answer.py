"""Answers: plan records, evidence, rounding. An answer is made of columns, never of evaluated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plan_text(report_id: Column, table_index: Column, code: Column, scale: Column) -> Column:
    """What an answer reads, as one line for people; a plain number where nothing was read."""
    return F.format_string("lookup(%s, table %d, code %s) * %s", report_id, table_index, F.coalesce(code, F.lit("-")), scale)


def executable(plan: Column, answer: Column) -> Column:
    """The plan, or the answer's value as text where there is no plan."""
    return F.when(plan.isNull() | (F.trim(plan) == "") | plan.startswith("#"), F.concat(F.lit("float("), answer.cast("string"), F.lit(")"))).otherwise(plan)


def prune(ranked: DataFrame, used: DataFrame) -> DataFrame:
    """ranked (id, report_id, table_index, rank, ...) without tables that the answer doesn't use; questions without a used table keep all."""
    # both are read once a join, ranked once in all
    own = used.select(F.col("id").alias("id_"), F.col("report_id").alias("report_"), F.col("table_index").alias("table_")).distinct().withColumn("used_", F.lit(True))
    same = (ranked["id"] == own["id_"]) & ranked["report_id"].eqNullSafe(own["report_"]) & (ranked["table_index"] == own["table_"])
    met = ranked.join(own, same, "left").drop("id_", "report_", "table_").join(used.select("id").distinct().withColumn("asked_", F.lit(True)), "id", "left")
    # ranks are closed up, so that the first table is df1
    kept = met.where("used_ or asked_ is null").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("rank")))
    return kept.drop("used_", "asked_")


def evidence(ranked: DataFrame) -> DataFrame:
    """(id, evidence): struct(variable, csv_path) of the tables in rank order."""
    own = ranked.select("id", F.struct("rank", F.concat(F.lit("df"), F.col("rank").cast("string")).alias("variable"), "csv_path").alias("e"))
    listed = own.groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("es"))
    return listed.select("id", F.transform("es", lambda e: F.struct(e["variable"].alias("variable"), e["csv_path"].alias("csv_path"))).alias("evidence"))


def scale(value: Column, scaling_factor: Column, is_percent: Column) -> Column:
    return F.round(value * scaling_factor * F.when(is_percent, 100.0).otherwise(1.0), 6)


def dual_export(ranked: DataFrame) -> DataFrame:
    """(id, by_line, by_index): one retrieval in both tag formats."""
    tag = lambda c: F.concat_ws("|", "report_id", F.col(c).cast("string"))
    own = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", tag("start_line").alias("l"), tag("table_index").alias("i")))).alias("x"))
    return own.select("id", F.transform("x", lambda e: e["l"]).alias("by_line"), F.transform("x", lambda e: e["i"]).alias("by_index"))
