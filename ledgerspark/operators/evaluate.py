"""Scores of predictions against gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def prf2(sets: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """sets (id, predicted, gold: arrays) with precision, recall and f2; nulls count as empty."""
    none = F.array().cast("array<string>")
    p, g = (F.array_distinct(F.coalesce(F.transform(c, lambda x: x.cast("string")), none)) for c in (predicted, gold))
    both = F.size(F.array_intersect(p, g))
    scored = sets.withColumns({"precision": _share(both, F.size(p)), "recall": _share(both, F.size(g))})
    return scored.withColumn("f2", _share(5 * F.col("precision") * F.col("recall"), 4 * F.col("precision") + F.col("recall")))


def macro(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f2")], F.count("*").alias("n"))


def close(a: Column, b: Column, share: float = 0.01) -> Column:
    """Whether two answers differ by no more than a share of the larger; a missing one never fits."""
    return F.coalesce(F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b)), F.lit(False))


def accuracy(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """Of all gold questions (id, answer), the share whose answer is there and fits."""
    both = gold.select("id", F.col("answer").alias("g")).join(answers.select("id", F.col("answer").alias("a")), "id", "left")
    return both.agg(F.avg(close(F.col("a"), F.col("g")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def mrr(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """ranked (id, key, rank) against gold (id, key): the mean over gold's ids of 1 / rank of the first hit in the first k."""
    hits = ranked.where(F.col("rank") <= k).join(gold, ["id", "key"], "left_semi").groupBy("id").agg((1.0 / F.min("rank")).alias("rr"))
    return gold.select("id").distinct().join(hits, "id", "left").agg(F.avg(F.coalesce("rr", F.lit(0.0))).alias("mrr"), F.count("*").alias("n"))


def first_ranks(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """ranked's best rank by key."""
    return ranked.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).where("r_ = 1").drop("r_")
