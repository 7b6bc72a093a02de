"""Models from outside, as functions that are handed in: replies to intents, texts to vectors. Without them all goes by rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .intent import metrics_of

EMBEDDED_CHARS = 384
REPLY = "struct<target_metrics:array<string>,formula:string>"


def json_of(reply: Column) -> Column:
    """What stands between a reply's first and last brace, without comments; the reply itself without braces."""
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(reply), r"//[^\n]*", "")


def metrics_of_replies(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """questions (id, question) to (id, formula, metrics, by_reply): from the model's reply (id, reply), or by rule where there is none that can be read."""
    told = F.from_json(json_of(F.col("reply")), REPLY, {"mode": "PERMISSIVE"})
    read = replies.dropDuplicates(["id"]).select("id", told.alias("told")).where("told.target_metrics is not null")
    own = metrics_of("question")
    good = F.col("told").isNotNull()
    return questions.join(read, "id", "left").select(
        "id",
        F.when(good, F.col("told.formula")).otherwise(own["formula"]).alias("formula"),
        F.when(good, F.col("told.target_metrics")).otherwise(own["metrics"]).alias("metrics"),
        good.alias("by_reply"),
    )


def _short(text: str) -> Column:
    """What a model is asked for: the first EMBEDDED_CHARS characters, trimmed."""
    return F.trim(F.substring(F.coalesce(text, F.lit("")), 1, EMBEDDED_CHARS))


def _asked(shorts: DataFrame, model: Callable[[list[str]], list[list[float] | None]], batch: int) -> DataFrame:
    """shorts (short_, other columns) with the model's vector."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), batch):
                own = b.iloc[a : a + batch]
                yield own.assign(vector=model(own["short_"].tolist()))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shorts.schema)
    return shorts.mapInPandas(ask, f"{kinds}, vector array<double>")


def embed(texts: DataFrame, key: Sequence[str], model: Callable[[list[str]], list[list[float] | None]], batch: int = 256) -> DataFrame:
    """texts (key, text) with vector: what the model gives for the first EMBEDDED_CHARS characters, each text asked for once; null for empty texts."""
    rows = texts.withColumn("short_", _short("text"))
    found = _asked(rows.select("short_").where("short_ <> ''").distinct(), model, batch)
    return rows.join(found, "short_", "left").select(*texts.columns, "vector")


def embedded(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(hash, vector): what the table at path holds of the model of this name, a row a text; nothing where there is no table yet."""
    schema = "hash string, vector array<double>, model string"
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], schema)
    return stored.where(F.col("model") == name).dropDuplicates(["hash"]).select("hash", "vector")


def embed_stored(texts: DataFrame, key: Sequence[str], model: Callable[[list[str]], list[list[float] | None]], name: str, path: str, batch: int = 256) -> DataFrame:
    """embed() that asks the model only for texts of which the table at path has no vector, and adds these to it.

    The table is addressed by the model's name and the SHA-256 of what the model is asked for. Only
    new texts are written; a run that is lost or done again, or two at once, do no harm. A text for
    which the model gives nothing has a null vector and is asked for again the next time.
    """
    spark = texts.sparkSession
    rows = texts.withColumn("short_", _short("text")).withColumn("hash_", F.when(F.col("short_") != "", F.sha2("short_", 256)))
    wanted = rows.where("hash_ is not null").select("short_", F.col("hash_").alias("hash")).dropDuplicates(["hash"])
    new = _asked(wanted.join(embedded(spark, path, name).select("hash"), "hash", "left_anti").select("short_", "hash"), model, batch)
    new.where("vector is not null").select("hash", "vector", F.lit(name).alias("model")).write.mode("append").partitionBy("model").parquet(path)
    return rows.join(embedded(spark, path, name).withColumnRenamed("hash", "hash_"), "hash_", "left").select(*texts.columns, "vector")
