"""From raw documents to a training mix: quality, near duplicates, benchmark leaks, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
back as the next one's docs. All stages but the last return the columns of documents.

A row is named by its key: all its columns, with the text as its hash and length. Rows of one key
are equal and get equal decisions. Texts are only shuffled where a row may be dropped, which a
bitmap of fixed size tells beforehand, and in the last stage, which sorts them.

Nulls are allowed in any column. An empty documents table passes all stages as an empty table. Other
columns of any name pass all stages, but those that the last one adds replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import decontaminate as leaks
from ledgerspark.llm import jaccard_join, mixing, quality, secret_scan
from ledgerspark.llm.common import delete, fresh, key_filter, made, materialize, scratch, table


def _key(docs: DataFrame) -> Column:
    """Equal for equal rows only; a string, so that every operator takes it as an id."""
    rest = [F.coalesce(docs[c].cast("string"), F.lit("\\N")) for c in docs.columns if c != "text"]
    return F.sha2(F.concat_ws("\x1f", *rest, F.coalesce(F.xxhash64("text").cast("string"), F.lit("")), F.coalesce(F.length("text").cast("string"), F.lit("\\N"))), 256)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key(docs).alias("doc_id"), "text")


def _without(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """docs without the rows whose key has the action drop, and one row of each whose key has not; actions: (key, drop), a row a key."""
    key, maybe, own, drop = (fresh(n, docs.columns) for n in ("key_", "maybe_", "own_", "drop_"))
    actions = actions.select(F.col("key").alias(own), F.col("drop").alias(drop))
    marked = docs.withColumn(key, _key(docs))
    marked = marked.withColumn(maybe, key_filter(actions, own)(F.col(key)))
    free = marked.where(~F.col(maybe)).select(docs.columns)
    met = marked.where(F.col(maybe)).join(actions, F.col(key) == F.col(own), "left")
    other = met.where(F.col(drop).isNull()).select(docs.columns)
    one = met.where(~F.col(drop)).dropDuplicates([key]).select(docs.columns)
    return free.unionByName(other).unionByName(one)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    score = fresh("score_", docs.columns)
    scored = quality.with_score(docs, quality.fitted(spark, sf_dir), name=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the Jaccard join links; texts without words all stay.

    The one with the smallest doc_id stays (a null one only where all are null).
    """
    # an id that sorts as the documents' ids do, then by key
    place = F.coalesce(docs["doc_id"], F.lit(2**63 - 1)).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
    named = docs.select(F.concat(F.lpad(place.cast("string"), 20, "0"), _key(docs)).alias("doc_id"), "text")
    found = jaccard_join.jaccard_components(named).where("n_shingles > 0")
    found = materialize(found.select(F.substring("doc_id", -64, 64).alias("key"), (F.col("doc_id") != F.col("component_id")).alias("drop")), "pipeline-groups")
    actions = found.groupBy("key").agg(F.first("drop").alias("drop"), F.count("*").alias("n")).where("drop or n > 1").drop("n")
    return _without(docs, materialize(actions, "pipeline-copies"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = leaks.decontaminate(_keyed(docs), table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    actions = found.select(F.col("doc_id").alias("key")).distinct().withColumn("drop", F.lit(True))
    return _without(docs, materialize(actions, "pipeline-leaks"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; values that look live and belong to few owners are replaced in their texts."""
    return secret_scan.redact_live(docs)


#: What the last stage adds.
ADDED = ("size", "taken", "passes", "pass", "position")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the documents that the mix takes, with size, taken (in this pass), passes, pass and position, range-sorted by position.

    Columns of docs with these names are replaced.
    """
    kept, key, row = [c for c in docs.columns if c.lower() not in ADDED], fresh("key_", docs.columns), fresh("row_", docs.columns)
    keyed = docs.select(*kept, _key(docs).alias(key))
    mixed = mixing.mix(keyed.select(F.col(key).alias("doc_id"), "source", "text")).where("taken > 0")
    mixed = mixing.by_pass(mixed).select(F.col("doc_id").alias(key), *ADDED)
    # rows of one key are equal: the text is taken once and joined to each of the mix's rows
    texts = keyed.groupBy(key).agg(F.first(F.struct(*kept)).alias(row))
    return texts.join(mixed, key).select(f"{row}.*", *ADDED).orderBy("position", "doc_id")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The classifier isn't a thing of SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back; what a stage has left there goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        known = set(made())
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        own = [path for path in made() if path not in known]
        path = scratch(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        delete(spark, [*own, *before])
        before = [path]
    return docs
