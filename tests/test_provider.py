"""Vectors that are stored: which texts a model is asked for."""

from pyspark.sql import functions as F

from ledgerspark.operators import provider

LENGTH = lambda texts: [[float(len(t))] for t in texts]
NOTHING = lambda texts: [None for _ in texts]
NEGATIVE = lambda texts: [[-1.0] for _ in texts]


def run(spark, rows, model, path, name="m"):
    texts = spark.createDataFrame(rows, "id int, text string, short string, vector2 int")
    return {r["id"]: r["vector"] and r["vector"][0] for r in provider.embed_stored(texts, ["id"], model, name, path).collect()}


def rows(*texts):
    return [(k, t, "s", k) for k, t in enumerate(texts)]


def test_only_new_texts_are_asked_for(spark, tmp_path):
    path = str(tmp_path / "vectors")
    long = "x" * 384
    assert run(spark, rows("ab", " ab ", None, "", "  ", long + "y"), LENGTH, path) == {0: 2, 1: 2, 2: None, 3: None, 4: None, 5: 384}
    # known ones come from the table, whatever the model would say now; only the first 384 characters count
    assert run(spark, rows("ab", "new", long + "zz"), NEGATIVE, path) == {0: 2, 1: -1, 2: 384}
    assert run(spark, rows("new", "ab"), NOTHING, path) == {0: -1, 1: 2}
    # another model has a table of its own
    assert run(spark, rows("ab"), NEGATIVE, path, "a/b=c") == {0: -1}
    assert spark.read.parquet(path).groupBy("model", "hash").count().where("count > 1").count() == 0


def test_failures_are_asked_for_again(spark, tmp_path):
    path = str(tmp_path / "vectors")
    assert run(spark, rows("ab"), NOTHING, path) == {0: None}
    assert run(spark, rows("ab"), LENGTH, path) == {0: 2}
    assert run(spark, [], LENGTH, path) == {}


def test_a_text_that_stands_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "vectors")
    run(spark, rows("ab"), LENGTH, path)
    spark.read.parquet(path).select("hash", "vector", F.col("model")).write.mode("append").partitionBy("model").parquet(path)
    assert run(spark, rows("ab", "ab"), NOTHING, path) == {0: 2, 1: 2}
