"""The queries of this subpackage against their SQL, and the classifier on its held-out fold."""

import pytest

from ledgerspark.llm import quality
from ledgerspark.llm.registry import QUERIES, SQL
from tests.oracle import DATA, assert_same, connect


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


def test_held_out_accuracy(spark):
    data = str(DATA).replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = quality.op2_quality(spark, data).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
    assert sum(s >= quality.THRESHOLD for s in good) == len(good)


def test_redaction_sql_gives_one_result():
    """A span that is found twice counts once, in whatever order rows come."""
    assert len({tuple(sorted(connect().execute(SQL["secret_redaction"]).fetchall())) for _ in range(5)}) == 1
