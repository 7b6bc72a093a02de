"""Every query of the engine's own operators gives what its SQL gives."""

import difflib

import pytest

from ledgerspark.plans import queries as q
from ledgerspark.plans import report_queries  # noqa: F401  (adds its queries)
from tests.oracle import DATA, assert_same


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query(spark, name):
    assert_same(spark, q.QUERIES[name], q.SQL[name])


def test_fuzzy_ratio(spark):
    """No SQL: against difflib on the same rows."""
    rows = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_name", "p_brand").orderBy("p_brand", "p_partkey").collect()
    want = {a["p_partkey"]: round(difflib.SequenceMatcher(None, a["p_name"], b["p_name"]).ratio(), 9) for a, b in zip(rows, rows[1:]) if a["p_brand"] == b["p_brand"]}
    assert {r["p_partkey"]: r["ratio"] for r in q.QUERIES["fuzzy_ratio"](spark, str(DATA)).collect()} == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
