"""What the training-data operators share."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm.common import KeyBits, has_bit, key_filter


@pytest.mark.parametrize("bits", [1 << 16, 1000])
def test_key_bits_hold_every_key_and_hardly_any_other(spark, bits):
    keys = spark.range(0, 300, 3).select(F.col("id").cast("string").alias("k"))
    known = KeyBits(keys.union(keys), "k", bits)
    own = keys.select(known.slot(F.col("k")).alias("slot")).toPandas()["slot"]
    slots = set(own)
    every = spark.range(3000).select(known.slot(F.col("id").cast("string")).alias("slot")).toPandas()["slot"]
    assert has_bit(known.shared.value, own.to_numpy()).all()
    assert has_bit(known.shared.value, every.to_numpy()).tolist() == [s in slots for s in every]


def test_a_filter_of_no_keys_lets_none_pass(spark):
    keys = spark.createDataFrame([], "k string")
    docs = spark.createDataFrame([("a",), (None,), ("",)], "k string")
    assert docs.where(key_filter(keys, "k")(F.col("k"))).count() == 0
