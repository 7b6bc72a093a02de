"""Names in texts by one automaton, by joins, and by a pattern for each name; nested matches against all pairs."""

import random
import re

from pyspark.sql import functions as F

from ledgerspark.operators import intent

NAMES = [("A", "Vinamilk"), ("B", "vina"), ("C", "milk co"), ("D", "co"), ("D", "C.O"), (None, "milk"), ("E", "++"), ("F", "ả b"), ("G", ""), ("H", None), ("B", "VINA")]


def texts(n=300):
    rng = random.Random(9)
    parts = ["vina", "milk", "Vinamilk", " ", " ", "co", ".", "++", "ả", "b", "\n", "7", "𝔸", "𐐀", "😀"]
    return [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for k in range(n)] + [(-1, None), (-2, ""), (-3, "x vina " * 20_000 + "co")]


def plain(rows):
    out = set()
    for id_, text in rows:
        for ticker, alias in NAMES:
            if text is not None and alias and (m := re.search(r"(?<![^\W_])" + re.escape(alias.lower()) + r"(?![^\W_])", text.lower())):
                out.add((id_, ticker, alias.lower(), m.start(), m.end()))
    return out


def test_aliases(spark, monkeypatch):
    rows = texts()
    questions, names = spark.createDataFrame(rows, "id long, question string"), spark.createDataFrame(NAMES, "ticker string, alias string")
    want = plain(rows)
    assert len(want) > 300
    found = intent.alias_matches(questions, names).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    monkeypatch.setattr(intent, "ALIAS_BYTES", 0)
    assert {tuple(r) for r in intent.alias_matches(questions, names).collect()} == want
    assert intent.alias_matches(questions, names.limit(0)).collect() == []


def test_outermost(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 20), a := rng.randint(0, 12), a + rng.randint(1, 6), k % 3) for k in range(400)]
    rows += [(None, 0, 5, 0), (None, 1, 2, 0)]
    inside = lambda r: any(o[0] == r[0] and o[1] <= r[1] and o[2] >= r[2] and o[2] - o[1] > r[2] - r[1] for o in rows)
    found = intent.outermost(spark.createDataFrame(rows, "id int, start int, stop int, n int"))
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str(r) for r in rows if not inside(r))
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_many_matches_of_one_key(spark):
    many = spark.range(200_000).select(F.lit(1).alias("id"), F.col("id").alias("start"), (F.col("id") + 1 + F.col("id") % 2).alias("stop"))
    assert intent.outermost(many).count() == 100_001
