"""Nearest neighbours, resampling and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from ledgerspark.llm import nearest, ranked_search, resampling

DOCS = "doc_id long, text string, score int, rank string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words_of(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", lower(text))


def corpus(rng, n=120):
    vocabulary = [f"w{k}" for k in range(60)] + ["Éa", "éa", "x9", "日本", "İ"]
    say = lambda m: " ".join(rng.choice(vocabulary[: rng.choice((5, 20, 65))]) + rng.choice(["", ",", "\n"]) for _ in range(m))
    docs = [(k, say(rng.randint(1, 60))) for k in range(n)]
    docs += [(3, docs[4][1]), docs[5], docs[5], (None, say(25)), (None, None), (900, ""), (901, None), (902, "!?. "), (903, "W1 w1 W1"), (904, say(30_000))]
    return [(i, t, 1, "x") for i, t in docs], say


# ---- ranked search


def brute_search(docs, bench, k=20):
    own = [(i, Counter(words_of(t))) for i, t, *_ in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, total = len(own), sum(x for _, _, x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in bench:
        scored = []
        for i, c, size in own:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in words_of(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,segment,block", [(20, 10**6, 1024), (3, 200, 2), (1, 1, 1024)])
def test_search(spark, k, segment, block):
    rng = random.Random(k)
    docs, say = corpus(rng)
    bench = [(f"i{j}", say(rng.randint(1, 40))) for j in range(5)] + [("none", None), ("empty", ""), ("unknown", "qqq zzz"), ("twice", "w1 w1 w2"), ("twice", "w1 w1 w2")]
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    b = spark.createDataFrame(bench, "item_id string, text string")
    got = ranked_search.search(d, b, k=k, segment_words=segment, block=block).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == brute_search(docs, bench, k)


def test_search_falls_through_and_is_proven_early(spark):
    """An item of a rare word is proven in the first tier; one of common words needs lower ones."""
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(20, 60))) + (" rare" * (k % 3 + 1) if k % 40 == 0 else ""), 0, "") for k in range(400)]
    d, b = spark.createDataFrame(docs, DOCS).coalesce(1), [("rare", "rare"), ("common", "a b c d e f g h")]
    got = ranked_search.search(d, spark.createDataFrame(b, "item_id string, text string"), k=5).collect()
    assert {r["tier"] for r in got if r["item_id"] == "rare"} == {0} and {r["tier"] for r in got if r["item_id"] == "common"} != {0}
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == brute_search(docs, b, 5)


def test_search_of_nothing(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", 0, "")], DOCS)
    item = "item_id long, text string"
    assert ranked_search.search(none, spark.createDataFrame([(1, "a")], item)).collect() == []
    assert ranked_search.search(some, spark.createDataFrame([], item)).collect() == []
    assert ranked_search.search(spark.createDataFrame([(1, None, 0, "")], DOCS), spark.createDataFrame([(1, "a")], item)).collect() == []


# ---- resampling


def features(text):
    w = words_of(text)
    return [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute_resample(docs, bench):
    bucket = lambda f: crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t, *_ in docs for f in features(t))
    t = Counter(bucket(f) for x in bench for f in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, text, *_ in docs:
        own = features(text)
        w = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    can = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    first = 5 * len(can) // 100
    # of rows that are equal, any may have the rank
    return rows, [(r[0], r[3]) for r in can[:first]]


@pytest.mark.parametrize("block", [1 << 21, 50, 7])
def test_resampling(spark, block):
    docs, say = corpus(random.Random(3), 200)
    bench = [say(40) for _ in range(8)] + [None, ""]
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    got = resampling.resample(d, spark.createDataFrame([(1, t) for t in bench], "item_id long, text string"), block=block).collect()
    rows, drawn = brute_resample(docs, bench)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "n_words")) for r in got), key=str) == sorted(rows, key=str)
    assert [(r["doc_id"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


@pytest.mark.parametrize("block", [1 << 21, 3])
def test_resampling_keeps_whole_ids_beside_a_null(spark, block):
    """An id's noise is that of its digits, and the id comes back as it was, also where another id of the block is null."""
    docs = [(2**53 + 1, "a b c d"), (None, "a b c"), (7, ""), (2**62 + 3, None)]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([("a b",)], "text string"), percent=100, least_words=0, block=block).collect()
    rows, _ = brute_resample(docs, ["a b"])
    assert sorted(((r["doc_id"], r["weight"], r["score"]) for r in got), key=str) == sorted(((r[0], r[2], r[3]) for r in rows), key=str)
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4]


def test_stream_of_long_texts():
    """Parts of a text give what the whole gives, wherever it is cut."""
    rng = random.Random(0)
    text = " ".join(rng.choice(["a", "bb", "é", "c" * 40]) for _ in range(500))
    whole = Counter(crc32(f.encode()) % 10_000 for f in features(text))
    old = resampling.word_blocks
    try:
        for size in (1, 2, 5, 50, 1 << 20):
            resampling.word_blocks = lambda t, size=size: old(t, size)
            parts = list(resampling.bucket_stream(text))
            assert Counter(np.concatenate([p for _, p in parts]).tolist()) == whole and sum(n for n, _ in parts) == 500
    finally:
        resampling.word_blocks = old


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resampling.resample(none, bench).collect() == []
    got = resampling.resample(spark.createDataFrame([(1, None, 0, ""), (None, "", 0, "")], DOCS), bench.limit(0)).collect()
    assert sorted((r["n_features"], r["weight"], r["rank"]) for r in got) == [(0, 0, None)] * 2
    with pytest.raises(ValueError):
        resampling.write_streams(none, buckets=1 << 17)


# ---- nearest neighbours

VECTORS = "vec_id long, embedding array<float>, rank int, score string"


def brute_near(rows, queries, k=10):
    out = {}
    for q, v in queries:
        far = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in rows if i != q)
        out[q] = far[:k]
    return out


def test_quantile():
    for p, want in ((0.95, 15.507), (0.9, 13.362), (0.5, 7.344)):
        assert abs(nearest.chi_square_quantile(p, 8) - want) < 1e-3


@pytest.mark.parametrize("cell_rows,segment_rows", [(16_384, 16_384), (200, 90)])
def test_nearest(spark, cell_rows, segment_rows):
    """Clusters, a vector that a third of the rows has, ties, rows that take no part; one cell, then many."""
    rng = np.random.default_rng(5)
    middle = rng.standard_normal((6, 12))
    x = (middle[rng.integers(0, 6, 1500)] + 0.4 * rng.standard_normal((1500, 12))).astype(np.float32)
    x[::3] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(5000, None), (5100, [0.0] * 12), (5200, [1.0, None] + [0.0] * 10), (5300, [float("nan")] * 12), (5400, [float("inf")] + [0.0] * 11), (5500, [1.0]), (5600, []), (None, x[1].tolist()), rows[7], rows[9]]
    df = spark.createDataFrame([(i, v, 1, "") for i, v in [*rows, *odd]], VECTORS).repartition(4)
    got = {}
    found = nearest.search(df, df.where("vec_id % 50 = 0"), cell_rows=cell_rows, segment_rows=segment_rows).orderBy("query_id", "rank").collect()
    for r in found:
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = brute_near(rows, rows[::50])
    assert sorted(got) == sorted(want) and all(len(g) == 10 and g == sorted(g) for g in got.values())
    true = dict(rows)
    assert all(abs(s - math.dist(true[q], true[v])) < 1e-9 for q, g in got.items() for s, v in g)
    hits = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    same = [q for q in want if q % 3 == 0]  # whose own vector a third has: the ten smallest ids at distance 0
    assert all([v for _, v in got[q]] == [v for _, v in want[q]] for q in same)


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (100, [0.0, 1.0], 1, ""), (7, [1.0, 1.0], 1, "")], VECTORS)
    got = nearest.search(few, few.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got] == [(0, 1, 7, 1.0), (0, 2, 100, round(2**0.5, 9)), (100, 1, 7, 1.0), (100, 2, 0, round(2**0.5, 9))]
    assert nearest.search(few.limit(0), few).collect() == [] == nearest.search(few, few.limit(0)).collect()
    assert nearest.search(few.limit(1), few.limit(1)).collect() == []


def test_segments_are_read_one_by_one(spark, monkeypatch):
    """A row group of the tiered index is closed by its size after any segment, not after a hundred of them."""
    import pyarrow.parquet as pq

    from ledgerspark.llm import common

    monkeypatch.setitem(common.LONG_ROWS, "parquet.block.size", "1024")
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 50 + j}" for j in range(200))) for i in range(12)], "doc_id long, text string").coalesce(1)
    files = ranked_search.build_index(docs, 12, 2400, segment_words=200).inputFiles()
    sizes = [m.row_group(g).num_rows for m in (pq.ParquetFile(f.removeprefix("file://")).metadata for f in files) for g in range(m.num_row_groups)]
    assert sum(sizes) == 12 and max(sizes) <= 3
