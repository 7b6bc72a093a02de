"""The stored index against plain scoring of all texts."""

import random

from pyspark.sql import functions as F

from ledgerspark.operators import lexical, rank


def case(spark, n=300):
    rng = random.Random(4)
    vocabulary = [a + b for a in "abcdefghij" for b in ("an", "ên", "or_x", "7 9", "dia")]
    say = lambda m: " ".join(rng.choice(vocabulary[: rng.choice((4, 20, 50))]) for _ in range(m))
    texts = [(k % 7, k, rng.choice(["context", "rest"]), say(rng.randint(0, 50))) for k in range(n)] + [(1, n, "rest", None), (None, n + 1, "headers", "bor_x Ban")]
    questions = [(k, say(rng.randint(1, 9))) for k in range(12)] + [(90, None), (91, ""), (92, "zzz"), (93, "an dia or_")]
    return spark.createDataFrame(texts, "g int, doc int, field string, text string"), spark.createDataFrame(questions, "id int, question string")


def plain(df, columns):
    return sorted((tuple(None if r[c] is None else round(r[c], 6) for c in columns) for r in df.collect()), key=str)


def test_index_gives_what_all_texts_give(spark, tmp_path, monkeypatch):
    """Whole lists and pruned blocks, one segment and three; a segment written twice counts once."""
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "PIECE", 100)
    texts, questions = case(spark)
    texts = texts.cache()
    lexical.write_segment(texts, f"{tmp_path}/one", ["g", "doc"])
    for k in (0, 1, 2, 1):
        lexical.write_segment(texts.where(F.col("doc") % 3 == k), f"{tmp_path}/three", ["g", "doc"], str(k))
    order = lambda *c: [F.desc("score"), *[F.col(x) for x in c]]
    want = plain(rank.top_k(rank.lexical_scores(questions, texts, ["doc"]), ["id"], order("doc"), 4), ["id", "doc", "score", "rank"])
    docs = plain(rank.rank_documents(questions, texts.select(F.col("g").alias("report_id"), F.col("doc").alias("table_index"), "text"), 3), ["id", "report_id", "score", "rank"])
    bm25 = rank.bm25(questions, texts.select("doc", "text"), "doc").withColumn("score", F.round("score", 6)).where("score > 0")
    bm25 = plain(rank.top_k(bm25, ["id"], order("doc"), 4), ["id", "doc", "score", "rank"])
    assert want and docs and bm25
    for name, prune in (("one", False), ("one", True), ("three", True)):
        index = lexical.open_index(spark, f"{tmp_path}/{name}")
        assert plain(lexical.best_lexical(index, questions, ["doc"], 4, prune=prune).top, ["id", "doc", "score", "rank"]) == want
        assert plain(lexical.best_documents(index, questions, ["g"], 3, prune=prune).top, ["id", "g", "score", "rank"]) == docs
        assert plain(lexical.best_bm25(index, questions, ["doc"], 4, prune=prune).top, ["id", "doc", "score", "rank"]) == bm25


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """A word that all texts have cannot make a result beside a rare one: its blocks aren't read."""
    monkeypatch.setattr(lexical, "BLOCK", 8)
    texts = spark.createDataFrame([(k, "rest", "common " * (1 + k % 3) + ("rare" if k % 50 == 0 else "")) for k in range(500)], "doc int, field string, text string")
    lexical.write_segment(texts, str(tmp_path), ["doc"])
    found = lexical.best_bm25(lexical.open_index(spark, str(tmp_path)), spark.createDataFrame([(1, "common rare")], "id int, question string"), ["doc"], 5, prune=True)
    report = found.report.first()
    assert report["blocks"] >= 64 and report["read"] <= 4
    assert {r["doc"] % 50 for r in found.top.collect()} == {0} and found.top.count() == 5


def test_empty_index(spark, tmp_path):
    texts, questions = case(spark)
    lexical.write_segment(texts.limit(0), str(tmp_path), ["g", "doc"])
    index = lexical.open_index(spark, str(tmp_path))
    for prune in (False, True):
        assert lexical.best_bm25(index, questions, ["doc"], 4, prune=prune).top.collect() == []


def test_tasks_grow_with_the_index(spark, monkeypatch, tmp_path):
    """The memory of a task does not grow with the texts: there are more tasks instead, with the same result."""
    texts = spark.createDataFrame([(i, "rest", f"apple w{i} w{i % 3} pear{i % 7}") for i in range(200)], "doc_id long, field string, text string")
    asked = spark.createDataFrame([(1, "apple w1 w77"), (2, "pear3 w2")], "id long, question string")
    found, parts = [], []
    for k, (size, counts) in enumerate([(16 << 20, 10**6), (100, 10)]):
        monkeypatch.setattr(lexical, "TASK_BYTES", size)
        monkeypatch.setattr(lexical, "TASK_COUNTS", counts)
        lexical.write_segment(texts, f"{tmp_path}/{k}", ["doc_id"])
        index = lexical.open_index(spark, f"{tmp_path}/{k}")
        parts.append(len(index.texts.inputFiles()))
        found.append([sorted(map(tuple, lexical.best_bm25(index, asked, ["doc_id"], 5, prune=p).top.collect())) for p in (False, True)])
    assert found[0] == found[1] and found[0][0] == found[0][1]
    assert parts[0] <= 4 < 20 < parts[1]
