"""Each stage of the pipeline against a brute-force version, on its own small input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from ledgerspark.llm import quality
from tests.llm.test_jaccard_join import brute
from tests.llm.test_operators import brute_hits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    """documents, labels and benchmark below a folder; the rows of documents."""
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(n))
    bench = [(k, say(15)) for k in range(3)]
    rows = []
    for k in range(80):
        text = say(rng.randint(20, 60))
        if k % 9 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if k % 10 == 1:
            text += " " + bench[k % 3][1]
        if k % 10 == 2:
            text += f" token={k:04d}fedcba9876543210aZ"
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
    rows += [(100 + k, rows[k][1] + (" extra" if k % 2 else ""), "en", "s9", 1) for k in (3, 4, 5, 6)]
    rows += [rows[7], rows[7], (200, None, None, None, None), (201, "", "en", "s1", 0), (201, "", "en", "s1", 0), (None, say(30), None, None, None)]
    d = tmp_path_factory.mktemp("case")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k % 9 > 0)) for k in range(80)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, bench


def both(spark, case, stage, docs=None):
    d, rows, _ = case
    out = stage(spark, spark.createDataFrame(docs if docs is not None else rows, SCHEMA), d)
    return out, [tuple(r) for r in out.collect()]


def test_quality_stage(spark, case):
    model = quality.fitted(spark, case[0])
    _, got = both(spark, case, p.keep_good)
    want = [r for r in case[1] if model.score([quality.featurize(r[1], [r[4]])])[0] >= 0.3]
    assert sorted(got, key=str) == sorted(want, key=str) and 0 < len(got) < len(case[1])


def test_near_duplicate_stage(spark, case):
    _, got = both(spark, case, p.keep_one_of_each_group)
    texts = {}
    for d, n, c in brute([(k, r[1]) for k, r in enumerate(case[1])]):
        texts.setdefault(c, []).append((d, n))
    want = []
    for members in texts.values():
        ids = [k for k, _ in members]
        want.append(case[1][min(ids, key=lambda k: (case[1][k][0] is None, case[1][k][0] or 0))])
    assert sorted(got, key=str) == sorted(want, key=str)


def test_leak_stage(spark, case):
    _, got = both(spark, case, p.drop_leaks)
    clean = [k for k, _, hit, _ in brute_hits([(k, r[1]) for k, r in enumerate(case[1])], [(str(i), t) for i, t in case[2]]) if not hit]
    assert sorted(got, key=str) == sorted((case[1][k] for k in clean), key=str) and len(got) < len(case[1])


def test_secret_stage(spark, case):
    _, got = both(spark, case, p.redact_secrets)
    want = []
    for r in case[1]:
        text = r[1]
        if text and "token=" in text:  # each value has one or two owners
            text = text[: text.index("token=")] + "token=[SECRET]" + text[text.index("token=") + 6 + 22 :]
            r = (r[0], text, r[2], r[3], len(text))
        want.append(r)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_mixing_stage(spark, case):
    out, got = both(spark, case, p.mix_sources)
    size = lambda t: len((t or "").split())
    total = sum(size(r[1]) for r in case[1])
    assert abs(sum(r["taken"] for r in out.collect()) - 1.5 * total) <= 8
    assert all(r["taken"] <= 2 * size(r["text"]) and r["size"] == size(r["text"]) for r in out.collect())
    at = [r["position"] for r in out.collect()]
    assert at == sorted(at) and {g[:5] for g in got} <= set(case[1])


def test_clashing_names_and_long_texts(spark, case):
    """Columns named as the stages' own are; a very long text; all stages keep them, but for those that the last one adds."""
    names = ["key", "drop", "live_", "key_", "maybe_", "own_", "row_", "score_", "k_id", "l_id", "size", "position", "taken"]
    long_text = " ".join(f"word{i}" for i in range(60_000)) + " token=0009fedcba9876543210aZ"
    rows = [*case[1][:30], case[1][7], (300, long_text, "en", "s1", 5)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], SCHEMA + "".join(f", {n} int" for n in names))
    for name, stage in p.STAGES:
        out = stage(spark, docs, case[0])
        got = out.collect()
        kept = names if name != "mixing" else [n for n in names if n not in p.ADDED]
        assert got and set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        assert all(r[n] == names.index(n) for r in got for n in kept), name
        texts = [r["text"] for r in got if r["doc_id"] == 300]
        assert name == "quality" or texts and texts[0] == (long_text.replace("0009fedcba9876543210aZ", "[SECRET]") if name == "secrets" else long_text)


def test_empty_and_run(spark, case, tmp_path):
    for _, stage in p.STAGES:
        assert both(spark, case, stage, [])[1] == []
    out = p.run(spark, case[0])
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < out.where("pass = 1").count() < 80
    assert out.where(F.col("text").contains("fedcba9876543210")).count() == 0
