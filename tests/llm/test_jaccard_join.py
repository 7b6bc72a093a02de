"""The join against a brute-force version, over random families of near copies."""

import random

import pytest

from ledgerspark.llm import jaccard_join as j

ALPHABET = [f"w{i}" for i in range(400)]


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(j._BYTES).split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None:
            low[r] = min(low.get(r, doc_id), doc_id)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def family(rng, words, copies, edits, first):
    base = [rng.choice(ALPHABET) for _ in range(words)]
    out = [(first, " ".join(base))]
    for c in range(1, copies):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(ALPHABET)
        if rng.random() < 0.3:
            own = own[: rng.randint(max(1, len(own) - 2), len(own))]
        out.append((first + c, " ".join(own)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_families(spark, seed):
    rng = random.Random(seed)
    rows, at = [], 0
    for words in (3, 5, 7, 9, 10, 12, 14, 18, 25, 40, 90, 200):
        for _ in range(2):
            rows += family(rng, words, 9, max(1, words // 25), at)
            at += 9
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in j.jaccard_components(df, level_share=2).collect()], key=str)
    assert got == brute(rows)


def test_chain_and_shared_passage(spark):
    """A chain whose ends aren't similar is one component; a passage that all share links nothing."""
    rng = random.Random(9)
    base = [rng.choice(ALPHABET) for _ in range(120)]
    chain = []
    for k in range(12):
        base = list(base)
        base[10 * k] = f"new{k}"
        chain.append((k, " ".join(base)))
    passage = " ".join(f"license{i}" for i in range(60))
    shared = [(100 + k, passage + " " + " ".join(rng.choice(ALPHABET) for _ in range(60))) for k in range(60)]
    rows = chain + shared
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in j.jaccard_components(df, level_share=1).collect()], key=str)
    assert got == brute(rows)
    assert {c for d, _, c in got if d < 100} == {0}


def test_long_list_of_many_components(spark, monkeypatch):
    """Lists of 60 members that are mostly unlike, so that they stay open round after round, dealt to many parts."""
    monkeypatch.setattr(j, "ROUND_PAIRS", 3)
    monkeypatch.setattr(j, "PART", 16)
    rng = random.Random(10)
    passage = " ".join(f"license{i}" for i in range(40))
    rows = [(k, passage + " " + " ".join(rng.choice(ALPHABET) for _ in range(40))) for k in range(50)]
    rows += [(200 + k, rows[5 * k][1] + f" more{k}") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # hardly any document is sampled, so the passage counts as rare and its shingles get lists
    got = sorted([tuple(r) for r in j.jaccard_components(df, level_share=10_000).collect()], key=str)
    assert got == brute(rows) and len({c for *_, c in got}) == 50


def test_edges(spark):
    """Nulls, empty texts, repeated rows and ids, ties, a very long text, clashing columns, an empty table."""
    long_text = " ".join(f"t{i}" for i in range(60_000))
    rows = [(None, "a b c d e f"), (4, "A b c d e f"), (4, "A b c d e f"), (4, "other text here"), (5, None), (6, ""), (7, " \n "), (8, "x"), (9, "X"), (10, long_text), (11, long_text + " end")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, fp int, token string")
    assert sorted([tuple(r) for r in j.jaccard_components(df).collect()], key=str) == brute(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert j.jaccard_components(empty).collect() == []


def test_boundary_follows_cost():
    assert j.boundary(0.0) < j.boundary(5.0) <= j.MOST_SMALL
    assert j.must_share(5, 4) == 4 and j.must_share(10, 10) == 9
