"""Texts with very many matches: right, and in time that grows with their length."""

import random
import re
import time

from pyspark.sql import functions as F

from ledgerspark.llm import pii, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_redaction(text):
    """All assigned values, wherever they stand, put together where they meet; every value has one owner here."""
    found = [m for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    places = [m.span(1) for m in found]
    for value in {m[1] for m in found}:
        at = text.find(value)
        while at >= 0:
            places.append((at, at + len(value)))
            at = text.find(value, at + len(value))
    out, upto, last = [], 0, 0
    for a, b in sorted(places):
        if a >= upto:
            out += [text[last:a], "[SECRET]"]
        upto = last = max(upto, b)
    return "".join(out) + text[last:]


def test_redaction_of_many_values(spark):
    """More than FEW values in a text: some stand elsewhere too, begin another, or lie inside one."""
    rng = random.Random(2)
    rows = []
    for k in range(30):
        values = ["".join(rng.choice("abZY01_/") for _ in range(rng.randint(8, 12))) for _ in range(rng.choice((2, 16, 17, 60)))]
        values += [v + rng.choice(["zz", "Q", "/abcabcabc"]) for v in values[:3]] + ["é".join(values[:1])]
        said = [f"token={v}" for v in values] + [f"see {v}." for v in rng.sample(values, len(values) // 3)] + [f"ü{v}{v[:5]}" for v in values[:4]] + ["plain words 日本"] * 40
        rng.shuffle(said)
        rows.append((k, " ".join(said), "en", "s", 0))
    got = {r["doc_id"]: r for r in secret_scan.redact_live(spark.createDataFrame(rows, DOCS)).collect()}
    for k, text, *_ in rows:
        want = plain_redaction(text)
        at = next((i for i, (a, b) in enumerate(zip(got[k]["text"], want)) if a != b), 0)
        assert got[k]["text"] == want, (k, text, got[k]["text"][at - 30 : at + 40], want[at - 30 : at + 40])
        assert got[k]["n_chars"] == len(got[k]["text"])


def test_time_of_many_spans(spark):
    """200,000 addresses, then secrets, in one text."""
    n = 200_000
    mails = "".join(f"u{k}@ex.io, " for k in range(n))
    tokens = "".join(f"token={k:08d}abcd; " for k in range(n))
    began = time.perf_counter()
    found = pii.find_pii(spark.createDataFrame([(1, mails)], "doc_id long, text string")).select(F.explode("pii").alias("s")).select("s.start", "s.end").toPandas()
    took_pii = time.perf_counter() - began
    assert list(zip(found["start"], found["end"])) == [m.span() for m in re.finditer(r"u[0-9]+@ex\.io", mails)]
    began = time.perf_counter()
    found = secret_scan.scan(spark.createDataFrame([(1, tokens)], "doc_id long, text string")).select(F.explode("secrets").alias("s")).where("s.place = 0").select("s.start", "s.value").toPandas()
    took_scan = time.perf_counter() - began
    assert len(found) == n and found["value"].tolist() == [f"{k:08d}abcd" for k in range(n)]
    print(took_pii, took_scan)
    assert max(took_pii, took_scan) < 60
