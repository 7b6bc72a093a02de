"""What works on many matches in one text, in time that doesn't grow with their square, and gives what a plain walk gives."""

import random
import re
import time

from pyspark.sql import functions as F

from ledgerspark.functions.arrays import between, last_before, pieces, states
from ledgerspark.operators import extract, spans


def test_states(spark):
    sizes = (0, 1, 7, 8, 9, 16, 17, 64, 65, 999, 1000, 1001)
    df = spark.createDataFrame([(list(range(n)),) for n in sizes] + [(None,)], "xs array<int>")
    got = df.select("xs", states(F.col("xs"), F.lit(0), lambda a, x: a + x, "int").alias("s")).collect()
    assert all(r["s"] == (None if r["xs"] is None else [sum(range(k)) for k in range(len(r["xs"]))]) for r in got) and len(got) == len(sizes) + 1


def test_between(spark):
    text = "aé😀b\n" * 1000
    cuts = [(0, 5), (1023, 1025), (1000, 4000), (4999, 5000), (5000, 5000), (0, 5000), (1024, 2048)]
    df = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a int, b int")
    assert [r["x"] for r in df.select(between(pieces(F.col("t")), F.col("a"), F.col("b")).alias("x")).collect()] == [text[a:b] for a, b in cuts]


def test_last_before(spark):
    df = spark.createDataFrame([([(5, "b"), (3, "a")], [1, 3, 4, 9])], "m array<struct<at:int,value:string>>, a array<int>")
    assert df.select(last_before(F.col("m"), F.col("a"), "int", "string").alias("v")).collect()[0]["v"] == [None, "a", "a", "b"]


def test_many_spans(spark):
    """200,000 matches in one text."""
    text = "".join(f"é{k}\n" if k % 5 == 0 else f"x{k} " for k in range(200_000))
    df = spark.createDataFrame([(text,)], "t string")
    began = time.perf_counter()
    got = df.select(F.explode(spans.pattern_spans("t", "[0-9]+")).alias("s")).select("s.start", "s.end", "s.line", "s.hit").toPandas()
    took = time.perf_counter() - began
    want = [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]
    assert list(zip(got["start"], got["end"], got["hit"])) == want and took < 30
    assert got["line"].tolist() == [1 + (k + 4) // 5 for k in range(200_000)]


def plain_tables(text, context=15):
    """(line, page, context) of each table, looking at the whole text before it."""
    marks = [(i, int(m.group(1))) for i, line in enumerate(text.split("\n"), 1) if (m := re.search(r"=====\s*PAGE\s+(\d+)\s*=====", line))]
    out = []
    for m in re.finditer(r"(?is)<table.*?>.*?</table>", text):
        line = text[: m.start()].count("\n") + 1
        page = [p for at, p in marks if at <= line]
        out.append((line, page[-1] if page else 1, "\n".join(text[: m.start()].strip().split("\n")[-context:])))
    return out


def test_sweep_of_tables(spark):
    rng = random.Random(5)
    say = lambda: rng.choice(["\n", " \n", "a line\n", "two words", "===== PAGE %d =====\n" % rng.randint(1, 99), "<table><tr><td>1</td></tr></table>", "<TABLE a=1>\n\n</TABLE>\n"])
    texts = ["".join(say() for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "<table></table>", "\n\n <table></table><table></table>  \n"]
    df = spark.createDataFrame([(str(k), None, None, t) for k, t in enumerate(texts)], "report_id string, ticker string, year int, content string")
    got = {}
    for r in extract.find_tables(df).orderBy("report_id", "table_index").collect():
        got.setdefault(int(r["report_id"]), []).append((r["start_line"], r["page_number"], r["own_context"]))
    assert got == {k: w for k, t in enumerate(texts) if (w := plain_tables(t or ""))}


def test_many_tables(spark):
    """One report with 5,000 tables takes about five times as long as one with 1,000."""

    def report(n):
        return "".join(f"===== PAGE {k} =====\nNote {k}\n<table><tr><td>row {k}</td><td>{k}</td></tr></table>\n" for k in range(1, n + 1))

    took = {}
    for n in (1000, 5000, 20_000):
        df = spark.createDataFrame([("r", "T", 2020, report(n))], "report_id string, ticker string, year int, content string")
        began = time.perf_counter()
        got = extract.find_tables(df).agg(F.count("*").alias("n"), F.sum("start_line").alias("lines"), F.sum("page_number").alias("pages")).first()
        took[n] = time.perf_counter() - began
        assert tuple(got) == (n, 3 * n * (n + 1) // 2, n * (n + 1) // 2)
    assert took[20_000] < 12 * max(took[5000], 0.5), took


def test_get_val_shuffles_cells_once(spark):
    """Targets are dealt out to be distinct and by table, cells by table; rows and targets are grouped where these lie."""
    from ledgerspark.operators.lookup import get_val

    cells = spark.createDataFrame([("r", 1, 0, 0, "x"), ("r", 1, 0, 1, "60"), ("r", 1, 0, 2, "7"), ("r", 1, 0, 3, "8")], "report_id string, table_index int, row int, col int, text string")
    targets = spark.createDataFrame([("r", 1, "60", None), ("r", 1, "61", "X"), ("r", 1, None, "y"), ("s", 1, "60", "x"), (None, 1, "60", "x")], "report_id string, table_index int, code string, keyword string")
    found = get_val(cells, targets)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3
    assert sorted(((r["report_id"], r["code"], r["keyword"], r["value"]) for r in found.collect()), key=str) == sorted([("r", "60", None, 7.0), ("r", "61", "X", 7.0), ("r", None, "y", 0.0), ("s", "60", "x", 0.0), (None, "60", "x", 0.0)], key=str)


def test_prune_reads_what_is_ranked_once(spark, tmp_path):
    """Its plan scans ranked once, and a table of a report without a name is kept as any other."""
    from ledgerspark.operators.answer import prune

    rows = [(1, "r", 1, 1), (1, None, 2, 2), (1, "r", 3, 3), (2, "r", 5, 1), (2, "r", 7, 2), (3, "r", 1, 1), (3, "r", 2, 4)]
    spark.createDataFrame(rows, "id long, report_id string, table_index long, rank int").write.parquet(f"{tmp_path}/ranked")
    used = spark.createDataFrame([(1, None, 2), (1, "r", 3), (1, "r", 3), (3, "r", 2)], "id long, report_id string, table_index long")
    found = prune(spark.read.parquet(f"{tmp_path}/ranked"), used)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert sorted((r["id"], r["table_index"], r["rank"]) for r in found.collect()) == [(1, 2, 1), (1, 3, 2), (2, 5, 1), (2, 7, 2), (3, 2, 1)]


def test_runs_of_blank_lines_and_many_pages(spark):
    """Contexts look past any number of blank lines; pages are right however many markers there are."""
    rng = random.Random(7)
    say = lambda: rng.choice(["\n" * rng.choice([1, 14, 16, 70, 300]), "a line\n", "　 \n", "===== PAGE %d =====\n" % rng.randint(1, 99), "x <table><tr><td>1</td></tr></table>"])
    texts = ["".join(say() for _ in range(n)) for n in (10, 40, 200, 200)] + [" \n" * 20 + "é\n<table></table>", "\n" * 5000 + "a\n" * 20 + "\n" * 2000 + "<table\n></TABLE>"]
    df = spark.createDataFrame([(str(k), None, None, t) for k, t in enumerate(texts)], "report_id string, ticker string, year int, content string")
    got = {}
    for r in extract.find_tables(df).orderBy("report_id", "table_index").collect():
        got.setdefault(int(r["report_id"]), []).append((r["start_line"], r["page_number"], r["own_context"]))
    assert got == {k: w for k, t in enumerate(texts) if (w := plain_tables(t))}


def test_catalog_is_not_shuffled(spark):
    """What looks at neighbouring tables is worked out where the report lies, and cells are only normalised where they are asked for."""
    df = spark.createDataFrame([("r", "T", 2020, "a\n<table><tr><td>1</td></tr></table>")], "report_id string, ticker string, year int, content string")
    found = extract.build_catalog(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    plan = found.select("report_id", "table_index", "start_line", "table_context")._jdf.queryExecution().executedPlan().toString()
    assert "grid" not in plan.split("ReadSchema:")[-1]
