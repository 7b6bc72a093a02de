"""Questions to intents and answers."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import evaluate, extract, intent, lookup, rank
from ledgerspark.plans.agent import answer_questions
from ledgerspark.streaming.ingest import follow_reports

ALIASES = [("VJC", "vietjet"), ("VJC", "VJC"), ("FTS", "chứng khoán fpt"), ("FTS", "FTS"), ("FPT", "fpt"), ("FPT", "FPT"), ("SAM", "sam holdings"), ("SAM", "SAM")]
QUESTIONS = [
    (1, "Lãi tiền gửi của công ty mẹ VJC năm 2018 là bao nhiêu triệu đồng?"),
    (4, "Lợi nhuận sau thuế của Chứng khoán FPT năm 2023 (tỷ đồng)"),
    (9, "Chi phí khác của SAM Holdings 2020-2023 theo triệu đồng"),
    (10, "Xin chào"),
]


def test_intents(spark):
    q = spark.createDataFrame(QUESTIONS, "id long, question string")
    got = {r["id"]: r for r in intent.understand(q, spark.createDataFrame(ALIASES, "ticker string, alias string")).collect()}
    assert got[1]["tickers"] == ["VJC"] and got[1]["years"] == [2018] and got[1]["report_type"] == "separate" and got[1]["codes"] == ["21"]
    assert got[1]["scaling_factor"] == 1e-6
    assert got[4]["tickers"] == ["FTS"] and got[4]["codes"] == ["60", "200", "30"] and got[4]["scaling_factor"] == 1e-9
    assert got[9]["years"] == [2020, 2021, 2022, 2023] and got[9]["codes"] == ["32"] and got[9]["top_n"] == 5
    assert got[10]["tickers"] == [] and got[10]["codes"] == []


def test_years(spark):
    for text, want in (("2020 đến 2023", [2020, 2021, 2022, 2023]), ("2023–2020", [2020, 2021, 2022, 2023]), ("2005-2020", [2005, 2020]), ("năm 2018", [2018]), ("", [])):
        assert spark.range(1).select(intent.years_of(F.lit(text))).first()[0] == want


def _report(company, year, kind, rows):
    table = "<table><tr><td>Chỉ tiêu</td><td>Mã số</td><td>31/12/{y}</td><td>Số đầu năm</td></tr>".replace("{y}", str(year)) + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    return (f"{company}_financial_statements_{year}_{kind}", company, year, f"===== PAGE 1 =====\nKẾT QUẢ HOẠT ĐỘNG KINH DOANH\n{table}\n")


def test_answers(spark):
    reports = spark.createDataFrame(
        [
            _report("VJC", 2018, "separate", [("Lãi tiền gửi", "21", "208.253.201.298", "1.000")]),
            _report("VJC", 2018, "consolidated", [("Lãi tiền gửi", "21", "5.000.000", "1.000")]),
            _report("SAM", 2023, "consolidated", [("12. Chi phí khác", "32", "2.949.600.088", "7.000.000")]),
            _report("FTS", 2023, "", [("Biên", "20", "200", "1"), ("Doanh thu", "10", "800", "640")]),
        ],
        "report_id string, ticker string, year int, content string",
    )
    catalog = extract.build_catalog(reports).cache()
    questions = [(1, QUESTIONS[0][1]), (9, "Chi phí khác của SAM Holdings năm 2023, triệu đồng"), (11, "Chi phí khác đầu năm của SAM, triệu đồng"), (12, "Biên lợi nhuận gộp của FTS 2023")]
    got = {r["id"]: r for r in answer_questions(spark.createDataFrame(questions, "id long, question string"), catalog, spark.createDataFrame(ALIASES, "ticker string, alias string"), reports).collect()}
    assert got[1]["answer"] == pytest.approx(208253.201298) and got[1]["relevant_docs"] == ["VJC_financial_statements_2018_separate"]
    assert got[9]["answer"] == pytest.approx(2949.600088)
    assert got[11]["answer"] == pytest.approx(7.0)
    assert got[12]["answer"] == pytest.approx(0.25) and got[12]["tier"] == 1
    assert got[1]["evidence"][0]["variable"] == "df1" and got[1]["relevant_tables"][0].endswith("|3")


def test_scores(spark):
    sets = spark.createDataFrame([(1, ["a"], ["a"]), (2, ["a", "b"], ["a"]), (3, ["a"], ["a", "b"]), (4, [], ["a"]), (5, None, None)], "id int, predicted array<string>, gold array<string>")
    got = [(r["precision"], r["recall"], round(r["f2"], 4)) for r in evaluate.prf2(sets).orderBy("id").collect()]
    assert got == [(1, 1, 1), (0.5, 1, 0.8333), (1, 0.5, 0.5556), (0, 0, 0), (0, 0, 0)]
    near = spark.range(1).select(evaluate.close(F.lit(101.0), F.lit(100.0)), evaluate.close(F.lit(102.0), F.lit(100.0)), evaluate.close(F.lit(None).cast("double"), F.lit(1.0))).first()
    assert tuple(near) == (True, False, False)


def test_text_numbers_and_labels(spark):
    for line, want in (("chi phí 1,234.5 triệu đồng", 1234500000.0), ("1.234.567 và 5 tỷ", 5e9), ("lãi 1.5. Hết", 1.5), ("lỗ –5 tỷ", -5e9), ("7.% 3", 7.0), ("không có", None), ("0 rồi 7%", 7.0)):
        assert spark.range(1).select(lookup.number_in_line(F.lit(line))).first()[0] == want
    rows = spark.createDataFrame([("Lợi nhuận sau thuế", "lợi nhuận sau thuế"), ("Tổng cộng", "tổng nợ"), ("Khác", "doanh thu thuần")], "label string, metric string")
    from ledgerspark.functions.fuzzy import sequence_ratio

    scores = [r[0] for r in rows.select(lookup.label_score(F.col("label"), F.col("metric"), F.lit("tổng nợ là bao nhiêu"), sequence_ratio(F.lower("label"), F.col("metric")))).collect()]
    assert scores[0] == pytest.approx(1.19) and scores[1] >= 0.65 and scores[2] < 0.4


CELLS = "report_id string, table_index int, row int, col int, text string, num double"


def test_cells_by_code_or_keyword(spark):
    grid = [["Chỉ tiêu", "Mã", "Năm nay", "Năm trước"], ["Lãi (lỗ)", "21", "1.5đ", "7"], ["Khác", "22", "-", None], ["21", "x", "9", "8"]]
    rows = [("r", 1, i, j, c, None) for i, line in enumerate(grid) for j, c in enumerate(line)] + [("s", 1, 0, 0, "a", None), ("s", 1, 0, 1, "12", None)]
    cells = spark.createDataFrame(rows, CELLS)
    asked = [("r", 1, "21", None, 9.0), ("r", 1, "22", "lãi", 0.0), ("r", 1, "99", "LÃI (", 1.5), ("r", 1, None, "2", 9.0), ("r", 1, "", "nichts", 0.0), ("s", 1, None, "A", 12.0), ("t", 1, "1", "a", 0.0)]
    got = lookup.get_val(cells, spark.createDataFrame([a[:4] for a in asked], "report_id string, table_index int, code string, keyword string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, asked))
    assert {r["report_id"]: r["value"] for r in lookup.first_parsable(cells, 5.0).collect()} == {"r": 21.0, "s": 12.0}
    assert lookup.first_parsable(cells.where("row = 0 and report_id = 'r'"), 5.0).first()["value"] == 5.0


def test_statements_and_units(spark):
    said = [("Notes", "theo kết quả kinh doanh", "IS"), ("Income Statement", "bảng cân đối kế toán", "BS"), (None, None, "NOTE"), ("Cash Flow Statement", "", "CF")]
    df = spark.createDataFrame(said, "t string, b string, want string")
    assert df.where(rank.statement_type(F.col("t"), F.col("b")) != F.col("want")).count() == 0
    from ledgerspark.functions.numeric import unit_name, unit_scale

    assert tuple(spark.range(1).select(unit_scale(F.lit("bao nhiêu tỉ đồng")), unit_name(F.lit("nghìn tỉ?")), unit_scale(F.lit("12 tỷ"))).first()) == (1e-9, "nghìn tỷ đồng", 1.0)
    assert tuple(spark.range(1).select(rank.scope_nudge(F.lit("công ty mẹ"), F.lit("FTS_2023")), rank.scope_nudge(F.lit("công ty mẹ"), F.lit("x_consolidated"))).first()) == (0.0, -15.0)


def test_aliases_without_words_and_needles(spark):
    q = spark.createDataFrame([(1, "C++ và FPT Telecom"), (2, "++ hay FPTS"), (3, None)], "id int, question string")
    names = spark.createDataFrame([("X", "++"), ("FPT", "fpt"), ("FPT", "FPT Telecom"), ("N", None), ("E", "")], "ticker string, alias string")
    got = {(r["id"], r["alias"], r["start"]) for r in intent.alias_matches(q, names).collect()}
    assert got == {(1, "fpt", 7), (1, "fpt telecom", 7), (2, "++", 0)}
    texts = spark.createDataFrame([(1, "xx one two three yy"), (2, "one two four"), (3, None), (4, "short")], "doc_id int, text string")
    needles = spark.createDataFrame([(1, "ne two thr"), (2, "hor"), (3, "one two zzz four"), (4, None)], "id int, needle string")
    assert {tuple(r) for r in rank.holding(texts, needles, "doc_id").collect()} == {(1, 1), (2, 4)}


def test_retrieval_scores_candidates_only(spark):
    texts = spark.createDataFrame([(1, "rest", "alpha beta"), (2, "rest", "alpha"), (3, "rest", "gamma")], "doc_id int, field string, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], "id int, question string")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (2, 1)], "id int, doc_id int")
    assert sorted(tuple(r) for r in rank.lexical_scores(q, texts, ["doc_id"], pairs=pairs).collect()) == [(1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0)]
    plan = rank.top_k(rank.lexical_scores(q, texts, ["doc_id"]), ["id"], [F.desc("score"), F.col("doc_id")], 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan


def test_token_hits_are_containment(spark):
    texts = spark.createDataFrame([(1, "rest", "Xin abcdef gh"), (2, "rest", "zabc")], "doc_id int, field string, text string")
    tokens = spark.createDataFrame([("abc",), ("cde",), ("zzz",)], "token string")
    assert sorted({(r["doc_id"], r["token"]) for r in rank.token_hits(tokens, texts, ["doc_id"]).collect()}) == [(1, "abc"), (1, "cde"), (2, "abc")]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in" / "financial_statements" / "SAM" / "2023" / "x"
    folder.mkdir(parents=True)
    (folder / "SAM_2023.txt").write_text(_report("SAM", 2023, "x", [("a", "32", "5", "6")])[3], encoding="utf-8")
    run = follow_reports(spark, str(tmp_path / "in"), str(tmp_path / "catalog"), str(tmp_path / "state"))
    assert run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "catalog")).select("ticker", "table_index").first() == ("SAM", 1)


def test_documents_of_reads_texts_only_to_rank(spark, tmp_path):
    """Where all questions name an entity, the catalog's texts are in no plan; a question that names none still gets the best by words."""
    from ledgerspark.plans.agent import documents_of

    rows = [(f"R{k}_{'separate' if k % 2 else 'consolidated'}", 1 + i, "AAA" if k < 2 else "BBB", 2020, f"topic{k}word" if i else "all", ["h"], "Notes") for k in range(8) for i in range(2)]
    spark.createDataFrame(rows, "report_id string, table_index int, ticker string, year int, table_context string, headers array<string>, table_type string").write.parquet(f"{tmp_path}/c")
    catalog = spark.read.parquet(f"{tmp_path}/c")
    named = [(1, "?", ["AAA"], [2020], "separate"), (2, "?", ["AAA", "BBB"], [], "consolidated")]
    ask = lambda rows: spark.createDataFrame(rows, "id long, question string, tickers array<string>, years array<int>, report_type string")
    found = documents_of(ask(named), catalog, 3)
    assert "table_context" not in found._jdf.queryExecution().executedPlan().toString()
    want = {1: ["R1_separate"], 2: ["R0_consolidated", "R2_consolidated", "R4_consolidated", "R6_consolidated"]}
    assert {r["id"]: r["relevant_docs"] for r in found.collect()} == want
    both = {r["id"]: r["relevant_docs"] for r in documents_of(ask([*named, (3, "topic5word", [], [2020], "separate")]), catalog, 3).collect()}
    assert {k: both[k] for k in want} == want and both[3] == ["R5_separate"]
