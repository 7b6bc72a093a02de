"""Report texts to tables: the inline mini-report, and rules of numbers."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import html, numeric
from ledgerspark.operators import extract, lookup, ratios
from ledgerspark.sources import readers, writers

REPORT = """===== PAGE 1 =====
BẢNG CÂN ĐỐI KẾ TOÁN
<table><tr><th>Chỉ tiêu</th><th>Mã số</th><th>31/12/2023</th><th>01/01/2023</th></tr><tr><td>Tổng tài sản</td><td>270</td><td>1.000.000</td><td>(900.000)</td></tr></table>
===== PAGE 2 =====
<table><tr><td>Nợ phải trả</td><td>300</td><td>600.000</td><td>-</td></tr></table>
===== PAGE 3 =====
Thuyết minh 5
<table><tr><td colspan="2">Tiền</td><td>1,5</td></tr></table>
"""

NUMBERS = {
    "": "", "-": "0", "–": "0", "—": "0", "   ": "0", "%": "0", "1.234.567": "1234567", "1,234,567": "1234567",
    "156.014.812.926,00": "156014812926.00", "1,234.56": "1234.56", "12.500": "12500", "12,500": "12500", "12.5": "12.5", "12,5": "12.5",
    "0,123": "0123", "(1.234)": "-1234", "(1.234,5)%": "-1234.5", "- 5": "-5", "12,5%": "12.5", "abc %": "abc%", "(123": "(123",
    "1 234": "1 234", "Mã số": "Mã số", "−5": "−5", "...": "",
}


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("AAA_2023", "AAA", 2023, REPORT), ("EMPTY", None, None, "no tables"), ("NULL", None, None, None)]
    reports = spark.createDataFrame(rows, "report_id string, ticker string, year int, content string")
    tickers = spark.createDataFrame([("AAA", "Công ty A")], "ticker string, company_name string")
    return extract.build_catalog(reports, tickers).cache()


def test_numbers(spark):
    df = spark.createDataFrame([(k, v) for k, v in NUMBERS.items()], "raw string, want string")
    bad = df.withColumn("got", numeric.normalize_number("raw")).where("not (got <=> want)").collect()
    assert bad == []


def test_mini_report(catalog):
    got = {r["table_index"]: r for r in catalog.collect()}
    assert sorted(got) == [1, 2, 3]
    assert [got[k]["start_line"] for k in (1, 2, 3)] == [3, 5, 8]
    assert [got[k]["page_number"] for k in (1, 2, 3)] == [1, 2, 3]
    assert [got[k]["continued"] for k in (1, 2, 3)] == [False, True, False]
    assert got[2]["parent_table_start_line"] == 3 and got[1]["parent_table_start_line"] is None
    assert got[1]["rows"][1] == ["Tổng tài sản", "270", "1000000", "-900000"]
    assert got[2]["rows"] == [got[1]["rows"][0], ["Nợ phải trả", "300", "600000", "0"]]
    assert got[3]["rows"] == [["Tiền", "", "1.5"]]
    assert got[1]["table_type"] == "Balance Sheet" and got[2]["account_codes_set"] == ["300"] + ["0"] * 0
    assert got[1]["company_name"] == "Công ty A"
    assert got[1]["table_scope_summary"]["first_label"] == "Chỉ tiêu"


def test_cells_and_roles(catalog):
    cells = extract.cells_of(catalog)
    roles = {r["table_index"]: r for r in lookup.column_roles(cells).collect()}
    assert (roles[1]["item_col"], roles[1]["code_col"], roles[1]["value_col"]) == (0, 1, 3)
    assert roles[3]["value_col"] == 1 and roles[3]["code_col"] is None
    assert cells.where("num = -900000").count() == 1


def test_grid_spans():
    assert html.parse_grid('<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>') == [["a", "b"], ["", "c"]]
    assert html.parse_grid("<table></table>") == [] and html.parse_grid(None) == []
    assert html.parse_grid("<table><tr><td>x<br>y &amp; z</td></tr></table><table><tr><td>no</td></tr></table>") == [["x y & z"]]


def test_spans_are_bounded():
    wide = html.parse_grid('<table><tr><td colspan="100000000">a</td></tr></table>')
    assert len(wide[0]) == html.MOST_COLUMNS and html.parse_grid('<table><tr><td rowspan="99999999999" colspan="0">a</td><td>b</td></tr></table>') == [["a", "b"]]


def test_facts_to_ratios(spark):
    bs, isx, cf = {"100": 500, "140": 120, "270": 1000, "300": 600, "310": 250, "400": 400}, {"10": 800, "11": 600, "20": 200, "23": 20, "25": 30, "26": 50, "50": 100, "60": 80, "61": 72}, {"20": 90, "30": -40}
    rows = [("r", s, c, i, float(v), 640.0 if (s, c) == ("IS", "10") else None) for s, d in (("BS", bs), ("IS", isx), ("CF", cf)) for i, (c, v) in enumerate(d.items())]
    got = ratios.ratios(spark.createDataFrame(rows, "report_id string, sheet string, code string, row int, cur double, prev double")).first()
    want = dict(ROE=0.2, ROA=0.08, gross_margin=0.25, net_margin=0.1, debt_to_equity=1.5, equity_to_assets=0.4, current_ratio=2.0, quick_ratio=1.52, interest_coverage=6.0, cfo_to_short_debt=0.36, days_inventory=73.0, accrual_ratio=0.03, revenue_growth=0.25, cfo_margin=0.1125, net_working_capital=250.0, asset_turnover=0.8, sga_intensity=0.1, debt_ratio=0.6, earnings_conversion=1.125)
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: got[k] for k in want}
    assert spark.range(1).select(ratios.scaled(F.lit(0.1), F.lit("cfo_margin"), F.lit(True))).first()[0] == pytest.approx(10.0)


def test_files(spark, catalog, tmp_path):
    folder = tmp_path / "financial_statements" / "AAA" / "2023" / "r"
    folder.mkdir(parents=True)
    (folder / "AAA_2023_extracted.txt").write_bytes(REPORT.encode() + b"\xff")
    got = readers.read_reports(spark, str(tmp_path)).first()
    assert (got["report_id"], got["ticker"], got["year"]) == ("AAA_2023", "AAA", 2023) and got["content"].endswith("�")
    (tmp_path / "codes.csv").write_text("﻿Mã CK,Tên\nAAA, Công ty A \n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_tickers(spark, str(tmp_path / "codes.csv")).collect()] == [("AAA", "Công ty A")]
    (tmp_path / "q.jsonl").write_text('{"id": 2, "question": "b"}\n\n{"id": 1, "question": "a"}\n', encoding="utf-8")
    assert [r["id"] for r in readers.read_questions(spark, str(tmp_path / "q.jsonl"), 1).collect()] == [1]
    writers.write_catalog(catalog, str(tmp_path / "catalog"))
    assert readers.read_catalog(spark, str(tmp_path / "catalog")).where("year = 2023").count() == 3
    exported = writers.export_tables(catalog.where("table_index = 1")).first()["text"]
    (tmp_path / "t.csv").write_text(exported, encoding="utf-8")
    cells = readers.read_table_csv(spark, str(tmp_path / "t.csv")).where("row = 1").orderBy("col").collect()
    assert [c["text"] for c in cells] == ["Tổng tài sản", "270", "1000000", "-900000"]
    (tmp_path / "q.csv").write_text('# t\n0,1\n"a\nb, ""c""",x # y\n\n1,2\n', encoding="utf-8")
    torn = readers.read_table_csv(spark, str(tmp_path / "q.csv")).orderBy("row", "col").collect()
    assert [(c["row"], c["col"], c["text"]) for c in torn] == [(0, 0, 'a\nb, "c"'), (0, 1, "x "), (1, 0, "1"), (1, 1, "2")]
    answers = spark.createDataFrame([(1, [("df1", "AAA_2023_table_1.csv")])], "id long, evidence array<struct<variable:string,csv_path:string>>")
    assert writers.write_package(answers, catalog, str(tmp_path / "out.zip")) == 1


def test_plain_tables_skip_the_parser(monkeypatch):
    """Tables of rows and closed cells alone are read by pattern, and as the parser reads them."""
    from ledgerspark.functions import html

    plain = '<table><tr><th colspan="2">a &amp; b</th><td> c </td></tr>\n<tr><td rowspan="2">1</td><td></td></tr><tr></tr></table>\n'
    tables = [plain, "<table></table>", "<table><tr></tr></table>", "<table><tr><td>x</td></tr><tr><td>1</td><td>2 &lt; 3</td></tr></table>"]
    found = [html.parse_grid(t) for t in tables]
    monkeypatch.setattr(html, "_PLAIN", html.re.compile("(?!)"))
    assert found == [html.parse_grid(t) for t in tables]
    monkeypatch.undo()
    monkeypatch.setattr(html, "_Cells", None)
    assert [html.parse_grid(t) for t in tables] == found


def test_tables_are_found_once(spark):
    """Chains and inherited headers start from stored tables, so the reports' texts are in no later plan."""
    from ledgerspark.operators import extract

    reports = spark.createDataFrame([("R", "T", 2020, "<table><tr><td>a</td></tr></table>")], "report_id string, ticker string, year int, content string")
    plan = extract.build_catalog(reports)._jdf.queryExecution().optimizedPlan().toString()
    assert "html_grid" not in plan and "<table" not in plan

def test_error_log(spark):
    """Tables without a cell, whatever their markup; the reports' texts are worked on once, not once more to ask whether they have tables."""
    texts = {
        "a": "\n\nx\n<table></table>\n<table><tr><td></td></tr></table><TABLE a='1'>\n<tr></tr></table>\n<table><!-- <td>1</td> --></table>",
        "b": '<table><tr><th colspan="2">1</th></tr></table>\n<table>\n<tr>\n</tr><tr><td>1</td></tr></table><table><td>1</table><table><tr><td class="x">1</table><table>1</table>',
        "c": "<table> <tr> <td>",
        "d": None,
    }
    reports = spark.createDataFrame([(k, "T", 2020, t) for k, t in texts.items()], "report_id string, ticker string, year int, content string")
    found = extract.empty_tables(reports)
    got = sorted((r["report_id"], r["table_index"], r["message"]) for r in found.collect())
    assert got == [("a", k, f"table at line {line} has no cells") for k, line in ((1, 4), (3, 5), (4, 7))] + [("b", 5, "table at line 4 has no cells")]
    for df in (found, extract.find_tables(reports)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_catalog_is_written_from_one_reading(spark, tmp_path, monkeypatch):
    """Each row is worked out once; files hold neighbouring tickers, a large one is shared by several, and unknown years and tickers are kept."""
    monkeypatch.setattr(writers, "FILE_ROWS", 4, raising=False)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string", useArrow=False)
    def title(k):
        seen.add(1)
        return f"t{k}"

    rows = [(f"r{k}", k, "A" if k < 20 else f"T{k}" if k % 7 else None, 2020 + k % 2 if k % 5 else None) for k in range(40)]
    stored = spark.createDataFrame(rows, "report_id string, table_index int, ticker string, year int")
    stored.write.parquet(f"{tmp_path}/stored")
    stored = spark.read.parquet(f"{tmp_path}/stored")
    writers.write_catalog(stored.withColumn("title", title("table_index")), f"{tmp_path}/catalog")
    assert seen.value == 40
    found = readers.read_catalog(spark, f"{tmp_path}/catalog").withColumn("file", F.col("_metadata.file_path")).collect()
    assert sorted((r["report_id"], r["table_index"], r["ticker"], r["year"], r["title"]) for r in found) == sorted((*r, f"t{r[1]}") for r in rows)
    files = {}
    for r in found:
        files.setdefault((r["year"], r["file"]), []).append(r["ticker"])
    assert len({file for (year, file), tickers in files.items() if year == 2021 and "A" in tickers}) > 1
    assert all(tickers == sorted(tickers, key=lambda t: (t is not None, t)) for tickers in files.values())
