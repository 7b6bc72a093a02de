"""Formulas given as text, and their correction."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import expressions as e
from ledgerspark.operators import ratios

CELLS = "report_id string, table_index int, row int, col int, text string, num double"


def cell(frame, code, default, column="3"):
    test = f"isin({list(code)!r})" if isinstance(code, tuple) else None
    rows = f"{frame}['1'].astype(str).str.strip()" + (f".{test}" if test else f" == '{code}'")
    return f"float(pd.Series({frame}[{rows}]['{column}'].values).replace(['-', '–', 'N/A', ''], '0').fillna('0').get(0, {default}))"


def n(sheet, code, column="3"):
    return cell({"IS": "income_df", "BS": "balance_df", "CF": "cf_df"}[sheet], code, 0.0, column)


def d(sheet, code, column="3"):
    return cell({"IS": "income_df", "BS": "balance_df", "CF": "cf_df"}[sheet], code, 1.0, column)


TEMPLATES = {
    "ROE": f"{n('IS', ('61', '60'))} / {d('BS', '400')}",
    "ROA": f"{n('IS', '60')} / {d('BS', '270')}",
    "gross_margin": f"{n('IS', '20')} / {d('IS', '10')}",
    "net_margin": f"{n('IS', '60')} / {d('IS', '10')}",
    "debt_to_equity": f"{n('BS', '300')} / {d('BS', '400')}",
    "equity_to_assets": f"{n('BS', '400')} / {d('BS', '270')}",
    "current_ratio": f"{n('BS', '100')} / {d('BS', '310')}",
    "quick_ratio": f"({n('BS', '100')} - {n('BS', '140')}) / {d('BS', '310')}",
    "interest_coverage": f"({n('IS', '50')} + {n('IS', '23')}) / {d('IS', '23')}",
    "cfo_to_short_debt": f"{n('CF', '20')} / {d('BS', '310')}",
    "days_inventory": f"({n('BS', '140')} / {d('IS', '11')}) * 365",
    "accrual_ratio": f"({n('IS', '60')} - ({n('CF', '20')} + {n('CF', '30')})) / {d('BS', '270')}",
    "revenue_growth": f"({n('IS', '10')} - {n('IS', '10', '4')}) / {d('IS', '10', '4')}",
    "cfo_margin": f"({n('CF', '20')} / {d('IS', '10')}) * 100",
    "net_working_capital": f"{n('BS', '100')} - {n('BS', '310')}",
    "asset_turnover": f"{n('IS', '10')} / {d('BS', '270')}",
    "sga_intensity": f"(({n('IS', '25')} + {n('IS', '26')}) / {d('IS', '10')}) * 100",
    "debt_ratio": f"({n('BS', '300')} / {d('BS', '270')}) * 100",
    "earnings_conversion": f"{n('CF', '20')} / {d('IS', '60')}",
}


def table(report, index, rows):
    """Rows of (label, code, note, cur, prev) as cells."""
    return [(report, index, i, c, "" if x is None else str(x), float(x) if c > 2 and x is not None else None) for i, r in enumerate(rows) for c, x in enumerate(r)]


SHEETS = {
    "BS": {"100": 50, "140": 8, "270": 200, "300": 120, "310": 40, "400": 80},
    "IS": {"10": 300, "11": 180, "20": 120, "23": 5, "25": 11, "26": 9, "50": 60, "60": 48, "61": 47},
    "CF": {"20": 33, "30": -21},
}


@pytest.fixture(scope="module")
def cells(spark):
    rows = []
    for i, (sheet, codes) in enumerate(SHEETS.items(), 1):
        rows += table("r", i, [(f"label {c}", c, "", v, v * 2 + 1) for c, v in codes.items()])
    rows += table("r", 9, [("Chi phí khác", "32", "", 2949600088, None), ("zero", "0", "", 0, None), ("blank", "5", "", None, None)])
    return spark.createDataFrame(rows, CELLS).cache()


def frames_of(spark, ids):
    names = {"balance_df": 1, "income_df": 2, "cf_df": 3, "df1": 9}
    return spark.createDataFrame([(i, v, "r", t) for i in ids for v, t in names.items()], "id string, variable string, report_id string, table_index int")


def test_templates_give_the_ratios(spark, cells):
    facts = spark.createDataFrame([("r", s, c, k, float(v), float(v * 2 + 1)) for s, codes in SHEETS.items() for k, (c, v) in enumerate(codes.items())], "report_id string, sheet string, code string, row int, cur double, prev double")
    want = ratios.ratios(facts).first().asDict()
    assert set(TEMPLATES) == {r.name for r in ratios.RATIOS}
    texts = spark.createDataFrame(list(TEMPLATES.items()), "id string, text string")
    got = {r["id"]: r for r in e.evaluate(texts, frames_of(spark, TEMPLATES), cells).collect()}
    percent = {r.name for r in ratios.RATIOS if r.percent}
    for name in TEMPLATES:
        assert got[name]["error"] is None
        assert got[name]["value"] == pytest.approx(want[name] * (100 if name in percent else 1)), name


CASES = {
    "float(df1[df1['1'] == '32']['3'].values[0]) / 1e6": (2949.600088, None),
    "get_val(df1, '32') / 1e9": (2.949600088, None),
    "get_val(df1, keyword='chi phí') * 0 + 2 - -1": (3.0, None),
    "float(df1[df1['0'].str.contains('CHI PHÍ', case=False, na=False)]['3'].values[0]) * (1 + 1)": (5899200176.0, None),
    "safe_get_first(df1[df1['1'] == '77']['3'], 4.5)": (4.5, None),
    "safe_get_first(df1[df1['1'] == '5']['3'], 4.5)": (0.0, None),
    "float(df1[df1['1'] == '77']['3'].values[0])": (None, "no such row"),
    "float(df1[df1['1'] == '5']['3'].values[0])": (None, "blank cell"),
    "float(df7[df7['1'] == '32']['3'].values[0])": (None, "no table df7"),
    "1 / float(df1[df1['1'] == '0']['3'].values[0])": (None, "division by zero"),
    "1 / 0": (None, "division by zero"),
    "3 * (4 - 1)": (9.0, None),
    "float(df1[df2['1'] == '32']['3'].values[0])": (None, "refused"),
    "__import__('os').system('true')": (None, "refused"),
    "open('/etc/passwd')": (None, "refused"),
    "df1.to_csv('x')": (None, "refused"),
    "(lambda: 1)()": (None, "refused"),
    "2 ** 9": (None, "refused"),
    "True": (None, "refused"),
    "'a'": (None, "refused"),
    "1 +": (None, "refused"),
    "": (None, "refused"),
    None: (None, "refused"),
}


def test_forms_and_refusals(spark, cells):
    ids = [str(k) for k in range(len(CASES))]
    got = {r["id"]: r for r in e.evaluate(spark.createDataFrame(list(zip(ids, CASES)), "id string, text string"), frames_of(spark, ids), cells).collect()}
    for i, (text, (value, error)) in zip(ids, CASES.items()):
        assert (got[i]["value"] is None) == (value is None) and (value is None or got[i]["value"] == pytest.approx(value)), text
        assert (got[i]["error"] is None) == (error is None) and (error is None or got[i]["error"].startswith(error)), (text, got[i]["error"])


def test_corrections(spark, cells):
    """A model that mends a text at its attempt: those leave the loop, one is never mended, one needs no help."""
    texts = spark.createDataFrame([(f"q{k}", "1 + 1" if k == 0 else "broken(") for k in range(7)], "id string, text string")
    asked = []

    def mend(failed):
        asked.append({r["id"] for r in failed.collect()})
        number = F.substring("id", 2, 1).cast("int")
        return failed.where(number == F.col("attempt")).select("id", F.concat(F.lit("get_val(df1, '32') / 1e6 + "), number.cast("string")).alias("text"))

    got = {r["id"]: r for r in e.corrected(texts, frames_of(spark, [f"q{k}" for k in range(7)]), cells, mend).collect()}
    assert asked == [{f"q{k}" for k in range(j, 7)} for j in (1, 2, 3, 4)]
    assert [got[f"q{k}"]["attempt"] for k in range(7)] == [0, 1, 2, 3, 4, 4, 4]
    assert [got[f"q{k}"]["value"] for k in range(5)] == pytest.approx([2.0] + [2949.600088 + k for k in (1, 2, 3, 4)])
    assert all(got[f"q{k}"]["value"] is None and got[f"q{k}"]["error"].startswith("refused") for k in (5, 6))


def test_without_model_or_rows(spark, cells):
    none = spark.createDataFrame([], "id string, text string")
    assert e.corrected(none, frames_of(spark, ["a"]), cells, None).collect() == []
    one = e.corrected(spark.createDataFrame([("a", "x")], "id string, text string"), frames_of(spark, ["a"]), cells, None).collect()
    assert [(r["id"], r["value"], r["attempt"]) for r in one] == [("a", None, 0)]


def test_texts_that_are_not_mended_are_not_evaluated_again(spark, cells, monkeypatch):
    """Each attempt evaluates what was mended for it, and cells that no text names aren't read by name."""
    evaluated, own = [], e.evaluate

    def counted(texts, *rest):
        evaluated.append(sorted(r["id"] for r in texts.collect()))
        return own(texts, *rest)

    monkeypatch.setattr(e, "evaluate", counted)
    monkeypatch.setattr(e, "get_val", lambda *_: pytest.fail("no text has get_val"))
    texts = spark.createDataFrame([("a", "1 +"), ("b", "1 / 0"), ("c", "2 + 2"), ("d", "'x'")], "id string, text string")
    mend = lambda failed: failed.where("(id = 'a' and attempt = 1) or (id = 'd' and attempt = 3)").select("id", F.when(F.col("id") == "a", "1 +").otherwise("3").alias("text"))
    got = {r["id"]: r for r in e.corrected(texts, frames_of(spark, list("abcd")), cells, mend).collect()}
    assert evaluated == [["a", "b", "c", "d"], ["a"], [], ["d"], []]
    assert {k: (r["value"], r["attempt"], r["error"]) for k, r in got.items()} == {"a": (None, 4, "refused: not an expression"), "b": (None, 4, "division by zero"), "c": (4.0, 0, None), "d": (3.0, 3, None)}
