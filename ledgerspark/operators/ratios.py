"""Financial ratios over statement facts: one conditional pivot for all of them, then column arithmetic.

Facts are (report_id, sheet, code, row, cur, prev), sheet being BS, IS or CF. Of rows with one code the
first counts. A missing numerator is 0, a missing denominator 1; a denominator of 0 gives null. Ratios
are stored unscaled; ``percent`` tells which are read as per cent.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cell = tuple[str, str, str]


def _name(cell: Cell) -> str:
    return "_".join(cell)


def num(sheet: str, code: str, period: str = "cur") -> Column:
    return F.coalesce(F.col(_name((sheet, code, period))), F.lit(0.0))


def den(sheet: str, code: str, period: str = "cur") -> Column:
    return F.coalesce(F.col(_name((sheet, code, period))), F.lit(1.0))


@dataclass(frozen=True)
class Ratio:
    name: str
    build: Callable[[], Column]
    target_codes: tuple[str, ...]
    percent: bool = False


def _over(n: Column, d: Column) -> Column:
    return F.try_divide(n, d)


#: fixed values: what each ratio is made of
RATIOS = (
    Ratio("ROE", lambda: _over(F.coalesce(F.col("IS_60_61_cur"), F.lit(0.0)), den("BS", "400")), ("60", "61", "400", "30")),
    Ratio("ROA", lambda: _over(num("IS", "60"), den("BS", "270")), ("60", "270", "30")),
    Ratio("gross_margin", lambda: _over(num("IS", "20"), den("IS", "10")), ("20", "10")),
    Ratio("net_margin", lambda: _over(num("IS", "60"), den("IS", "10")), ("60", "10", "30")),
    Ratio("debt_to_equity", lambda: _over(num("BS", "300"), den("BS", "400")), ("300", "400", "60")),
    Ratio("equity_to_assets", lambda: _over(num("BS", "400"), den("BS", "270")), ()),
    Ratio("current_ratio", lambda: _over(num("BS", "100"), den("BS", "310")), ("100", "310")),
    Ratio("quick_ratio", lambda: _over(num("BS", "100") - num("BS", "140"), den("BS", "310")), ("100", "140", "310")),
    Ratio("interest_coverage", lambda: _over(num("IS", "50") + num("IS", "23"), den("IS", "23")), ("50", "23", "22")),
    Ratio("cfo_to_short_debt", lambda: _over(num("CF", "20"), den("BS", "310")), ("20", "310")),
    Ratio("days_inventory", lambda: _over(num("BS", "140"), den("IS", "11")) * 365, ("11", "140")),
    Ratio("accrual_ratio", lambda: _over(num("IS", "60") - (num("CF", "20") + num("CF", "30")), den("BS", "270")), ("60", "20", "30", "270")),
    Ratio("revenue_growth", lambda: _over(num("IS", "10") - num("IS", "10", "prev"), den("IS", "10", "prev")), ("10",)),
    Ratio("cfo_margin", lambda: _over(num("CF", "20"), den("IS", "10")), ("20", "10"), True),
    Ratio("net_working_capital", lambda: num("BS", "100") - num("BS", "310"), ("100", "310")),
    Ratio("asset_turnover", lambda: _over(num("IS", "10"), den("BS", "270")), ("10", "270")),
    Ratio("sga_intensity", lambda: _over(num("IS", "25") + num("IS", "26"), den("IS", "10")), ("25", "26", "10"), True),
    Ratio("debt_ratio", lambda: _over(num("BS", "300"), den("BS", "270")), ("300", "270"), True),
    Ratio("earnings_conversion", lambda: _over(num("CF", "20"), den("IS", "60")), ("20", "60", "30")),
)
CODES = {"BS": ("100", "140", "270", "300", "310", "400"), "IS": ("10", "11", "20", "23", "25", "26", "50", "60"), "CF": ("20", "30")}


def pivot_facts(facts: DataFrame, keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """One row a report with a column for each (sheet, code, period) that a ratio uses: partial aggregation, one shuffle."""
    first = lambda value, test: F.min_by(F.when(test, F.col(value)), F.when(test, F.col("row")))
    columns = []
    for sheet, codes in CODES.items():
        for code in codes:
            test = (F.col("sheet") == sheet) & (F.col("code") == code)
            columns.append(first("cur", test).alias(_name((sheet, code, "cur"))))
    columns.append(first("prev", (F.col("sheet") == "IS") & (F.col("code") == "10")).alias("IS_10_prev"))
    columns.append(first("cur", (F.col("sheet") == "IS") & F.col("code").isin("60", "61")).alias("IS_60_61_cur"))
    return facts.groupBy(*keys).agg(*columns)


def ratios(facts: DataFrame, keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """All ratios of every report, a column each."""
    return pivot_facts(facts, keys).select(*keys, *[r.build().alias(r.name) for r in RATIOS])


def tall(wide: DataFrame, keys: Sequence[str] = ("report_id",)) -> DataFrame:
    """(keys, formula, value)."""
    return wide.unpivot(list(keys), [r.name for r in RATIOS], "formula", "value")


def scaled(value: Column, formula: Column, is_percent: Column) -> Column:
    """Times 100 once, if the ratio is read as per cent or the question asks for it."""
    own = formula.isin(*[r.name for r in RATIOS if r.percent])
    return value * F.when(own | is_percent, 100.0).otherwise(1.0)
