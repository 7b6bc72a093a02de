"""Cells by code, label and free text, for all questions and tables at once.

Plans are (id, table_pos, report_id, table_index); cells the tall view of the catalog. A tier of the
cascade only works on the questions that the one before it left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.fuzzy import sequence_ratio, word_coverage
from ..functions.numeric import to_number
from ..functions.text import broken_lines, contains_any, lines, strip

TABLE = ["report_id", "table_index"]


def column_roles(cells: DataFrame) -> DataFrame:
    """(report_id, table_index, width, item_col, code_col, value_col) of each table.

    Headers in the first three rows name the code and item columns; without them they are 1 and 0.
    The value column is 3, or the last. In three columns, column 1 is the code if over half of its
    texts are numbers of up to three digits, else it is the value and there is no code.
    """
    low = F.lower(strip("text"))
    head = F.col("row") < 3
    here = F.struct("row", "col")
    of = cells.groupBy(*TABLE).agg(
        (F.max("col") + 1).alias("width"),
        F.max_by("col", F.when(head & contains_any(low, C.CODE_HEADERS), here)).alias("code_"),
        F.max_by("col", F.when(head & contains_any(low, C.ITEM_HEADERS), here)).alias("item_"),
        F.count_if((F.col("col") == 1) & (low != "")).alias("filled"),
        F.count_if((F.col("col") == 1) & low.rlike(r"^\d{1,3}$")).alias("coded"),
    )
    three = F.col("width") == 3
    mostly = F.col("coded") > 0.5 * F.col("filled")
    return of.select(
        *TABLE,
        "width",
        F.coalesce("item_", F.lit(0)).alias("item_col"),
        F.when(three & ~mostly, F.lit(None).cast("int")).otherwise(F.coalesce("code_", F.least(F.lit(1), F.col("width") - 1))).alias("code_col"),
        F.when(three, F.when(mostly, 2).otherwise(1)).otherwise(F.least(F.lit(3), F.col("width") - 1)).alias("value_col"),
    )


def rows_by_code(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (report_id, table_index, code) with each row whose cell is the code, in the leftmost column that has one."""
    hit = cells.withColumn("code", strip("text")).join(targets.distinct(), [*TABLE, "code"])
    first = F.min("col").over(Window.partitionBy(*TABLE, "code"))
    return hit.withColumn("first_", first).where("col = first_").select(*TABLE, "code", "row", "col")


def value_column(cells: DataFrame, roles: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (id, question, report_id, table_index) with the column of the period that is asked for.

    Header cells (first three rows, from column 1 on) name the previous or the current period, the
    question's years override them; the last such cell counts. A question for the opening balance
    takes the previous column if there is one. Tables of under three columns keep their value column.
    """
    low = F.lower(strip("text"))
    heads = cells.where((F.col("row") < 3) & (F.col("col") >= 1)).select(*TABLE, "row", "col", low.alias("h"))
    q = F.lower(F.col("question"))
    years = F.regexp_extract_all(q, F.lit(r"(?U)\b(20\d{2})\b"), F.lit(1))
    asked = questions.withColumn("opening", contains_any(q, C.OPENING_QUESTION)).withColumn("years_", years)
    met = asked.join(heads, TABLE, "left")
    prev = contains_any(F.col("h"), C.PREVIOUS_HEADERS)
    curr = ~prev & contains_any(F.col("h"), C.CURRENT_HEADERS)
    named = F.exists("years_", lambda y: F.contains(F.col("h"), y))
    # in a row, years come after words, later ones after earlier
    year_place = F.array_max(F.transform("years_", lambda y, i: F.when(F.contains(F.col("h"), y), i)))
    word_key = F.struct("row", F.lit(0).alias("pass"), F.lit(0).alias("y"), "col")
    year_key = F.struct("row", F.lit(1).alias("pass"), year_place.alias("y"), "col")
    last = lambda test, key: F.max(F.when(test, key))
    found = met.groupBy("id", *TABLE, "opening").agg(
        F.greatest(last(prev, word_key), last(named & F.col("opening"), year_key))["col"].alias("prev"),
        F.greatest(last(curr, word_key), last(named & ~F.col("opening"), year_key))["col"].alias("curr"),
    )
    chosen = F.when(F.col("width") < 3, F.col("value_col")).when(F.col("opening") & F.col("prev").isNotNull(), F.col("prev")).otherwise(F.coalesce("curr", "value_col"))
    return questions.join(found, ["id", *TABLE]).join(roles, TABLE).select(*questions.columns, chosen.alias("val_col"))


def by_code(plans: DataFrame, cells: DataFrame, codes: DataFrame, zero_blank: bool = False) -> DataFrame:
    """Tier 1: (id, value, report_id, table_index): the first number by table, then code, then row.

    plans: (id, table_pos, report_id, table_index, val_col); codes: (id, code_pos, code). With
    zero_blank a blank value counts as 0 instead of being passed over.
    """
    wanted = plans.join(codes, "id")
    rows = rows_by_code(cells, wanted.select(*TABLE, "code"))
    at = wanted.join(rows.drop("col"), [*TABLE, "code"])
    values = cells.select(*TABLE, "row", F.col("col").alias("val_col"), "num", "text")
    value = F.coalesce("num", F.when(F.lower(strip("text")).isin(*C.BLANKS), 0.0)) if zero_blank else F.col("num")
    hit = at.join(values, [*TABLE, "row", "val_col"]).withColumn("value", value).where("value is not null")
    return hit.groupBy("id").agg(F.min_by(F.struct("value", *TABLE), F.struct("table_pos", "code_pos", "row")).alias("x")).select("id", "x.*")


def label_score(label: Column, metric: Column, question: Column, ratio: Column) -> Column:
    """Word coverage, plus 0.09 x sequence ratio, plus 0.1 for the whole phrase; floors for total rows and labels that the question holds."""
    low, m, q = F.lower(label), F.lower(strip(metric)), F.lower(F.coalesce(question, F.lit("")))
    base = word_coverage(low, m) + 0.09 * ratio + F.when(F.contains(low, m), 0.1).otherwise(0.0)
    totals = low.isin(*C.TOTAL_LABELS) & (contains_any(q, ("tổng", "cộng")) | contains_any(m, ("tổng", "cộng")))
    named = (F.length(low) >= 4) & ~low.isin(*C.STOP_LABELS) & F.contains(q, low)
    with_total = F.when(totals, F.greatest(base, F.lit(0.65))).otherwise(base)
    return F.when(named, F.greatest(with_total, F.lit(0.95))).otherwise(with_total)


def by_label(plans: DataFrame, cells: DataFrame, roles: DataFrame, metrics: DataFrame) -> DataFrame:
    """Tier 2: (id, value, report_id, table_index, score): the best label above 0.4 that has a number.

    plans: (id, question, table_pos, report_id, table_index, val_col); metrics: (id, metric). Sequence
    ratios are only computed for labels that share a word or are floored.
    """
    at = plans.join(roles.select(*TABLE, "item_col"), TABLE)
    items = cells.select(*TABLE, "row", F.col("col").alias("item_col"), strip("text").alias("label"))
    values = cells.where("num is not null").select(*TABLE, "row", F.col("col").alias("val_col"), F.col("num").alias("value"))
    rows = at.join(items, [*TABLE, "item_col"]).where((F.col("label") != "") & ~F.lower("label").isin(*C.SKIPPED_LABELS)).join(values, [*TABLE, "row", "val_col"])
    pairs = rows.join(metrics, "id").withColumn("m", F.lower(strip("metric")))
    # without a floor, the ratio adds 0.09 at most
    promising = label_score(F.col("label"), F.col("m"), F.col("question"), F.lit(1.0)) > 0.4
    scored = pairs.where(promising).withColumn("score", label_score(F.col("label"), F.col("m"), F.col("question"), sequence_ratio(F.lower("label"), F.col("m")))).where("score > 0.4")
    place = F.struct(-F.col("score"), F.col("table_pos"), F.col("row"))
    return scored.groupBy("id").agg(F.min_by(F.struct("value", *TABLE, "score"), place).alias("x")).select("id", "x.*")


def number_in_line(line: Column) -> Column:
    """The first number but 0 of a line, times the unit that follows it.

    A number is digits, then groups of a mark and digits, with a hyphen or a dash in front where it is
    negative; commas go, dots are decimal, so one of several dots isn't read.
    """
    units = "|".join(u for u, _ in C.TEXT_UNITS)
    pattern = rf"(?iu)([-–]?\d+(?:[.,]\d+)*)[\s\p{{Z}}]*({units})?"
    numbers = F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda x: F.translate(x, "–,", "-"))
    named = F.regexp_extract_all(F.lower(line), F.lit(pattern), F.lit(2))

    def value(x: Column, u: Column) -> Column:
        factor = F.lit(1.0)
        for word, f in reversed(C.TEXT_UNITS):
            factor = F.when(u == word, F.lit(f)).otherwise(factor)
        return F.when(x.rlike(r"^-?(\d+\.?\d*)$"), x.try_cast("double")) * factor

    return F.get(F.filter(F.zip_with(numbers, named, value), lambda v: v.isNotNull() & (v != 0)), F.lit(0))


def by_text(plans: DataFrame, texts: DataFrame, metrics: DataFrame) -> DataFrame:
    """Tier 3: (id, value, report_id, table_index): the number of the first line that holds a metric, by table, then metric, then line.

    texts: (report_id, table_index, text), the table's context and its surroundings; metrics: (id, metric_pos, metric).
    """
    rows = plans.join(texts, TABLE).select("id", "table_pos", *TABLE, F.posexplode(broken_lines("text")).alias("line_no", "line"))
    met = rows.join(metrics, "id").where((F.length(strip("metric")) >= 3) & F.contains(F.lower("line"), F.lower(strip("metric"))))
    found = met.withColumn("value", number_in_line(F.col("line"))).where("value is not null")
    return found.groupBy("id").agg(F.min_by(F.struct("value", *TABLE), F.struct("table_pos", "metric_pos", "line_no")).alias("x")).select("id", "x.*")


def cascade(questions: DataFrame, *tiers, cut=lambda df: df) -> DataFrame:
    """questions (id, ...) with value, tier and table of the first tier that has one; each tier is a function of the ids still open.

    cut() may cut the lineage of what a tier has found, as each later tier builds on it.
    """
    open_, parts = questions.select("id"), []
    shape = ["id", "value", *TABLE, "tier"]
    for k, tier in enumerate(tiers, 1):
        found = cut(tier(open_).withColumn("tier", F.lit(k)).select(shape))
        parts.append(found)
        open_ = open_.join(found, "id", "left_anti")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return questions.join(out, "id", "left").withColumn("value", F.coalesce("value", F.lit(0.0))).withColumn("tier", F.coalesce("tier", F.lit(0)))


def first_nonzero(plans: DataFrame, cells: DataFrame) -> DataFrame:
    """Last resort: (id, value): the first number but 0 by table, column from 1 on, row."""
    hit = plans.join(cells.where((F.col("col") >= 1) & (F.col("num") != 0)), TABLE)
    return hit.groupBy("id").agg(F.min_by("num", F.struct("table_pos", "col", "row")).alias("value"))


def _digits(c: Column) -> Column:
    """What is left of a text without anything but digits, dots and hyphens."""
    return F.regexp_replace(c, r"[^\d.-]", "")


def _parsed(c: Column) -> Column:
    return F.when(c.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), c.try_cast("double"))


def get_val(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (report_id, table_index, code, keyword), each once, with value: one cell by code, else by keyword.

    The row is the first whose cell is the code, in the leftmost column that has one; without such a
    row the first that holds the keyword (plain text, case aside) in column 0, else in column 1. The
    value stands in the last column but one, or the last of fewer than three; what isn't a number is
    0, and so is the value where no row is found.
    """
    targets = targets.distinct()
    asked, word = F.coalesce(strip("code"), F.lit("")) != "", F.lower(strip("keyword"))
    # cells are dealt out by table once: what follows, by row and by target, stays where a table lies
    placed = cells.select(*TABLE, "row", "col", "text").withColumn("width_", F.max("col").over(Window.partitionBy(*TABLE)) + 1)
    met = targets.join(placed, TABLE, "left")
    at = F.when(F.col("width_") >= 3, F.col("width_") - 2).otherwise(F.col("width_") - 1)
    rows = met.groupBy(*targets.columns, "row").agg(
        F.min(F.when(asked & (strip("text") == F.col("code")), F.col("col"))).alias("by_code"),
        F.min(F.when((F.col("col") < 2) & (F.coalesce(word, F.lit("")) != "") & F.contains(F.lower("text"), word), F.col("col"))).alias("by_word"),
        F.max(F.when(F.col("col") == at, F.col("text"))).alias("value_"),
    )
    first = lambda by: F.min(F.when(F.col(by).isNotNull(), F.struct(by, "row", "value_")))
    found = rows.groupBy(*targets.columns).agg(F.coalesce(first("by_code")["value_"], F.when(first("by_code").isNull(), first("by_word")["value_"])).alias("text"))
    return found.select(*targets.columns, F.coalesce(_parsed(_digits(F.col("text"))), F.lit(0.0)).alias("value"))


def first_parsable(cells: DataFrame, default: float = 0.0) -> DataFrame:
    """(report_id, table_index, value): the first number of each table's second column, or of its only one, else the default."""
    column = F.least(F.lit(1), F.max("col").over(Window.partitionBy(*TABLE)))
    own = cells.withColumn("at_", column).where("col = at_").withColumn("value", _parsed(_digits(F.col("text"))))
    found = own.groupBy(*TABLE).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("row"))).alias("value"))
    return found.withColumn("value", F.coalesce("value", F.lit(float(default))))


def excerpt(rows: DataFrame, keys: list[str], order: str, hit: Column, first: int = 5, last: int = 2) -> DataFrame:
    """The first and last rows of each key, and those at or next to a hit."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("hit_", F.coalesce(hit, F.lit(False)))
    near = F.col("hit_") | F.coalesce(F.lag("hit_").over(w), F.lit(False)) | F.coalesce(F.lead("hit_").over(w), F.lit(False))
    placed = marked.withColumns({"near_": near, "place_": F.row_number().over(w), "size_": F.count("*").over(Window.partitionBy(*keys))})
    return placed.where((F.col("place_") <= first) | (F.col("place_") > F.col("size_") - last) | F.col("near_")).drop("hit_", "near_", "place_", "size_")


def split_pairs(tables: DataFrame) -> DataFrame:
    """Pairs of tables that stand next to each other in a report and so may be one: (report_id, first, second)."""
    w = Window.partitionBy("report_id").orderBy("table_index")
    return tables.select("report_id", F.col("table_index").alias("first"), F.lead("table_index").over(w).alias("second")).where("second = first + 1")


def surroundings(reports: DataFrame, tables: DataFrame, before: int = 15, after: int = 120) -> DataFrame:
    """(report_id, table_index, text): the report's lines around a table, without table markup."""
    rows = tables.select(*TABLE, "start_line").join(reports.select("report_id", lines("content").alias("ls")), "report_id")
    begin = F.greatest(F.col("start_line") - before, F.lit(0))
    text = F.array_join(F.slice("ls", begin + 1, F.col("start_line") + after - begin), "\n")
    return rows.select(*TABLE, F.regexp_replace(text, r"(?is)<table.*?>.*?</table>|<tr.*?>.*?</tr>|<td.*?>.*?</td>", " ").alias("text"))


def first_three_columns(catalog: DataFrame) -> DataFrame:
    """(report_id, table_index, codes): the distinct texts of the first three columns below the header, where a table has any."""
    texts = F.flatten(F.transform(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: F.transform(F.slice(r, 1, 3), strip)))
    codes = F.array_sort(F.array_distinct(F.filter(texts, lambda x: x.isNotNull())))
    # generated, as a filter would work the rows out a second time
    return catalog.select(*TABLE, F.explode(F.filter(F.array(codes), lambda x: F.size(x) > 0)).alias("codes"))


def text_content(cells: DataFrame) -> DataFrame:
    """(report_id, table_index, content): the texts of the first two columns that aren't numbers, in order."""
    own = cells.where("col < 2").where(to_number("text").isNull() & (strip("text") != ""))
    listed = own.groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.struct("row", "col", "text"))).alias("x"))
    return listed.select(*TABLE, F.array_join(F.transform("x", lambda e: e["text"]), " ").alias("content"))


def facts(catalog: DataFrame, cells: DataFrame, roles: DataFrame) -> DataFrame:
    """(report_id, sheet, code, row, cur, prev) of the statement tables: what the ratios are made of."""
    sheet = F.create_map(*[F.lit(x) for p in (("Balance Sheet", "BS"), ("Income Statement", "IS"), ("Cash Flow Statement", "CF")) for x in p])
    tables = catalog.select(*TABLE, F.try_element_at(sheet, F.col("table_type")).alias("sheet")).where("sheet is not null").join(roles.where("code_col is not null"), TABLE)
    codes = cells.select(*TABLE, "row", F.col("col").alias("code_col"), strip("text").alias("code")).where(F.col("code").rlike(r"^\d{2,3}[a-z]?$"))
    rows = tables.join(codes, [*TABLE, "code_col"])
    nums = cells.where("num is not null").select(*TABLE, "row", "col", "num")
    met = rows.join(nums, [*TABLE, "row"])
    period = F.when(F.col("width") >= 5, 3).otherwise(2)  # item, code, note, current, prior; or without the note
    own = met.groupBy("report_id", "sheet", "table_index", "code", "row", "width").agg(F.max(F.when(F.col("col") == period, F.col("num"))).alias("cur"), F.max(F.when(F.col("col") == period + 1, F.col("num"))).alias("prev"))
    return own.select("report_id", "sheet", "code", (F.col("table_index") * 100_000 + F.col("row")).alias("row"), "cur", "prev")
