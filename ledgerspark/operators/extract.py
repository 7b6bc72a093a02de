"""Report texts to a catalog of tables and their cells.

All steps of a report's tables, what looks at neighbouring tables (continuation, header inheritance)
among them, are array expressions on the report's row, so nothing is shuffled. The grid itself is the
one step in Python. Tables are stored before their cells are normalised: that is done where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.arrays import bound, last_before, with_states
from ..functions.html import html_grid, html_grids
from ..functions.numeric import normalized, to_number
from ..functions.text import SPACE, contains_any, lines, strip
from .cut import cut
from .spans import breaks, matches

# what (?is)<table.*?>.*?</table> matches, in steps from one angle bracket to the next
TABLE = r"(?i)<table[^>]*+>[^<]*+(?:<(?!/table>)[^<]*+)*+</table>"
PAGE = r"=====\s*PAGE\s+(\d+)\s*====="
#: How the HTML of a table begins that holds a cell, as the parser reads it, too.
BEGUN = r'^<table>[ \n]*<tr>[ \n]*<t[dh](?: (?:row|col)span="[0-9]+")?>'
CONTEXT_LINES = 15
#: So many page markers are looked through for each table; more are merged with the tables.
FEW = 32


def page_markers(content: Column) -> Column:
    """array<struct(line, page)> of a report's page markers."""
    marked = F.transform(lines(content), lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract(x, PAGE, 1).alias("page")))
    return F.transform(F.filter(marked, lambda m: m["page"] != ""), lambda m: F.struct(m["line"].alias("line"), m["page"].cast("int").alias("page")))


def note_title(context: Column) -> Column:
    """The line of the context, from its end, that looks like a title."""
    low = lambda x, ws: contains_any(F.lower(x), ws)
    titled = lambda x: x.rlike(C.NOTE_TITLE) | x.rlike(C.NUMBERED_TITLE) | x.rlike(C.STATEMENT_TITLE) | x.rlike(C.TOPIC_TITLE)

    def choose(back: Column) -> Column:
        # the last lines alone, and those before them only if these hold none
        parts = (F.slice(back, 1, 1), F.slice(back, 2, 3), F.slice(back, F.lit(5), F.size(back)))
        own = [F.filter(F.transform(part, strip), lambda x: x != "") for part in parts]
        last = lambda test: [F.get(F.filter(xs, test), F.lit(0)) for xs in own]
        best = last(lambda x: titled(x) & ~low(x, C.PAGE_WORDS + C.PERIOD_WORDS))
        good = last(lambda x: (F.length(x) > 3) & ~low(x, C.PAGE_WORDS))
        return F.coalesce(*best, *good, *[F.get(xs, F.lit(0)) for xs in own], F.lit(C.DEFAULT_TITLE))

    return F.coalesce(bound(F.reverse(lines(context)), choose), F.lit(C.DEFAULT_TITLE))


def table_type(text: Column) -> Column:
    """The statement that an upper-cased text names, the first of a fixed order."""

    def choose(t: Column) -> Column:
        has = lambda w: F.coalesce(F.contains(t, F.lit(w)), F.lit(False))
        return (
            F.when(has("CÂN ĐỐI KẾ TOÁN"), "Balance Sheet")
            .when(has("KẾT QUẢ") & has("KINH DOANH"), "Income Statement")
            .when(has("LƯU CHUYỂN TIỀN"), "Cash Flow Statement")
            .when(has("THUYẾT MINH") | has("THUYÊT MINH"), "Notes")
            .otherwise("Other/Details")
        )

    return bound(F.upper(text), choose)


def places(hits: Column) -> Column:
    """array<struct(line, col)>: the 1-based line of each table, and the code points before it in that line. Running sums over the matches."""
    last = lambda x: F.length(F.substring_index(x, "\n", -1))
    seen = F.transform(hits, lambda p: F.struct(breaks(p["before"]).alias("nb"), last(p["before"]).alias("lb"), breaks(p["hit"]).alias("nh"), last(p["hit"]).alias("lh")))

    def at(s: Column, x: Column) -> Column:
        return F.struct((s["line"] + x["nb"]).alias("line"), F.when(x["nb"] > 0, x["lb"]).otherwise(s["col"] + x["lb"]).alias("col"))

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["line"] + x["nb"] + x["nh"]).alias("line"), (F.when(x["nh"] > 0, 0).when(x["nb"] > 0, x["lb"]).otherwise(s["col"] + x["lb"]) + x["lh"]).alias("col"))

    return with_states(seen, F.struct(F.lit(1).alias("line"), F.lit(0).alias("col")), step, "struct<line:int,col:int>", at)


def context_at(ls: Column, at: Column) -> Column:
    """The last lines, blank ones at the end aside, of a text without white space in front, cut to lines, before a place in it.

    The last line is usually this one or that before. Else so many lines are looked at, then four times as many if blank ones
    left too few, and so on: no run of blank lines is passed more than a few times.
    """
    n = at["line"]
    here = F.rtrim(F.left(F.get(ls, n - 1), at["col"]), F.lit(SPACE))
    above = F.rtrim(F.get(ls, n - 2), F.lit(SPACE))

    def ending(last: Column, before: Column, most: Column | int) -> Column:
        """The line last with those above it, up to ``most`` of the ``before`` that there are."""
        # a slice would go through all lines
        above = F.transform(F.sequence(F.greatest(before - most, F.lit(0)), before - 1), lambda k: F.get(ls, k))
        return F.when(before > 0, F.concat(F.array_join(above, "\n"), F.lit("\n"), last)).otherwise(last)

    def of(most: Column | int) -> Column:
        text = F.rtrim(ending(F.lit(""), n - 1, most), F.lit(SPACE))
        return bound(text, lambda c: F.when((n - 1 <= most) | (breaks(c) >= CONTEXT_LINES - 1), F.substring_index(c, "\n", -CONTEXT_LINES)))

    general = F.coalesce(*[of(CONTEXT_LINES * 4**k) for k in range(1, 9)], of(n - 1))
    # the first line of all begins without white space, so the walk ends there
    return F.when(here != "", ending(here, n - 1, CONTEXT_LINES - 1)).when(n == 1, "").when(above != "", ending(above, n - 2, CONTEXT_LINES - 1)).otherwise(general)


def located(reports: DataFrame) -> DataFrame:
    """reports with body, the content from its first word on, blank, the lines before it, and hits and places of its tables instead of content."""
    keys = ["report_id", "ticker", "year"]
    bodies = reports.select(*keys, F.coalesce("content", F.lit("")).alias("content")).withColumn("body", F.ltrim("content", F.lit(SPACE)))
    blank = breaks(F.col("content")) - breaks(F.col("body"))
    return bodies.select(*keys, "body", blank.alias("blank"), matches("body", TABLE).alias("hits")).withColumn("places", places(F.col("hits")))


def each(tables: Column | str) -> Column:
    """inline, of an array that Spark takes as worked out: of a column as it is, Spark asks first whether it is empty, and works it out for that inside each step that made it."""
    return F.inline(F.transform(tables, lambda t: t))


def tables_of(reports: DataFrame) -> DataFrame:
    """reports (report_id, ticker, year, content) with ``tables`` instead of content: array<struct(index, lines, page, context, the text before, the HTML)>.

    A table's page is that of the last marker whose line is not after its own, 1 before any; markers and
    tables are merged by line. The context is the last lines of the text before a table; what is blank
    before the report's first word is no line.
    """
    keys = ["report_id", "ticker", "year"]
    found = located(reports).select(*keys, "blank", "hits", "places", lines("body").alias("lines"), page_markers(F.col("body")).alias("marks"))
    marks = F.transform("marks", lambda m: F.struct(m["line"].alias("at"), m["page"].alias("value")))
    among_few = lambda p: F.element_at(F.concat(F.array(F.lit(1)), F.transform(F.filter("marks", lambda m: m["line"] <= p["line"]), lambda m: m["page"])), -1)
    merged = last_before(marks, F.transform("places", lambda p: p["line"]), "int", "int")
    pages = F.when(F.size("marks") <= FEW, F.transform("places", among_few)).otherwise(merged)
    paged = F.zip_with("places", pages, lambda p, page: F.struct(p["line"].alias("line"), p["col"].alias("col"), F.coalesce(page, F.lit(1)).alias("page")))
    found = found.select(*keys, "blank", "hits", "lines", paged.alias("places"))

    def one(hit: Column, i: Column) -> Column:
        at = F.get("places", i)
        return F.struct((i + 1).alias("table_index"), (F.col("blank") + at["line"]).alias("start_line"), at["page"].alias("page_number"), context_at(F.col("lines"), at).alias("own_context"), hit["before"].alias("before"), hit["hit"].alias("html"))

    return found.select(*keys, F.transform("hits", one).alias("tables"))


def find_tables(reports: DataFrame) -> DataFrame:
    """The reports' tables, a row each."""
    return tables_of(reports).select("report_id", "ticker", "year", each("tables"))


def similar_header(a: Column, b: Column) -> Column:
    """The share of a's cells that equal b's at their place, white space and case aside."""
    same = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: (strip(F.lower(x)) == strip(F.lower(y))).cast("int"))
    return F.try_divide(F.aggregate(same, F.lit(0), lambda s, x: s + x).cast("double"), F.size(a))


def with_chains(found: DataFrame) -> DataFrame:
    """found (tables, grids: arrays of a report) with what a table has of those before it, a row each: continued, parent_line, context, header.

    A table continues the one before if it is as wide and the text between tells of a page and no title; its
    context and parent_line are those of the chain's head. If its first row is less than 80 % like the one
    before's, it gets that row as header; the next table compares with the result. This is a fold over the
    tables in order, whose state is two places: the head's, and that of the row to compare with. first is a
    table's own first row, normalised; a table without cells has two empty ones.
    """

    def own_first(grid: Column) -> Column:
        return F.when(F.size(grid) > 0, F.transform(F.get(grid, F.lit(0)), normalized)).otherwise(F.array(F.lit(""), F.lit("")))

    def goes_on(t: Column, i: Column) -> Column:
        wide = lambda i: F.size(F.get("firsts", i))
        new_title = t["before"].rlike(C.NOTE_TITLE) | t["before"].rlike(C.NUMBERED_TITLE.replace("(?iu)", "(?ium)")) | t["before"].rlike(C.NEW_STATEMENT)
        return (i > 0) & (wide(i - 1) == wide(i)) & contains_any(F.upper(t["before"]), ("PAGE", "TRANG")) & ~new_title

    def inherits(s: Column, x: Column) -> Column:
        return x["continued"] & (F.coalesce(similar_header(F.get("firsts", x["i"]), F.get("firsts", s["first"])), F.lit(0.0)) < 0.8)

    def step(s: Column, x: Column) -> Column:
        return F.struct(F.when(x["continued"], s["head"]).otherwise(x["i"]).alias("head"), F.when(inherits(s, x), s["first"]).otherwise(x["i"]).alias("first"))

    def told(s: Column, x: Column) -> Column:
        return F.struct(x["continued"].alias("continued"), F.when(x["continued"], s["head"]).otherwise(x["i"]).alias("head"), F.when(inherits(s, x), s["first"]).alias("header"))

    def one(t: Column, i: Column) -> Column:
        link = F.get("links", i)
        head = F.get("tables", link["head"])
        kept = [t[c].alias(c) for c in ("table_index", "start_line", "page_number")]
        of_chain = [F.when(link["continued"], head["start_line"]).alias("parent_line"), head["own_context"].alias("context"), F.get("firsts", link["header"]).alias("header")]
        return F.struct(*kept, link["continued"].alias("continued"), *of_chain, F.get("firsts", i).alias("first"), F.get("grids", i).alias("grid"))

    keys = ["report_id", "ticker", "year", "tables", "grids"]
    found = found.withColumn("firsts", F.transform("grids", own_first))
    found = found.withColumn("continues", F.transform("tables", lambda t, i: F.struct(i.alias("i"), goes_on(t, i).alias("continued"))))
    begin = F.struct(F.lit(0).alias("head"), F.lit(0).alias("first"))
    found = found.select(*keys, "firsts", with_states(F.col("continues"), begin, step, "struct<head:int,first:int>", told).alias("links"))
    return found.select(*keys[:3], F.inline(F.transform("tables", one)))


def row_text(row: Column) -> Column:
    return F.array_join(row, " ")


def first_column(rows: Column) -> Column:
    return F.transform(rows, lambda r: strip(F.coalesce(F.get(r, F.lit(0)), F.lit(""))))


def item_labels(rows: Column) -> Column:
    """The first column's texts that aren't empty or mere digits."""
    return F.filter(first_column(rows), lambda x: (x != "") & ~F.regexp_replace(x, "[.-]", "").rlike(r"^\d+$"))


def account_codes(rows: Column) -> Column:
    """Cells of the first three columns that are one to four digits once dots go, column by column, each once."""
    column = lambda c: F.transform(rows, lambda r: F.replace(strip(F.coalesce(F.get(r, F.lit(c)), F.lit(""))), F.lit("."), F.lit("")))
    by_column = F.flatten(F.array(*[column(c) for c in range(3)]))
    return F.array_distinct(F.filter(by_column, lambda x: x.rlike(r"^\d{1,4}$")))


def preview(rows: Column) -> Column:
    """The first three rows, four cells each, thirty characters a cell."""
    return F.array_join(F.transform(F.slice(rows, 1, 3), lambda r: F.array_join(F.transform(F.slice(r, 1, 4), lambda x: F.substring(x, 1, 30)), " | ")), "\n")


def scope_summary(codes: Column, labels: Column) -> Column:
    numbers = F.transform(codes, lambda x: x.cast("int"))
    return F.struct(
        F.array_min(numbers).alias("min_code"),
        F.array_max(numbers).alias("max_code"),
        F.coalesce(F.get(labels, F.lit(0)), F.lit("")).alias("first_label"),
        F.coalesce(F.get(labels, F.size(labels) - 1), F.lit("")).alias("last_label"),
    )


def build_catalog(reports: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """reports to the catalog: one row a table, with rows (array of arrays of normalised cells).

    tickers (ticker, company_name) is a dimension, joined left; a ticker that it lacks has the empty
    name. A table without cells is kept as one row of two empty cells. Order is (report_id, table_index).
    """
    found = tables_of(reports).withColumn("grids", html_grids(F.transform("tables", lambda t: t["html"])))
    # a report is searched and its HTML read once, whatever is asked of its tables
    tables = cut(with_chains(found), "tables")
    header = F.col("header")
    own = F.when(F.size("grid") > 0, F.transform("grid", lambda r: F.transform(r, normalized))).otherwise(F.array("first"))
    tables = tables.withColumn("rows", F.when(header.isNull(), own).otherwise(F.concat(F.array(header), own))).withColumn("first", F.coalesce(header, "first"))
    rows, labels, codes = F.col("rows"), F.col("labels"), F.col("codes")
    tables = tables.withColumns({"labels": item_labels(rows), "codes": account_codes(rows), "title": note_title(F.col("context"))})
    catalog = tables.select(
        "report_id",
        "table_index",
        "start_line",
        F.col("parent_line").alias("parent_table_start_line"),
        "page_number",
        F.format_string("%s_table_%d.csv", "report_id", "table_index").alias("csv_path"),
        "ticker",
        "year",
        "title",
        F.col("context").alias("table_context"),
        table_type(F.concat_ws(" ", "context", row_text(F.col("first")))).alias("table_type"),
        F.col("first").alias("headers"),
        preview(rows).alias("preview"),
        F.array_join(labels, " ").alias("item_col_text"),
        codes.alias("account_codes_set"),
        F.transform(labels, F.upper).alias("exact_metric_labels"),
        scope_summary(codes, labels).alias("table_scope_summary"),
        "continued",
        "rows",
    )
    return catalog.withColumn("company_name", F.lit("")) if tickers is None else with_names(catalog, tickers)


def with_names(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """rows (ticker, ...) with company_name of tickers (ticker, company_name), the empty name where it is unknown."""
    names = tickers.select("ticker", "company_name").dropDuplicates(["ticker"])
    return rows.join(names, "ticker", "left").withColumn("company_name", F.coalesce("company_name", F.lit("")))


def cells_of(catalog: DataFrame) -> DataFrame:
    """The tall view: (report_id, table_index, row, col, text, num)."""
    return (
        catalog.select("report_id", "table_index", F.posexplode("rows").alias("row", "r"))
        .select("report_id", "table_index", "row", F.posexplode("r").alias("col", "text"))
        .withColumn("num", to_number("text"))
    )


def empty_tables(reports: DataFrame) -> DataFrame:
    """The error log: tables that hold no cell. Only those that don't begin with one are parsed."""
    one = lambda hit, i: F.struct((i + 1).alias("table_index"), (F.col("blank") + F.get("places", i)["line"]).alias("start_line"), hit["hit"].alias("html"))
    unsure = F.filter(F.transform("hits", one), lambda t: ~t["html"].rlike(BEGUN))
    found = located(reports).select("report_id", F.inline(unsure)).withColumn("grid", html_grid("html")).where(F.size("grid") == 0)
    return found.select("report_id", "table_index", F.format_string("table at line %d has no cells", "start_line").alias("message"))
