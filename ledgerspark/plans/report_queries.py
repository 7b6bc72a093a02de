"""Extraction, lookup and sources over reports that are put together from orders and their items.

A customer is a report, an order a page with one table, an item a row of it: label, code, current and
prior value. Odd orders of a customer have a title and a header, even ones continue the table before
if that is as wide. Orders by five have a label over two columns, those by eleven an empty table.
The SQL works on the tables themselves; it neither makes nor reads HTML, but follows the same rules.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text
from ..operators import answer, extract, intent, lookup, plan, provider, rank
from ..operators.cut import cut, shared
from ..sources import readers, writers
from .queries import _PROBES, SQL, _cells, _plans, _probes, _ROWS, items, pick, pick_sql, query, table

_TITLES = ("BẢNG CÂN ĐỐI KẾ TOÁN", "BÁO CÁO KẾT QUẢ KINH DOANH", "BÁO CÁO LƯU CHUYỂN TIỀN TỆ", "Thuyết minh 7")
_HEADER = ("Chỉ tiêu", "Mã số", "31/12/2020", "01/01/2020")


def _report_id(key: Column) -> Column:
    return F.concat(F.lit("C"), key.cast("string"), F.when(key % 2 == 0, "_separate").otherwise("_consolidated"))


def _ticker(key: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad((key % 50).cast("string"), 2, "0"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report_id, ticker, year, content)."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    cell = lambda c, span="": F.concat(F.lit(f"<td{span}>"), c, F.lit("</td>"))
    label = F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" &amp; co"))
    rest = F.concat(
        cell((F.col("l_suppkey") % 400).cast("string")),
        cell(F.replace(F.format_number(cents, 0), F.lit(","), F.lit("."))),
        cell(F.when(F.col("l_linestatus") == "O", "-").otherwise(F.concat(F.lit("("), F.col("l_quantity").cast("int").cast("string"), F.lit(")")))),
    )
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    wide = lambda key: F.col(key) % 5 == 0
    first = F.when(wide("l_orderkey"), cell(label, ' colspan="2"')).otherwise(cell(label))
    html = F.struct(place.alias("at"), F.concat(F.lit("<tr>"), first, rest, F.lit("</tr>")).alias("html"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(html)).alias("rows"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", _report_id(F.col("o_custkey")).alias("report_id")).join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    orders = orders.withColumn("body", F.array_join("rows.html", "")).drop("rows")
    key = F.col("o_orderkey")
    # dealt out by report_id once, as what follows for a report is
    j = F.row_number().over(Window.partitionBy("report_id").orderBy("o_orderkey"))
    head = lambda span: "<tr>" + "".join(f"<th{span if i == 0 else ''}>{h}</th>" for i, h in enumerate(_HEADER)) + "</tr>"
    header = F.when(F.col("j") % 2 == 0, "").when(wide("o_orderkey"), head(' colspan="2"')).otherwise(head(""))
    html_table = F.concat(F.lit("<table>"), F.when(key % 11 == 0, "").otherwise(F.concat(header, "body")), F.lit("</table>\n"))
    title = F.when(F.col("j") % 2 == 1, F.concat(pick(key, *_TITLES), F.lit("\n"))).otherwise("")
    page = F.concat(F.lit("===== PAGE "), F.col("j").cast("string"), F.lit(" =====\n"), title, html_table)
    pages = orders.withColumn("j", j).select("report_id", "o_custkey", F.struct("j", page.alias("page")).alias("p"))
    whole = pages.groupBy("report_id", "o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["page"]), "").alias("content"))
    return whole.select("report_id", _ticker(F.col("o_custkey")).alias("ticker"), (2015 + F.col("o_custkey") % 8).cast("int").alias("year"), "content")


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(_ticker(F.col("n_nationkey")).alias("ticker"), F.col("n_name").alias("company_name"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.build_catalog(reports(spark, sf_dir), tickers(spark, sf_dir))


_REPORT_SQL = r"CONCAT('C', o_custkey, CASE WHEN o_custkey % 2 = 0 THEN '_separate' ELSE '_consolidated' END)"
_CATALOG_SQL = f"""
o AS (SELECT o_orderkey AS k, o_custkey AS c, {_REPORT_SQL} AS report_id, 'T' || lpad(CAST(o_custkey % 50 AS VARCHAR), 2, '0') AS ticker, CAST(2015 + o_custkey % 8 AS INT) AS year,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS j, {pick_sql('o_orderkey', *_TITLES)} AS own_title,
             CASE WHEN o_orderkey % 11 = 0 THEN 2 WHEN o_orderkey % 5 = 0 THEN 5 ELSE 4 END AS width
      FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
b AS (SELECT *, 3 * ((j + 1) // 2) + 2 * (j // 2) AS line, coalesce(j % 2 = 0 AND lag(width) OVER w = width, false) AS continued,
             CASE WHEN j % 2 = 1 THEN own_title ELSE lag(own_title) OVER w END AS title FROM o WINDOW w AS (PARTITION BY c ORDER BY j)),
t AS (SELECT *, CASE WHEN continued THEN line - 2 ELSE line END AS head_line FROM b),
h AS (SELECT t.c, t.j, max(CASE WHEN starts_with(x.own_title, 'BẢNG') THEN 4 WHEN contains(x.own_title, 'KẾT QUẢ') THEN 3 WHEN contains(x.own_title, 'LƯU') THEN 2 ELSE 1 END) AS kind
      FROM t JOIN b x ON x.c = t.c AND x.j % 2 = 1 AND x.line - 1 BETWEEN t.head_line - 15 AND t.head_line - 1 GROUP BY ALL),
i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, 'part ' || l_partkey || ' & co' AS label, CAST(l_suppkey % 400 AS VARCHAR) AS code,
             CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS cur, CASE WHEN l_linestatus = 'O' THEN '0' ELSE '-' || CAST(l_quantity AS INT) END AS prev FROM lineitem),
r AS (SELECT t.k, 0 AS n, CASE WHEN width = 2 THEN ['', ''] WHEN width = 5 THEN ['Chỉ tiêu', '', 'Mã số', '31/12/2020', '01/01/2020'] ELSE ['Chỉ tiêu', 'Mã số', '31/12/2020', '01/01/2020'] END AS r
      FROM t WHERE width = 2 OR j % 2 = 1 OR continued
      UNION ALL SELECT t.k, n, CASE WHEN width = 5 THEN [label, '', code, cur, prev] ELSE [label, code, cur, prev] END FROM t JOIN i USING (k) WHERE width > 2),
g AS (SELECT k, list(r ORDER BY n) AS rows FROM r GROUP BY k)"""


@query(
    f"""WITH {_CATALOG_SQL}, q AS (SELECT * FROM t JOIN g USING (k))
SELECT report_id, CAST(j AS INT) AS table_index, CAST(line AS INT) AS start_line, CAST(j AS INT) AS page_number, ticker, year, CAST(least(15, head_line - 1) AS BIGINT) AS context_lines, report_id || '_table_' || j || '.csv' AS csv_path FROM q"""
)
def report_tables(spark, sf_dir):
    """Where the tables stand."""
    c = catalog(spark, sf_dir)
    return c.select("report_id", "table_index", "start_line", "page_number", "ticker", "year", F.size(text.lines("table_context")).cast("long").alias("context_lines"), "csv_path")


@query(
    f"""WITH {_CATALOG_SQL}, p AS (SELECT t.report_id, CAST(t.j AS INT) AS table_index, unnest(rows) AS cells, unnest(range(0, len(rows))) AS row FROM t JOIN g USING (k))
SELECT report_id, table_index, CAST(row AS INT) AS row, CAST(col AS INT) AS col, cells[col + 1] AS text, try_cast(nullif(cells[col + 1], '') AS DOUBLE) AS num FROM (SELECT *, unnest(range(0, len(cells))) AS col FROM p)"""
)
def report_cells(spark, sf_dir):
    """The grid, its numbers, inherited headers, placeholders."""
    return extract.cells_of(catalog(spark, sf_dir))


@query(
    f"""WITH {_CATALOG_SQL}
SELECT report_id, CAST(t.j AS INT) AS table_index, title, CASE kind WHEN 4 THEN 'Balance Sheet' WHEN 3 THEN 'Income Statement' WHEN 2 THEN 'Cash Flow Statement' WHEN 1 THEN 'Notes' ELSE 'Other/Details' END AS table_type
FROM t LEFT JOIN h USING (c, j)"""
)
def report_titles(spark, sf_dir):
    """The title, also of a table that goes on, and the statement."""
    return catalog(spark, sf_dir).select("report_id", "table_index", "title", "table_type")


@query(f"WITH {_CATALOG_SQL} SELECT report_id, CAST(j AS INT) AS table_index, continued, CASE WHEN continued THEN CAST(line - 2 AS INT) END AS parent_line FROM t")
def report_chains(spark, sf_dir):
    """What continues what."""
    return catalog(spark, sf_dir).select("report_id", "table_index", "continued", F.col("parent_table_start_line").alias("parent_line"))


@query(
    f"""WITH {_CATALOG_SQL},
p AS (SELECT report_id, ticker, CAST(j AS INT) AS table_index, rows, list_filter(list_transform(rows, lambda x: x[1]), lambda x: x <> '') AS labels,
        list_filter(list_transform(list_filter(rows, lambda x: len(x) > 2), lambda x: x[len(x) - 2]), lambda x: regexp_matches(x, '^[0-9]+$')) AS all_codes FROM t JOIN g USING (k)),
d AS (SELECT *, list_filter(all_codes, lambda x, i: list_position(all_codes, x) = i) AS codes FROM p)
SELECT report_id, table_index, array_to_string(rows[1], '|') AS headers,
  array_to_string(list_transform(rows[1:3], lambda x: array_to_string(list_transform(x[1:4], lambda y: left(y, 30)), ' | ')), chr(10)) AS preview,
  array_to_string(labels, ' ') AS item_text, array_to_string(list_transform(labels, lambda x: upper(x)), '|') AS upper_labels, array_to_string(codes, ',') AS codes,
  CAST(list_min(list_transform(codes, lambda x: CAST(x AS INT))) AS INT) AS min_code, CAST(list_max(list_transform(codes, lambda x: CAST(x AS INT))) AS INT) AS max_code,
  coalesce(labels[1], '') AS first_label, coalesce(labels[len(labels)], '') AS last_label, coalesce(n_name, '') AS company_name
FROM d LEFT JOIN (SELECT 'T' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ticker, n_name FROM nation) USING (ticker)"""
)
def report_profiles(spark, sf_dir):
    """Preview, headers, labels, codes, scope, the company's name."""
    s = F.col("table_scope_summary")
    return catalog(spark, sf_dir).select(
        "report_id", "table_index", F.array_join("headers", "|").alias("headers"), "preview", F.col("item_col_text").alias("item_text"), F.array_join("exact_metric_labels", "|").alias("upper_labels"),
        F.array_join("account_codes_set", ",").alias("codes"), s["min_code"].alias("min_code"), s["max_code"].alias("max_code"), s["first_label"].alias("first_label"), s["last_label"].alias("last_label"), "company_name",
    )


@query(f"WITH {_CATALOG_SQL} SELECT report_id, CAST(j AS INT) AS table_index, 'table at line ' || line || ' has no cells' AS message FROM t WHERE width = 2")
def extract_errors(spark, sf_dir):
    """The error log, written and read."""
    path = _folder(spark, "errors")
    writers.write_errors(extract.empty_tables(reports(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query(
    f"""WITH {_CATALOG_SQL}, l AS (SELECT c, line AS n, ' ' AS x FROM b UNION ALL SELECT c, line - 1, own_title FROM b WHERE j % 2 = 1 UNION ALL SELECT c, line - CASE WHEN j % 2 = 1 THEN 2 ELSE 1 END, '===== PAGE ' || j || ' =====' FROM b
      UNION ALL SELECT c, max(line) + 1, '' FROM b GROUP BY c)
SELECT t.report_id, CAST(t.j AS INT) AS table_index, sha256(string_agg(x, chr(10) ORDER BY n)) AS near FROM t JOIN l ON l.c = t.c AND l.n BETWEEN greatest(t.line - 15, 0) + 1 AND t.line + 120 GROUP BY ALL"""
)
def surrounding_text(spark, sf_dir):
    """The lines around a table, without markup."""
    r = reports(spark, sf_dir)
    return lookup.surroundings(r, catalog(spark, sf_dir)).select("report_id", "table_index", F.sha2("text", 256).alias("near"))


@query(
    f"""WITH {_CATALOG_SQL}, p AS (SELECT t.report_id, CAST(t.j AS INT) AS table_index, unnest(rows[2:]) AS r FROM t JOIN g USING (k))
SELECT report_id, table_index, string_agg(DISTINCT x, ',' ORDER BY x) AS codes FROM (SELECT report_id, table_index, unnest(r[1:3]) AS x FROM p) GROUP BY ALL"""
)
def code_cells(spark, sf_dir):
    """What stands in the first three columns."""
    return lookup.first_three_columns(catalog(spark, sf_dir)).select("report_id", "table_index", F.array_join("codes", ",").alias("codes"))


@query(
    f"""WITH {_CATALOG_SQL}, p AS (SELECT t.report_id, CAST(t.j AS INT) AS table_index, unnest(rows) AS r, unnest(range(0, len(rows))) AS n FROM t JOIN g USING (k)),
x AS (SELECT report_id, table_index, n, unnest(r[1:2]) AS x, unnest(range(0, 2)) AS c FROM p)
SELECT report_id, table_index, string_agg(x, ' ' ORDER BY n, c) AS content FROM x WHERE x <> '' AND NOT regexp_matches(x, '^[0-9]+$') GROUP BY ALL"""
)
def text_cells(spark, sf_dir):
    """The words of the first two columns."""
    return lookup.text_content(extract.cells_of(catalog(spark, sf_dir)))


# --- sources and sinks


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        cut(spark.range(1), "first")  # makes a folder for a local session
        base = spark.conf.get("spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _put(spark: SparkSession, files: dict[str, str]) -> None:
    """A few small files, by path."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for path, content in files.items():
        at = hadoop.Path(path)
        out = at.getFileSystem(conf).create(at, True)
        out.write(bytearray(content.encode()))
        out.close()


@query(
    """SELECT 'N' || n_nationkey || '_rep' AS report_id, 'T' || n_regionkey AS ticker, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(2015 + n_nationkey % 8 AS INT) END AS year, 'é ' || n_name || chr(10) || 'b' AS content FROM nation"""
)
def report_scan(spark, sf_dir):
    """Report files below a folder, with what their paths tell."""
    root = _folder(spark, "reports")
    rows = table(spark, sf_dir, "nation").collect()  # a file each
    year = lambda k: "none" if k % 3 == 0 else str(2015 + k % 8)
    _put(spark, {f"{root}/financial_statements/T{r['n_regionkey']}/{year(r['n_nationkey'])}/x/N{r['n_nationkey']}_rep{'_extracted' * (r['n_nationkey'] % 2)}.txt": f"é {r['n_name']}\nb" for r in rows})
    return readers.read_reports(spark, root).drop("path")


@query("SELECT 'T' || n_nationkey AS ticker, n_name || ', é' AS company_name FROM nation")
def ticker_scan(spark, sf_dir):
    """S3: a CSV of codes and names, with a byte order mark."""
    path = _folder(spark, "tickers") + "/codes.csv"
    rows = table(spark, sf_dir, "nation").collect()
    _put(spark, {path: "\ufeffMã CK,Tên\n" + "".join(f' T{r["n_nationkey"]} ,"{r["n_name"]}, é "\n' for r in rows)})
    return readers.read_tickers(spark, path)


@query("SELECT n_nationkey AS id, n_name || ' \"q\"' AS question FROM nation WHERE n_nationkey < 20")
def question_scan(spark, sf_dir):
    """JSON lines with blank ones between, the first by id."""
    path = _folder(spark, "questions") + "/q.jsonl"
    rows = table(spark, sf_dir, "nation").collect()
    _put(spark, {path: "\n\n".join(json.dumps({"id": r["n_nationkey"], "question": r["n_name"] + ' "q"'}) for r in rows)})
    return readers.read_questions(spark, path, 20).withColumn("id", F.col("id").cast("int"))


@query("SELECT 'T' || n_regionkey AS ticker, n_name AS alias FROM nation UNION ALL SELECT 'codes', label || '=' || code FROM (VALUES ('A', '10'), ('B', '20+30')) v(label, code)")
def config_scan(spark, sf_dir):
    """Aliases and account codes of JSON files."""
    folder, by = _folder(spark, "config"), {}
    for r in table(spark, sf_dir, "nation").collect():
        by.setdefault(f"T{r['n_regionkey']}", []).append(r["n_name"])
    _put(spark, {f"{folder}/aliases.json": json.dumps(by), f"{folder}/codes.json": json.dumps({"own": {"A": "10", "B": ["20", "30"]}})})
    aliases = spark.createDataFrame(C.aliases_of(readers.read_text(spark, f"{folder}/aliases.json")), "ticker string, alias string")
    dim = intent.code_dimension(spark, sections={}, synonyms=C.codes_of(readers.read_text(spark, f"{folder}/codes.json"))["own"])
    return aliases.unionByName(dim.select(F.lit("codes").alias("ticker"), F.concat_ws("=", F.upper("label"), F.array_join("codes", "+")).alias("alias")))


@query(f"WITH {_CATALOG_SQL} SELECT year, count(*) AS n, CAST(sum(len(rows)) AS BIGINT) AS n_rows FROM t JOIN g USING (k) WHERE year >= 2018 GROUP BY year")
def catalog_round_trip(spark, sf_dir):
    """The catalog, written by year and read for some years."""
    path = _folder(spark, "catalog")
    writers.write_catalog(catalog(spark, sf_dir), path)
    return readers.read_catalog(spark, path).where("year >= 2018").groupBy("year").agg(F.count("*").alias("n"), F.sum(F.size("rows")).alias("n_rows"))


@query(
    """SELECT CAST(n_nationkey AS VARCHAR) AS name, 1 AS row, col, CASE col WHEN 0 THEN n_name WHEN 1 THEN 'a "b", c' || chr(10) || 'd' ELSE CAST(n_regionkey AS VARCHAR) END AS text FROM nation, (VALUES (0), (1), (2)) v(col)
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 0, col, CASE col WHEN 0 THEN 'x' WHEN 1 THEN '' ELSE 'y ' END FROM nation, (VALUES (0), (1), (2)) v(col)"""
)
def table_csv_round_trip(spark, sf_dir):
    """Tables as CSV files with a title line, quoted cells, line breaks within cells, and what a # cuts."""
    folder = _folder(spark, "tables")
    rows = F.array(F.array(F.lit("x"), F.lit(""), F.lit("y #z")), F.array(F.col("n_name"), F.lit('a "b", c\nd'), F.col("n_regionkey").cast("string")))
    made = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("csv_path"), F.concat(F.lit("t\n"), "n_name").alias("title"), rows.alias("rows"))
    _put(spark, {f"{folder}/{r['csv_path']}.csv": r["text"] for r in writers.export_tables(made).collect()})
    return readers.read_table_csv(spark, folder).select(F.regexp_extract("path", r"([0-9]+)\.csv$", 1).alias("name"), "row", "col", "text")


@query("SELECT n_nationkey AS id, [n_name] AS relevant_docs, n_regionkey + 0.5::DOUBLE AS answer FROM nation")
def answer_sink(spark, sf_dir):
    """Answers as JSON, written and read."""
    path = _folder(spark, "answers")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array("n_name").alias("relevant_docs"), (F.col("n_regionkey") + 0.5).alias("answer"))
    writers.write_answers(n, path)
    return spark.read.schema("id int, relevant_docs array<string>, answer double").json(path)


# --- intents


@query(
    r"""SELECT o_orderkey, array_to_string(list_sort(list_distinct(regexp_extract_all(q, '\b([A-Z]{3})\b', 1))), ',') AS codes FROM (SELECT o_orderkey, 'So FPT, ' || chr(CAST(65 + o_orderkey % 26 AS INT)) || 'BC và VIETJET (MBB) ' || o_orderpriority AS q FROM orders)"""
)
def code_scan(spark, sf_dir):
    """Q1: words of three capitals."""
    q = F.concat(F.lit("So FPT, "), F.char(65 + F.col("o_orderkey") % 26), F.lit("BC và VIETJET (MBB) "), "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(intent.uppercase_codes(q)), ",").alias("codes"))


_BROKERS = (
    ("FPT,FTS", "Chứng khoán FPT", "FTS"), ("MBB,MBS,VCB", "ctck MBS và VCB", "MBS,VCB"), ("FPT,FTS", "FPT là gì", "FPT,FTS"), ("BID,BSI,CTG,CTS", "chứng khoán", "BSI,CTS"), ("VCB", "chứng khoán", "VCB"), ("", "chứng khoán", ""),
)


@query(f"SELECT o_orderkey, {pick_sql('o_orderkey', *[b[2] for b in _BROKERS])} AS tickers FROM orders")
def broker_rule(spark, sf_dir):
    """Q4: a broker goes before, and its parent goes."""
    given, q = (pick(F.col("o_orderkey"), *[b[i] for b in _BROKERS]) for i in (0, 1))
    listed = F.filter(F.split(given, ","), lambda x: x != "")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(intent.resolve_brokers(listed, q), ",").alias("tickers"))


_UNDERSTOOD = (
    # question, tickers, years, scope, unit, factor x 1e12, percent, formula, codes, top_n
    ("ROE của công ty mẹ Alpha 2020-2022 (%)", "AAA", "2020,2021,2022", "separate", "đồng", 1e12, True, "ROE", "60,61,400,30", 4),
    ("Lãi tiền gửi của BBB năm 2019, bao nhiêu tỉ đồng?", "BBB", "2019", "consolidated", "tỷ đồng", 1e3, False, None, "21", 2),
    ("Tỷ lệ nợ của Alpha và Beta Group", "AAA,BBB", "", "consolidated", "đồng", 1e12, False, "debt_ratio", "300,270", 4),
    ("Xin chào", "", "", "consolidated", "đồng", 1e12, False, None, "", 2),
    ("Chi phí khác của Beta, trăm tỉ, 2005 đến 2020", "", "2005,2020", "consolidated", "trăm tỷ đồng", 10.0, False, None, "32", 4),
    ("Biên lợi nhuận gộp AAA 2021 nghìn tỉ", "AAA", "2021", "consolidated", "nghìn tỷ đồng", 1.0, False, "gross_margin", "20,10", 4),
)


def _told(i: int) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
    return f"CASE o_orderkey % {len(_UNDERSTOOD)} " + " ".join(f"WHEN {k} THEN {lit(u[i])}" for k, u in enumerate(_UNDERSTOOD)) + " END"


def _questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey"), *[u[0] for u in _UNDERSTOOD]).alias("question"))


def _aliases(spark) -> DataFrame:
    return spark.createDataFrame([("AAA", "AAA"), ("AAA", "Alpha"), ("BBB", "BBB"), ("BBB", "Beta Group")], "ticker string, alias string")


@query(
    f"""SELECT o_orderkey AS id, {_told(1)} AS tickers, {_told(2)} AS years, {_told(3)} AS report_type, {_told(4)} AS unit, round({_told(5)}::DOUBLE, 6) AS factor_e12, {_told(6)} AS is_percent, {_told(7)} AS formula, {_told(8)} AS codes, CAST({_told(9)} AS INT) AS top_n FROM orders"""
)
def understand(spark, sf_dir):
    """Q1 to Q15 together, Q12 and units among them: questions to intents."""
    i = intent.understand(_questions(spark, sf_dir), _aliases(spark))
    return i.select(
        "id", F.array_join("tickers", ",").alias("tickers"), F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), "report_type", "unit",
        F.round(F.col("scaling_factor") * 1e12, 6).alias("factor_e12"), "is_percent", "formula", F.array_join("codes", ",").alias("codes"), F.col("top_n").cast("int").alias("top_n"),
    )


_REPLIES = (
    ('```json\n{"target_metrics": ["Doanh thu", "Chi phí"], // as asked\n "formula": null}\n```', None, "Doanh thu|Chi phí", True), ('so {"target_metrics": ["X"], "formula": "ROE"} it is', "ROE", "X", True),
    ("no idea", None, "Lãi tiền gửi", False), ('{"target_metrics": [', None, "Lãi tiền gửi", False), ('{"other": 1}', None, "Lãi tiền gửi", False), (None, None, "Lãi tiền gửi", False),
)


@query(
    f"SELECT o_orderkey AS id, CASE o_orderkey % {len(_REPLIES)} {' '.join(f'WHEN {k} THEN ' + (repr(r[1]) if r[1] else 'NULL') for k, r in enumerate(_REPLIES))} END AS formula, "
    f"{pick_sql('o_orderkey', *[r[2] for r in _REPLIES])} AS metrics, o_orderkey % {len(_REPLIES)} < 2 AS by_reply FROM orders"
)
def provider_intents(spark, sf_dir):
    """A model's replies, read where they can be, else the rules."""
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("Lãi tiền gửi năm nay").alias("question"))
    reply = F.element_at(F.array(*[F.lit(r[0]) for r in _REPLIES]), (F.col("id") % len(_REPLIES) + 1).cast("int"))
    found = provider.metrics_of_replies(q, q.where(f"id % {len(_REPLIES)} <> {len(_REPLIES) - 1}").select("id", reply.alias("reply")))
    return found.select("id", "formula", F.array_join("metrics", "|").alias("metrics"), "by_reply")


@query(
    """SELECT doc_id, CASE WHEN trim(left(coalesce(text, ''), 384), ' ') <> '' THEN length(trim(left(text, 384), ' '))::DOUBLE END AS chars, CASE WHEN trim(left(coalesce(text, ''), 384), ' ') <> '' THEN (len(string_split(trim(left(text, 384), ' '), 'e')) - 1)::DOUBLE END AS es FROM documents"""
)
def embeddings_of_texts(spark, sf_dir):
    """Vectors of a model that is handed in, here the number of characters and of the letter e."""
    found = provider.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    return found.select("doc_id", F.get("vector", F.lit(0)).alias("chars"), F.get("vector", F.lit(1)).alias("es"))


@query(SQL["embeddings_of_texts"])
def stored_embeddings(spark, sf_dir):
    """The same from a table of vectors: benchmark texts, then documents are added; the last run's model knows nothing and is not asked."""
    path = f"{shared(spark)}/embeddings-{uuid.uuid4().hex}"
    model = lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    provider.embed_stored(table(spark, sf_dir, "benchmark").select("item_id", "text"), ["item_id"], model, "counts/1", path)
    provider.embed_stored(docs, ["doc_id"], model, "counts/1", path)
    found = provider.embed_stored(docs, ["doc_id"], lambda texts: [None for _ in texts], "counts/1", path)
    return found.select("doc_id", F.get("vector", F.lit(0)).alias("chars"), F.get("vector", F.lit(1)).alias("es"))


# --- retrieval


@query(
    f"""WITH {_CATALOG_SQL}, c AS (SELECT DISTINCT report_id, ticker, year FROM t),
ask AS (SELECT n_nationkey AS id, 'T' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ticker, CAST(2015 + n_nationkey % 8 AS INT) AS year, CASE WHEN n_nationkey % 2 = 0 THEN 'separate' ELSE 'consolidated' END AS scope FROM nation),
m AS (SELECT id, report_id, contains(report_id, scope) AS wanted FROM ask JOIN c ON c.ticker = ask.ticker AND (id % 3 = 0 OR c.year = ask.year))
SELECT id, string_agg(report_id, ',' ORDER BY report_id) AS docs FROM (SELECT *, bool_or(wanted) OVER (PARTITION BY id) AS met FROM m) WHERE wanted OR NOT met AND NOT contains(report_id, CASE WHEN id % 2 = 0 THEN 'consolidated' ELSE 'separate' END) GROUP BY id"""
)
def document_set(spark, sf_dir):
    """The reports that the filters leave, by question."""
    from .agent import documents_of

    k = F.col("n_nationkey")
    years = F.when(k % 3 == 0, F.array().cast("array<int>")).otherwise(F.array((2015 + k % 8).cast("int")))
    intents = table(spark, sf_dir, "nation").select(k.alias("id"), F.lit("?").alias("question"), F.array(_ticker(k)).alias("tickers"), years.alias("years"), F.when(k % 2 == 0, "separate").otherwise("consolidated").alias("report_type"))
    found = documents_of(cut(intents, "intents"), catalog(spark, sf_dir))
    return found.select("id", F.array_join("relevant_docs", ",").alias("docs"))


@query(
    """WITH p AS (SELECT p_partkey, lower(p_type) AS a, lower(p_brand) AS b, lower(p_name) AS c, 'size ' || p_size || ' brass' AS d FROM part),
q AS (SELECT DISTINCT id, token FROM (SELECT n_regionkey AS id, unnest(['brass', 'brand', 'size', 'steel', lower(r_name), 'ste', 'burnished']) AS token FROM nation JOIN region ON n_regionkey = r_regionkey)),
s AS (SELECT id, p_partkey, CASE WHEN contains(a, token) THEN 3.0::DOUBLE WHEN contains(b, token) THEN 2.0::DOUBLE WHEN contains(c, token) THEN 1.5::DOUBLE WHEN contains(d, token) THEN 1.0::DOUBLE END AS w FROM p, q)
SELECT id, p_partkey, sum(w) AS score FROM s WHERE w IS NOT NULL GROUP BY ALL"""
)
def lexical_fields(spark, sf_dir):
    """Four fields, each token by the best that holds it."""
    fields = (("context", F.col("p_type")), ("headers", F.col("p_brand")), ("items", F.col("p_name")), ("rest", F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" brass"))))
    texts = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.alias("text")) for f, c in fields])).alias("t")).select("p_partkey", "t.*")
    q = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.concat(F.lit("Brass, brand & size steel? "), F.lower("r_name"), F.lit(" ste BURNISHED of in")).alias("question"))
    return rank.lexical_scores(q, texts, ["p_partkey"])


_TYPES = ("Balance Sheet", "Income Statement", "Cash Flow Statement", "Notes", "Other/Details")
_BODIES = ("bảng cân đối kế toán", "Kết quả hoạt động kinh doanh", "KẾT QUẢ KINH DOANH và lưu chuyển tiền", "lưu chuyển tiền tệ", "thuyết minh", "")


@query(
    f"""WITH x AS (SELECT o_orderkey, {pick_sql('o_orderkey', *_TYPES)} AS t, {pick_sql('o_custkey', *_BODIES)} AS b FROM orders)
SELECT o_orderkey, CASE WHEN t = 'Balance Sheet' OR b = 'bảng cân đối kế toán' THEN 'BS' WHEN t = 'Income Statement' OR b ILIKE 'kết quả%' THEN 'IS' WHEN t = 'Cash Flow Statement' OR b ILIKE '%lưu chuyển tiền%' THEN 'CF' ELSE 'NOTE' END AS statement FROM x"""
)
def statement_tags(spark, sf_dir):
    """By type or text, in order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", rank.statement_type(pick(F.col("o_orderkey"), *_TYPES), pick(F.col("o_custkey"), *_BODIES)).alias("statement"))


_ASKED = (
    # question, metrics, what each statement gets
    ("Bao nhiêu?", ("Doanh thu thuần",), {"IS": 50, "BS": -30, "NOTE": -30}), ("Doanh thu thuần chi tiết", ("x",), {}), ("Tổng tài sản", ("x",), {"BS": 50, "IS": -30, "NOTE": -30}),
    ("Tổng tài sản chi tiết", ("dòng tiền",), {"CF": 100, "IS": -50, "BS": -50}), ("Chi phí khác", ("Doanh thu thuần",), {"NOTE": 60, "IS": -20, "BS": -20, "CF": -20}), ("Số nhân viên", ("x",), {}),
)
_KINDS = ("BS", "IS", "CF", "NOTE")


@query(
    "SELECT o_orderkey, CASE "
    + " ".join(f"WHEN o_orderkey % {len(_ASKED)} = {i} AND o_custkey % 4 = {k} THEN {gets.get(kind, 0)}.0::DOUBLE" for i, (_, _, gets) in enumerate(_ASKED) for k, kind in enumerate(_KINDS))
    + " END AS boost FROM orders"
)
def route_by_metrics(spark, sf_dir):
    """The question and its metrics choose the statement; the question alone rules a class out."""
    q = F.lower(pick(F.col("o_orderkey"), *[a[0] for a in _ASKED]))
    asked = F.concat_ws("\n", q, F.lower(pick(F.col("o_orderkey"), *["\n".join(a[1]) for a in _ASKED])))
    return table(spark, sf_dir, "orders").select("o_orderkey", rank.route_boost(q, asked, pick(F.col("o_custkey"), *_KINDS)).alias("boost"))


@query(
    f"""WITH {_CATALOG_SQL}, q AS (SELECT t.*, 'part ' || (SELECT min(CAST(split_part(label, ' ', 2) AS INT)) FROM i WHERE i.k = t.k) || ' & co' AS metric FROM t WHERE width > 2 AND j <= 3),
k AS (SELECT q.report_id, CAST(q.j AS INT) AS table_index, metric, coalesce(kind, 0) AS kind, q.c FROM q LEFT JOIN h USING (c, j))
SELECT report_id, table_index, CASE kind WHEN 4 THEN 'BS' WHEN 3 THEN 'IS' WHEN 2 THEN 'CF' ELSE 'NOTE' END AS statement,
  2.5::DOUBLE + 150 + CASE WHEN c % 3 = 0 THEN 200 ELSE 0 END + CASE WHEN c % 2 = 0 THEN 15 ELSE -15 END + CASE kind WHEN 4 THEN 50 WHEN 2 THEN 0 ELSE -30 END AS score FROM k"""
)
def rule_scores(spark, sf_dir):
    """R4, R5, R7 to R12, R21 together: one question a table, on its first label, with or without a code that it has."""
    c = catalog(spark, sf_dir).where("table_index <= 3 and size(headers) > 2")
    cust = F.regexp_extract("report_id", "[0-9]+", 0).cast("long")
    number = F.array_min(F.transform(F.filter("exact_metric_labels", lambda x: x.startswith("PART")), lambda x: F.regexp_extract(x, "[0-9]+", 0).cast("int")))
    codes = F.when(cust % 3 == 0, F.slice("account_codes_set", 1, 1)).otherwise(F.array().cast("array<string>"))
    rows = c.withColumns({"id": F.xxhash64("report_id", "table_index"), "question": F.lit("Tổng tài sản của công ty mẹ"), "metrics": F.array(F.concat(F.lit("Part "), number.cast("string"), F.lit(" & co"))), "codes": codes, "lexical": F.lit(2.5)})
    return rank.rule_scores(rows).select("report_id", "table_index", "statement", "score")


@query(
    f"""WITH {_PROBES}, s AS (SELECT id, vec_id, (vec_id % 7)::DOUBLE AS score FROM p, e), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS k FROM s QUALIFY k <= 5),
r AS (SELECT f.id, f.vec_id, round(f.score + 300 * CASE WHEN f.vec_id % 4 = 0 THEN 0 ELSE coalesce(list_cosine_similarity(qv, tv), 0) END, 4) AS score FROM f JOIN p USING (id) JOIN e USING (vec_id))
SELECT id, vec_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS rank FROM r QUALIFY rank <= 3"""
)
def dense_rerank(spark, sf_dir):
    """Five by score, then by score and vector, some without a vector; the first three."""
    e, probes = _probes(spark, sf_dir)
    ranked = e.select("vec_id").crossJoin(rank.small(probes.select("id"))).select("id", F.lit("r").alias("report_id"), F.col("vec_id").alias("table_index"), (F.col("vec_id") % 7).cast("double").alias("score"))
    vectors = e.where("vec_id % 4 <> 0").select(F.lit("r").alias("report_id"), F.col("vec_id").alias("table_index"), F.col("embedding").alias("tv"))
    found = rank.rerank(ranked, probes.select("id", "qv"), vectors, keep=5).where("rank <= 3")
    return found.select("id", F.col("table_index").alias("vec_id"), F.round("score", 4).alias("score"), "rank")


@query("SELECT p_partkey, 'Loại bảng: ' || p_type || ' | Ngữ cảnh: ' || p_name || ' | Cột: ' || p_brand || ' ' || p_size || ' | Mẫu:  | Chỉ tiêu: ' || p_name AS memory FROM part")
def table_memory(spark, sf_dir):
    """All that is told of a table; a preview that is missing is empty."""
    made = rank.memory_text(F.col("p_type"), F.col("p_name"), F.array("p_brand", F.col("p_size").cast("string")), F.lit(None).cast("string"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("memory"))


# --- lookup: an order is a table, as in the queries on cells


@query(
    f"""WITH {_ROWS}, f AS (SELECT id, row, 1 AS col FROM r WHERE code = id % 10 UNION ALL SELECT id, row, 2 FROM r WHERE quantity = id % 10),
c AS (SELECT id, arg_min(row, (col, row)) AS row FROM f GROUP BY id), w AS (SELECT id, arg_min(row, (NOT contains(label, CAST(id % 7 AS VARCHAR)), row)) AS row FROM r WHERE contains(label, CAST(id % 7 AS VARCHAR)) OR code = id % 7 GROUP BY id), o AS (SELECT DISTINCT id FROM r)
SELECT o.id, coalesce(r.quantity, 0)::DOUBLE AS value FROM o LEFT JOIN c USING (id) LEFT JOIN w USING (id) LEFT JOIN r ON r.id = o.id AND r.row = coalesce(c.row, w.row)"""
)
def get_val(spark, sf_dir):
    """L3: by code, else by keyword, the last column but one."""
    targets = _plans(spark, sf_dir).select("report_id", "table_index", (F.col("id") % 10).cast("string").alias("code"), (F.col("id") % 7).cast("string").alias("keyword"))
    return lookup.get_val(_cells(spark, sf_dir), targets).select(F.col("report_id").cast("long").alias("id"), "value")


@query(f"WITH {_ROWS} SELECT id, arg_min(code, row)::DOUBLE AS value FROM r GROUP BY id")
def first_parsable(spark, sf_dir):
    """The first number of the second column."""
    return lookup.first_parsable(_cells(spark, sf_dir), -1.0).select(F.col("report_id").cast("long").alias("id"), "value")


@query(
    f"""WITH {_ROWS}, m AS (SELECT id, arg_min(label, row) AS label FROM r WHERE price IS NOT NULL GROUP BY id)
SELECT m.id, round(arg_min(price, row), 2) AS value, 1.19::DOUBLE AS score FROM m JOIN r ON r.id = m.id AND r.label = m.label AND price IS NOT NULL GROUP BY m.id"""
)
def label_tier(spark, sf_dir):
    """The label that is most like the metric, here one that equals it."""
    cells = _cells(spark, sf_dir)
    priced = cells.where("col = 3 and num is not null").groupBy("report_id").agg(F.min("row").alias("row"))
    metrics = cells.where("col = 0").join(priced, ["report_id", "row"]).select(F.col("report_id").cast("long").alias("id"), F.upper("text").alias("metric"))
    roles = _plans(spark, sf_dir).select("report_id", "table_index", F.lit(0).alias("item_col"))
    plans = _plans(spark, sf_dir).withColumn("question", F.lit("?"))
    return lookup.by_label(plans, cells, roles, metrics).select("id", F.round("value", 2).alias("value"), F.round("score", 6).alias("score"))


_SAID = (
    # text, and what the metrics alpha, then beta give in it
    ("beta 7 tỷ\nalpha không rõ\nalpha lãi 1.5. Hết", 1.5), ("alpha lỗ –5 tỷ", -5e9), ("beta 2,500.75 triệu\rx", 2500.75e6), ("alpha 0 rồi 12 nghìn tỷ", 12e12), ("alpha 1.234.567 và 3 ngàn", 3000.0), ("không có gì 9", None), ("beta 7%\nALPHA -2", -2.0),
)


@query(
    f"SELECT o_orderkey AS id, v AS value FROM (SELECT o_orderkey, CASE o_orderkey % {len(_SAID)} "
    + " ".join(f"WHEN {k} THEN {v!r}::DOUBLE" for k, (_, v) in enumerate(_SAID) if v is not None)
    + " END AS v FROM orders) WHERE v IS NOT NULL"
)
def text_tier(spark, sf_dir):
    """The first line that holds a metric, by table, metric and line, and its number with a unit."""
    o = table(spark, sf_dir, "orders")
    key = [F.col("o_orderkey").cast("string").alias("report_id"), F.lit(1).alias("table_index")]
    plans = o.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("table_pos"), *key)
    metrics = o.select(F.col("o_orderkey").alias("id"), F.posexplode(F.array(F.lit("Alpha"), F.lit("beta"), F.lit("x"))).alias("metric_pos", "metric"))
    return lookup.by_text(plans, o.select(*key, pick(F.col("o_orderkey"), *[s for s, _ in _SAID]).alias("text")), metrics).select("id", "value")


def _planned(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """intents, ranked, cells, roles: one table a question, item, code and value in columns 0, 1 and 3."""
    p = _plans(spark, sf_dir)
    k = F.col("id")
    intents = p.select(
        "id", F.when(k % 5 == 0, "ROE").alias("formula"), F.array(F.when(k % 3 == 0, "khác (hẳn) một, hai ba").otherwise("Tổng tài sản cuối kỳ")).alias("metrics"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), (k % 10).cast("string"))).alias("codes"), F.lit(0.5).alias("scaling_factor"), (k % 2 == 0).alias("is_percent"),
    )
    roles = p.select("report_id", "table_index", F.lit(0).alias("item_col"), F.lit(1).alias("code_col"), F.lit(3).alias("value_col"))
    return intents, p.select("id", F.lit(1).alias("rank"), "report_id", "table_index"), _cells(spark, sf_dir), roles


@query(
    f"""WITH {_ROWS}, f AS (SELECT id, min(row) AS row FROM r WHERE code = id % 10 GROUP BY id)
SELECT id, 'df1' AS variable, CAST(row AS INT) AS row, CAST(id % 10 AS VARCHAR) AS code, 3 AS col, CASE WHEN id % 2 = 0 THEN 50.0::DOUBLE ELSE 0.5::DOUBLE END AS factor FROM f WHERE id % 5 <> 0 AND id % 3 <> 0 AND id % 4 <> 0"""
)
def code_plans(spark, sf_dir):
    """Plan records of standard metrics."""
    return plan.code_plans(*_planned(spark, sf_dir)).select("id", "variable", "row", "code", "col", "factor")


@query(
    f"""WITH {_ROWS}, q AS (SELECT DISTINCT id, CASE WHEN id % 4 = 0 THEN NULL ELSE CAST((id + 3) % 10 AS VARCHAR) END AS code, CASE WHEN id % 4 = 0 THEN 'part ' || (id % 9) END AS keyword FROM r),
v AS (SELECT q.id, arg_min(price, row) AS v FROM q JOIN r ON r.id = q.id AND price IS NOT NULL AND (CAST(r.code AS VARCHAR) = q.code OR contains(label, q.keyword)) GROUP BY q.id)
SELECT q.id, code, keyword, round(coalesce(v, 0) * CASE WHEN q.id % 2 = 0 THEN 50 ELSE 0.5::DOUBLE END, 4) AS value FROM q LEFT JOIN v USING (id)"""
)
def fallback_plans(spark, sf_dir):
    """What is read where nothing better is known, and its value."""
    intents, ranked, cells, roles = _planned(spark, sf_dir)
    k = F.col("id")
    intents = intents.withColumn("metrics", F.array(F.concat(F.lit(" (part)  "), (k % 9).cast("string"), F.lit("?")))).withColumn("codes", F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(((k + 3) % 10).cast("string"))))
    found = plan.run_fallbacks(plan.fallback_plans(intents, ranked, roles), cells)
    return found.select("id", "code", "keyword", F.round("value", 4).alias("value"))


@query(
    """SELECT o_orderkey, round(CAST(o_orderkey % 1000 AS DOUBLE) * 0.001::DOUBLE * CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 1 END, 6) AS answer,
  CASE o_orderkey % 3 WHEN 0 THEN 'float(1.5)' WHEN 1 THEN 'lookup(R, table ' || o_orderkey || ', code -) * 0.001' ELSE 'float(1.5)' END AS shown FROM orders"""
)
def answer_text(spark, sf_dir):
    """Rounding, and a plan to show for every answer."""
    k = F.col("o_orderkey")
    own = F.when(k % 3 == 1, answer.plan_text(F.lit("R"), k.cast("int"), F.lit(None).cast("string"), F.lit(0.001))).when(k % 3 == 2, F.lit("# FALLBACK"))
    return table(spark, sf_dir, "orders").select("o_orderkey", answer.scale((k % 1000).cast("double"), F.lit(0.001), k % 2 == 0).alias("answer"), answer.executable(own, F.lit(1.5)).alias("shown"))


# --- the whole way

_GOLD = (
    # question, report, tier, answer; of the kind of the labelled questions
    (1, "Lãi tiền gửi của công ty mẹ AAA năm 2018 là bao nhiêu triệu đồng?", "AAA_2018_separate", 208253.201298), (4, "Lợi nhuận sau thuế của Beta Group năm 2023 (tỷ đồng)", "BBB_2023", 444.917591),
    (9, "Chi phí khác của AAA năm 2023 theo triệu đồng", "AAA_2023_consolidated", 2949.600088), (10, "Biên lợi nhuận gộp của Beta Group năm 2023", "BBB_2023", 0.25), (11, "Chi phí khác đầu năm của AAA là bao nhiêu đồng", "AAA_2018_consolidated,AAA_2023_consolidated", 7000000.0),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{d}', {a!r}::DOUBLE)" for i, _, d, a in _GOLD) + ") v(id, docs, answer)")
def answers_end_to_end(spark, sf_dir):
    """From report texts and questions to answers: extraction, intents, filters, scores, the cascade, a ratio, units."""
    from .agent import answer_questions

    def report(name, ticker, year, title, rows):
        cells = [("Chỉ tiêu", "Mã số", f"31/12/{year}", "Số đầu năm"), *rows]
        return (name, ticker, year, f"===== PAGE 1 =====\n{title}\n<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in cells) + "</table>\n")

    income = "BÁO CÁO KẾT QUẢ HOẠT ĐỘNG KINH DOANH"
    made = [
        report("AAA_2018_separate", "AAA", 2018, income, [("Lãi tiền gửi", "21", "208.253.201.298", "1.000")]),
        report("AAA_2018_consolidated", "AAA", 2018, income, [("Lãi tiền gửi", "21", "5.000.000", "1.000")]),
        report("AAA_2023_consolidated", "AAA", 2023, income, [("12. Chi phí khác", "32", "2.949.600.088", "7.000.000")]),
        report("BBB_2023", "BBB", 2023, income, [("Doanh thu thuần", "10", "800", "640"), ("Lợi nhuận gộp", "20", "200", "1"), ("Lợi nhuận sau thuế", "60", "444.917.590.949", "2")]),
    ]
    reports_ = spark.createDataFrame(made, "report_id string, ticker string, year int, content string")
    questions = spark.createDataFrame([(i, q) for i, q, _, _ in _GOLD], "id int, question string")
    found = answer_questions(questions, cut(extract.build_catalog(reports_), "catalog"), _aliases(spark), reports_)
    return found.select("id", F.array_join("relevant_docs", ",").alias("docs"), F.round("answer", 6).alias("answer"))
