"""The operators over the driver's tables, each with the SQL that gives the same rows.

There are no reports among these tables: benchmark items stand for questions, documents for tables,
orders and their items for statements and cells. Every query runs over its whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, html, numeric, text, vectors
from ..operators import answer, evaluate, expressions, extract, filters, intent, lexical, lookup, rank, ratios, spans
from ..operators.cut import cut, shared

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, *texts: str) -> Column:
    """One of the texts by key modulo their number."""
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (key % len(texts) + 1).cast("int"))


def pick_sql(key: str, *texts: str) -> str:
    return "CASE " + key + f" % {len(texts)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"


def items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))


# --- ranking

_TOKENS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= {})"
_LEXICAL = f"""
q AS (SELECT item_id AS id, unnest(list_distinct({_TOKENS.format('text', 3)})) AS token FROM benchmark),
s AS (SELECT q.id, d.doc_id, CAST(count(*) AS DOUBLE) AS score FROM q JOIN documents d ON contains(lower(d.text), q.token) GROUP BY q.id, d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM s)"""


#: Where this process keeps the word index of a folder's documents, by session and folder.
_INDEXES: dict[tuple[str, str], str] = {}


def text_index(spark, sf_dir) -> lexical.Index:
    """The word index of documents, made once a session: keys (source, doc_id)."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _INDEXES:
        path = f"{shared(spark)}/word-index-{uuid.uuid4().hex}"
        lexical.write_segment(table(spark, sf_dir, "documents").select("source", "doc_id", F.lit("rest").alias("field"), "text"), path, ["source", "doc_id"])
        _INDEXES[known] = path
    return lexical.open_index(spark, _INDEXES[known])


def _lexical(spark, sf_dir) -> DataFrame:
    return lexical.best_lexical(text_index(spark, sf_dir), items(spark, sf_dir), ["doc_id"], 5).top


@query(f"WITH {_LEXICAL} SELECT id, doc_id, score, rank FROM r WHERE rank <= 5")
def lexical_topk(spark, sf_dir):
    return _lexical(spark, sf_dir)


@query(
    r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents),
n AS (SELECT count(*) AS n_docs, avg(len(ws)) AS mean_len FROM t),
q AS (SELECT id, token, count(*) AS times FROM (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, len, token, count(*) AS tf FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS token FROM t) WHERE token IN (SELECT token FROM q) GROUP BY ALL),
f AS (SELECT token, count(*) AS df FROM p GROUP BY token),
s AS (SELECT q.id, p.doc_id, round(sum(times * ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_len)))), 6) AS score
      FROM q JOIN f USING (token) JOIN p USING (token), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT id, doc_id, score, rank FROM r WHERE rank <= 5"""
)
def bm25_topk(spark, sf_dir):
    return lexical.best_bm25(text_index(spark, sf_dir), items(spark, sf_dir), ["doc_id"], 5).top


@query(SQL["bm25_topk"])
def bm25_topk_pruned(spark, sf_dir):
    """The same without reading the blocks that cannot hold a result."""
    return lexical.best_bm25(text_index(spark, sf_dir), items(spark, sf_dir), ["doc_id"], 5, prune=True).top


@query()
def index_blocks(spark, sf_dir):
    """How many blocks of the index each item's terms have, and how many bm25_topk_pruned reads."""
    return lexical.best_bm25(text_index(spark, sf_dir), items(spark, sf_dir), ["doc_id"], 5, prune=True).report


def _probes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("qv"), F.min("vec_id").alias("id")).drop("label")
    return e, first


_PROBES = "p AS (SELECT min(vec_id) AS id, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS qv FROM embeddings GROUP BY label), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS tv FROM embeddings)"


@query(
    f"""WITH {_PROBES}, s AS (SELECT id, vec_id, round(coalesce(list_cosine_similarity(qv, tv), 0), 6) AS score FROM p, e),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT id, vec_id, score, rank FROM r WHERE rank <= 5"""
)
def cosine_topk(spark, sf_dir):
    e, probes = _probes(spark, sf_dir)
    # one probe a label: a stated query set against all rows
    scored = e.crossJoin(rank.small(probes)).select("id", "vec_id", F.round(vectors.cosine("qv", "embedding"), 6).alias("score"))
    return rank.top_k(scored, ["id"], [F.desc("score"), F.col("vec_id")], 5)


@query(
    f"""WITH {_PROBES}, s AS (SELECT id, vec_id, round(list_dot_product(qv[1:8], tv[1:8]), 6) AS first, coalesce(list_cosine_similarity(qv, tv), 0) AS cos FROM p, e),
a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first DESC, vec_id) AS k FROM s QUALIFY k <= 20),
r AS (SELECT id, vec_id, first + 300 * cos AS score FROM a)
SELECT id, vec_id, round(score, 4) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS rank FROM r QUALIFY rank <= 5"""
)
def two_stage_rerank(spark, sf_dir):
    """rank.rerank() where the first stage is a score of its own, here of eight dimensions; its cut is the operator's meaning, not a search for the nearest vectors."""
    e, probes = _probes(spark, sf_dir)
    cheap = F.round(vectors.dot(F.slice("qv", 1, 8), F.slice("embedding", 1, 8)), 6)
    ranked = e.crossJoin(rank.small(probes)).select("id", F.lit("r").alias("report_id"), F.col("vec_id").alias("table_index"), cheap.alias("score"))
    both = rank.rerank(ranked, probes.select("id", "qv"), e.select(F.lit("r").alias("report_id"), F.col("vec_id").alias("table_index"), F.col("embedding").alias("tv")), keep=20)
    return both.where("rank <= 5").select("id", F.col("table_index").alias("vec_id"), F.round("score", 4).alias("score"), "rank")


@query(
    f"""WITH q AS (SELECT id, token, count(*) AS n FROM (SELECT item_id AS id, unnest({_TOKENS.format('text', 3)}) AS token FROM benchmark) GROUP BY ALL),
s AS (SELECT q.id, d.source, d.doc_id, CAST(sum(n) AS DOUBLE) AS score FROM q JOIN documents d ON contains(lower(d.text), q.token) GROUP BY ALL),
m AS (SELECT id, source AS report_id, max(score) AS score FROM s GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, report_id) AS rank FROM m QUALIFY rank <= 5"""
)
def doc_rank_max(spark, sf_dir):
    return lexical.best_documents(text_index(spark, sf_dir), items(spark, sf_dir), ["source"]).top.withColumnRenamed("source", "report_id")


_QUESTIONS = (
    "Doanh thu thuần của công ty mẹ năm 2020", "Lưu chuyển tiền thuần hợp nhất", "Lãi tiền gửi ngân hàng theo thuyết minh",
    "Tổng tài sản và hàng tồn kho", "Vay ngân hàng và hạn mức vay", "Nhân sự của doanh nghiệp",
)
_CONTEXTS = (
    "Bảng cân đối kế toán", "Kết quả hoạt động kinh doanh", "Báo cáo lưu chuyển tiền tệ",
    "Doanh thu hoạt động tài chính", "Vay và nợ thuê tài chính", "Đầu tư tài chính, góp vốn vào đơn vị khác", "Giao dịch với các bên liên quan",
)


@query(
    f"""WITH c AS (SELECT o_orderkey, {pick_sql('o_orderkey', *_QUESTIONS)} AS q, {pick_sql('o_custkey', *_CONTEXTS)} AS ctx, CASE WHEN o_orderkey % 3 = 0 THEN 'a_separate' ELSE 'a_consolidated' END AS rep FROM orders),
l AS (SELECT *, lower(q) AS lq, lower(ctx) AS lc,
  CASE WHEN ctx = 'Bảng cân đối kế toán' THEN 'BS' WHEN ctx = 'Kết quả hoạt động kinh doanh' THEN 'IS' WHEN ctx = 'Báo cáo lưu chuyển tiền tệ' THEN 'CF' ELSE 'NOTE' END AS statement FROM c)
SELECT o_orderkey, statement,
  CASE WHEN contains(lq, 'lãi tiền gửi') AND contains(lc, 'doanh thu hoạt động tài chính') THEN 100.0::DOUBLE WHEN contains(lq, 'vay ngân hàng') AND contains(lc, 'vay và nợ thuê tài chính') THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN contains(lq, 'lãi tiền gửi') AND contains(lc, 'đầu tư tài chính') THEN -100.0::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN contains(lc, 'giao dịch với các bên liên quan') THEN -100.0::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN contains(lq, 'doanh thu thuần') THEN CASE statement WHEN 'IS' THEN 50.0::DOUBLE WHEN 'CF' THEN 0.0::DOUBLE ELSE -30.0::DOUBLE END
         WHEN contains(lq, 'tổng tài sản') THEN CASE statement WHEN 'BS' THEN 50.0::DOUBLE WHEN 'CF' THEN 0.0::DOUBLE ELSE -30.0::DOUBLE END
         WHEN contains(lq, 'lưu chuyển tiền') THEN CASE statement WHEN 'CF' THEN 100.0::DOUBLE WHEN 'NOTE' THEN 0.0::DOUBLE ELSE -50.0::DOUBLE END
         WHEN contains(lq, 'lãi tiền gửi') OR contains(lq, 'hạn mức vay') THEN CASE statement WHEN 'NOTE' THEN 60.0::DOUBLE ELSE -20.0::DOUBLE END ELSE 0.0::DOUBLE END
  + CASE WHEN contains(lq, 'công ty mẹ') THEN CASE WHEN contains(rep, 'separate') THEN 15.0::DOUBLE ELSE -15.0::DOUBLE END
         WHEN contains(lq, 'hợp nhất') OR contains(lq, 'hn') THEN CASE WHEN contains(rep, 'consolidated') THEN 15.0::DOUBLE ELSE -15.0::DOUBLE END ELSE 0.0::DOUBLE END AS score
FROM l"""
)
def rule_score(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    q, c = F.lower(pick(F.col("o_orderkey"), *_QUESTIONS)), pick(F.col("o_custkey"), *_CONTEXTS)
    report = F.when(F.col("o_orderkey") % 3 == 0, "a_separate").otherwise("a_consolidated")
    rows = o.select("o_orderkey", q.alias("q"), F.lower(c).alias("c"), report.alias("r")).withColumn("statement", rank.statement_type(F.lit("Other/Details"), F.col("c")))
    score = rank.topic_boost(F.col("q"), F.col("c")) + rank.related_penalty(F.col("q"), F.col("c")) + rank.route_boost(F.col("q"), F.col("q"), F.col("statement")) + rank.scope_nudge(F.col("q"), F.col("r"))
    return rows.select("o_orderkey", "statement", score.alias("score"))


@query(
    """WITH p AS (SELECT p_partkey, lower(p_name) AS items, [upper(p_type), upper(p_brand)] AS labels, lower(p_name || ' ' || p_brand) AS context, ['brand#' || (p_partkey % 5 + 1), lower(split_part(p_name, ' ', 1))] AS metrics FROM part),
a AS (SELECT *, list_bool_or(list_transform(labels, lambda x: contains(lower(x), metrics[1]))) OR contains(items, metrics[1]) AS h1,
             list_bool_or(list_transform(labels, lambda x: contains(lower(x), metrics[2]))) OR contains(items, metrics[2]) AS h2 FROM p)
SELECT p_partkey, h1 OR (h2 AND length(metrics[2]) >= 4) AS hit,
  CASE WHEN h1 THEN 150.0::DOUBLE ELSE (CASE WHEN contains(context, metrics[1]) THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN length(metrics[2]) < 4 THEN 0.0::DOUBLE WHEN h2 THEN 150.0::DOUBLE WHEN contains(context, metrics[2]) THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END END AS score,
  CASE WHEN NOT (h1 OR (h2 AND length(metrics[2]) >= 4)) AND list_bool_or(list_transform(metrics, lambda m: list_bool_or(list_transform(string_split(m, ' '), lambda w: length(w) >= 3 AND contains(items, w))))) THEN -30.0::DOUBLE ELSE 0.0::DOUBLE END AS penalty
FROM a"""
)
def phrase_score(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    metrics = F.array(F.concat(F.lit("brand#"), (F.col("p_partkey") % 5 + 1).cast("string")), F.lower(F.substring_index("p_name", " ", 1)))
    low, context = F.lower("p_name"), F.lower(F.concat_ws(" ", "p_name", "p_brand"))
    rows = p.select("p_partkey", low.alias("i"), metrics.alias("m"), rank.phrase_boost(metrics, low, F.array(F.upper("p_type"), F.upper("p_brand")), context).alias("x"))
    return rows.select("p_partkey", "x.hit", "x.score", rank.fragment_penalty(F.col("m"), F.col("i"), F.col("x.hit")).alias("penalty"))


# --- numbers, texts, spans

_STYLES = ("plain", "english", "vietnamese", "negative", "percent", "text")


@query(
    r"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, l_returnflag FROM lineitem),
t AS (SELECT *, CASE (l_orderkey + l_linenumber) % 6
   WHEN 0 THEN CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
   WHEN 1 THEN format('{:,}', c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
   WHEN 2 THEN replace(format('{:,}', c // 100), ',', '.') || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')
   WHEN 3 THEN '(' || replace(format('{:,}', c), ',', '.') || ')'
   WHEN 4 THEN CAST(c % 100 AS VARCHAR) || ',5 %' ELSE l_returnflag || ' %' END AS raw FROM s),
b AS (SELECT *, raw LIKE '%\%' ESCAPE '\' AS pct, trim(regexp_replace(raw, '%$', '')) AS body FROM t),
d AS (SELECT *, body LIKE '(%)' OR body LIKE '-%' AS neg, CASE WHEN body LIKE '(%)' OR body LIKE '-%' THEN regexp_replace(body, '[()-]', '', 'g') ELSE body END AS dig FROM b),
k AS (SELECT *, length(dig) - length(replace(dig, '.', '')) AS dots, length(dig) - length(replace(dig, ',', '')) AS commas FROM d)
SELECT l_orderkey, l_linenumber, l_partkey, raw, CASE
   WHEN NOT regexp_matches(body, '^\s*\(?\s*-?\s*[\d.,]+\s*\)?\s*$') THEN body || CASE WHEN pct THEN '%' ELSE '' END
   ELSE (CASE WHEN neg THEN '-' ELSE '' END) || CASE
     WHEN dots > 0 AND commas > 0 AND strpos(dig, '.') > strpos(dig, ',') THEN replace(dig, ',', '')
     WHEN dots > 0 AND commas > 0 THEN replace(replace(dig, '.', ''), ',', '.')
     WHEN dots > 1 THEN replace(dig, '.', '') WHEN commas > 1 THEN replace(dig, ',', '')
     WHEN dots = 1 AND regexp_matches(dig, '\.\d{3}$') THEN replace(dig, '.', '')
     WHEN commas = 1 AND regexp_matches(dig, ',\d{3}$') THEN replace(dig, ',', '')
     ELSE replace(dig, ',', '.') END END AS number
FROM k"""
)
def normalize_number(spark, sf_dir):
    c = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole, rest = (c / 100).cast("decimal(20,2)"), F.lpad((c % 100).cast("string"), 2, "0")
    units = F.expr("cast(round(l_extendedprice * 100) as bigint) div 100")
    grouped = F.format_number(units, 0)
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    raw = (
        F.when(k == 0, F.concat(units.cast("string"), F.lit("."), rest))
        .when(k == 1, F.concat(grouped, F.lit("."), rest))
        .when(k == 2, F.concat(F.replace(grouped, F.lit(","), F.lit(".")), F.lit(","), rest))
        .when(k == 3, F.concat(F.lit("("), F.replace(F.format_number(c, 0), F.lit(","), F.lit(".")), F.lit(")")))
        .when(k == 4, F.concat((c % 100).cast("string"), F.lit(",5 %")))
        .otherwise(F.concat("l_returnflag", F.lit(" %")))
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return rows.withColumn("number", numeric.normalize_number("raw"))


_SPANS = r"""
m AS (SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(text, '[0-9]+') AS hits, string_split_regex(text, '[0-9]+') AS gaps FROM documents),
x AS (SELECT rid, doc_id, text, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM m),
y AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS stop FROM x)"""


@query(f"WITH {_SPANS} SELECT doc_id, stop - length(hit) AS start, stop, hit, 1 + length(text[1:stop - length(hit)]) - length(replace(text[1:stop - length(hit)], chr(10), '')) AS line FROM y")
def line_locator(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(spans.pattern_spans("text", "[0-9]+")).alias("s"))
    return d.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("stop"), "s.hit", F.col("s.line").cast("long").alias("line"))


@query(
    r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g'), chr(10)) AS ls FROM documents)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, array_to_string(ls[greatest(len(ls) - 2, 1):], chr(10)) AS context FROM s"""
)
def context_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(text.lines(text.strip("text"))).cast("long").alias("n_lines"), F.array_join(text.last_lines("text", 3), "\n").alias("context"))


@query(f"SELECT doc_id, sha256(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}')) AS plain FROM documents")
def strip_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.strip_accents("text"), 256).alias("plain"))


@query(
    """SELECT doc_id, length(text) < 50 OR len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) <= 2
  OR NOT contains(coalesce(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')[1], ''), ',')
  OR length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)::DOUBLE < 0.04 AS garbage FROM documents"""
)
def garbage_predicate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", filters.is_garbage("text").alias("garbage"))


@query(
    r"""WITH l AS (SELECT row_number() OVER () AS rid, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
n AS (SELECT *, list_transform(regexp_extract_all(line, '([-–]?[0-9]+([.,][0-9]+)*)', 1), lambda x: replace(replace(x, ',', ''), '–', '-')) AS xs FROM l)
SELECT doc_id, line_no, round(list_filter(list_transform(xs, lambda x: CASE WHEN regexp_matches(x, '^-?[0-9]+\.?[0-9]*$') THEN CAST(x AS DOUBLE) END), lambda v: v IS NOT NULL AND v <> 0)[1], 6) AS value
FROM n WHERE list_filter(list_transform(xs, lambda x: CASE WHEN regexp_matches(x, '^-?[0-9]+\.?[0-9]*$') THEN CAST(x AS DOUBLE) END), lambda v: v IS NOT NULL AND v <> 0)[1] IS NOT NULL"""
)
def free_text_number(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines("text")).alias("k", "line"))
    return d.select("doc_id", (F.col("k") + 1).cast("long").alias("line_no"), F.round(lookup.number_in_line(F.col("line")), 6).alias("value")).where("value is not null")


@query(
    r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li.*?>.*?</li>')) AS cell FROM pages)
SELECT page_id, count(*) AS n_cells, CAST(sum(length(trim(replace(replace(replace(regexp_replace(cell, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), ' '))) AS BIGINT) AS n_chars FROM c GROUP BY page_id"""
)
def html_text_cells(spark, sf_dir):
    """The pages' list items as one row of a table each, read by the grid builder."""
    items_ = F.array_join(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<li.*?>(.*?)</li>"), F.lit(1)), lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))), "")
    grids = table(spark, sf_dir, "pages").select("page_id", html.html_grid(F.concat(F.lit("<table><tr>"), items_, F.lit("</tr></table>"))).alias("grid"))
    cells = grids.select("page_id", F.explode(F.flatten("grid")).alias("cell"))
    return cells.groupBy("page_id").agg(F.count("*").alias("n_cells"), F.sum(F.length("cell")).alias("n_chars"))


_TITLES = ("Bảng cân đối kế toán", "Kết quả hoạt động kinh doanh", "Lưu chuyển tiền tệ", "Thuyết minh 5", "Khác")


@query(
    f"""WITH t AS (SELECT o_orderkey, {pick_sql('o_orderkey', *_TITLES)} || ' ' || o_orderpriority AS title FROM orders)
SELECT o_orderkey, CASE WHEN starts_with(title, 'Bảng') THEN 'Balance Sheet' WHEN starts_with(title, 'Kết') THEN 'Income Statement' WHEN starts_with(title, 'Lưu') THEN 'Cash Flow Statement' WHEN starts_with(title, 'Thuyết') THEN 'Notes' ELSE 'Other/Details' END AS table_type FROM t"""
)
def classify_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", extract.table_type(F.concat_ws(" ", pick(F.col("o_orderkey"), *_TITLES), "o_orderpriority")).alias("table_type"))


# --- intents

_ASKED = ("tính theo tỷ đồng", "bao nhiêu tỉ đồng", "nghìn tỉ", "trăm tỉ đồng", "nghìn tỷ đồng", "trăm tỷ", "triệu đồng", "trăm triệu", "nghìn đồng", "bao nhiêu tỷ", "bao nhiêu phần trăm", "tăng 5%")


@query(
    f"""WITH q AS (SELECT o_orderkey, {pick_sql('o_orderkey', *_ASKED)} AS q FROM orders)
SELECT o_orderkey, CASE q WHEN 'tính theo tỷ đồng' THEN 'tỷ đồng' WHEN 'bao nhiêu tỉ đồng' THEN 'tỷ đồng' WHEN 'nghìn tỉ' THEN 'nghìn tỷ đồng' WHEN 'nghìn tỷ đồng' THEN 'nghìn tỷ đồng' WHEN 'trăm tỉ đồng' THEN 'trăm tỷ đồng' WHEN 'trăm tỷ' THEN 'trăm tỷ đồng'
         WHEN 'triệu đồng' THEN 'triệu đồng' WHEN 'trăm triệu' THEN 'trăm triệu đồng' WHEN 'nghìn đồng' THEN 'nghìn đồng' ELSE 'đồng' END AS unit,
       CASE q WHEN 'tính theo tỷ đồng' THEN 1e-9 WHEN 'bao nhiêu tỉ đồng' THEN 1e-9 WHEN 'nghìn tỉ' THEN 1e-12 WHEN 'trăm tỉ đồng' THEN 1e-11 WHEN 'nghìn tỷ đồng' THEN 1e-12 WHEN 'trăm tỷ' THEN 1e-11 WHEN 'triệu đồng' THEN 1e-6 WHEN 'trăm triệu' THEN 1e-8 WHEN 'nghìn đồng' THEN 1e-3 ELSE 1.0 END::DOUBLE * 1e9::DOUBLE AS scale_e9,
       q IN ('bao nhiêu phần trăm', 'tăng 5%') AS percent FROM q"""
)
def unit_scale(spark, sf_dir):
    q = pick(F.col("o_orderkey"), *_ASKED)
    return table(spark, sf_dir, "orders").select("o_orderkey", numeric.unit_name(q).alias("unit"), (numeric.unit_scale(q) * 1e9).alias("scale_e9"), numeric.is_percent(q).alias("percent"))


@query(
    """WITH y AS (SELECT o_orderkey, year(o_orderdate) + 15 AS a, year(o_orderdate) + 15 + o_orderkey % 14 - 2 AS b FROM orders),
r AS (SELECT *, CASE WHEN abs(a - b) <= 10 THEN range(least(a, b), greatest(a, b) + 1) ELSE list_sort([a, b]) END AS ys FROM y)
SELECT o_orderkey, array_to_string(ys, ',') AS years FROM r"""
)
def year_expand(spark, sf_dir):
    a = F.year("o_orderdate") + 15
    sign = pick(F.col("o_orderkey"), "-", " đến ", "–", " tới ")
    q = F.concat(F.lit("từ năm "), a.cast("string"), sign, (a + F.col("o_orderkey") % 14 - 2).cast("string"), F.lit("?"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(intent.years_of(q), lambda y: y.cast("string")), ",").alias("years"))


_ALIASES = (("T1", "the"), ("T2", "of the"), ("T3", "que"), ("T4", "la que"), ("T5", "und"), ("T6", "and the"), ("T7", "de la"), ("T8", "la"))
_ALIAS_SQL = (
    "a AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{a}')" for t, a in _ALIASES) + ") v(ticker, alias)),\n"
    r"m AS (SELECT d.doc_id AS id, d.text, a.ticker, a.alias, regexp_extract(lower(d.text), '(?s)^(.*?(?:^|[^\p{L}\p{N}]))' || a.alias || '(?:$|[^\p{L}\p{N}])', 1) AS before, regexp_matches(lower(d.text), '(?:^|[^\p{L}\p{N}])' || a.alias || '(?:$|[^\p{L}\p{N}])') AS met FROM documents d, a),"
    "\ns AS (SELECT id, ticker, alias, length(before) AS start, length(before) + length(alias) AS stop FROM m WHERE met)"
)


def _alias_rows(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"))
    found = intent.alias_matches(q, spark.createDataFrame(list(_ALIASES), "ticker string, alias string"))
    return found.withColumns({"start": F.col("start").cast("long"), "stop": F.col("stop").cast("long")})


@query(f"WITH {_ALIAS_SQL} SELECT * FROM s")
def alias_scan(spark, sf_dir):
    return _alias_rows(spark, sf_dir)


@query(f"WITH {_ALIAS_SQL} SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.id = s.id AND o.start <= s.start AND o.stop >= s.stop AND o.stop - o.start > s.stop - s.start)")
def nested_suppression(spark, sf_dir):
    return intent.outermost(_alias_rows(spark, sf_dir))


#: question, formula, codes of its metrics
_METRICS = (
    ("ROE của công ty", "ROE", "60,200,30,400,60"), ("Biên lợi nhuận gộp", "gross_margin", "20,10"), ("Lãi tiền gửi năm nay", None, "21"),
    ("Lợi nhuận sau thuế", None, "60,200,30"), ("Chi phí khác bao nhiêu", None, "32"), ("vốn lưu động thuần", "net_working_capital", "150,310"),
    ("Vòng quay tổng tài sản", "asset_turnover", "10"), ("Số lượng nhân viên", None, ""),
)


@query(
    f"""WITH q AS (SELECT o_orderkey AS id, {pick_sql('o_orderkey', *[m[0] for m in _METRICS])} AS q FROM orders)
SELECT id, CASE q {' '.join(f"WHEN '{q}' THEN '{f}'" for q, f, _ in _METRICS if f)} END AS formula, CASE q {' '.join(f"WHEN '{q}' THEN '{c}'" for q, _, c in _METRICS)} END AS codes FROM q"""
)
def metric_codes(spark, sf_dir):
    q = pick(F.col("o_orderkey"), *[m[0] for m in _METRICS])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), intent.metrics_of(q).alias("m"))
    each = rows.select("id", F.col("m.formula").alias("formula"), F.posexplode("m.metrics").alias("pos", "metric"))
    coded = intent.codes_of(each, intent.code_dimension(spark))
    listed = coded.groupBy("id", "formula").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "codes"))), lambda x: x["codes"])).alias("codes"))
    return listed.select("id", "formula", F.array_join("codes", ",").alias("codes"))


@query(
    f"""WITH q AS (SELECT o_orderkey, {pick_sql('o_orderkey', 'roe năm nay', 'doanh thu', 'hệ số thanh toán', 'bctc riêng')} AS q, o_orderkey % 5 AS ny, o_custkey % 4 AS nt FROM orders)
SELECT o_orderkey, CASE WHEN contains(q, 'bctc riêng') THEN 'separate' ELSE 'consolidated' END AS scope,
  CAST(least(CASE WHEN contains(q, 'roe') OR contains(q, 'thanh toán') THEN 4 WHEN ny > 1 THEN greatest(4, 2 * ny) WHEN nt > 1 THEN greatest(4, 2 * nt) ELSE 2 END, 5) AS BIGINT) AS top_n FROM q"""
)
def quota_scope(spark, sf_dir):
    q = pick(F.col("o_orderkey"), "roe năm nay", "doanh thu", "hệ số thanh toán", "bctc riêng")
    return table(spark, sf_dir, "orders").select("o_orderkey", intent.scope_of(q).alias("scope"), intent.quota(q, F.col("o_orderkey") % 5, F.col("o_custkey") % 4).cast("long").alias("top_n"))


# --- filters

_INTENTS = "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN ['F', 'O'] WHEN 1 THEN ['P'] ELSE [] END AS tickers, CASE n_nationkey % 4 WHEN 0 THEN [1995] WHEN 2 THEN [1996, 1997] ELSE [] END AS years FROM nation"


@query(
    f"""WITH i AS ({_INTENTS}), c AS (SELECT o_orderstatus AS ticker, year(o_orderdate) AS year, o_totalprice FROM orders)
SELECT id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM i JOIN c ON (len(tickers) = 0 OR list_contains(tickers, ticker)) AND (len(years) = 0 OR list_contains(years, year)) GROUP BY id"""
)
def hard_filter(spark, sf_dir):
    k = F.col("n_nationkey")
    none_s, none_i = F.array().cast("array<string>"), F.array().cast("array<int>")
    tickers = F.when(k % 4 == 0, F.array(F.lit("F"), F.lit("O"))).when(k % 4 == 1, F.array(F.lit("P"))).otherwise(none_s)
    years = F.when(k % 4 == 0, F.array(F.lit(1995))).when(k % 4 == 2, F.array(F.lit(1996), F.lit(1997))).otherwise(none_i)
    intents = table(spark, sf_dir, "nation").select(k.alias("id"), F.lit("consolidated").alias("report_type"), tickers.alias("tickers"), years.alias("years"))
    catalog = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("ticker"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return filters.hard_filter(intents, catalog).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"))


@query(
    """WITH a AS (SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS any_f FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus FROM a WHERE CASE WHEN any_f = 1 THEN o_orderstatus = 'F' ELSE o_orderstatus <> 'O' END"""
)
def prefer_fallback(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return filters.prefer(o, ["o_custkey"], F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")


@query("SELECT p_partkey AS code FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def semi_valid_codes(spark, sf_dir):
    one = [F.lit("r").alias("report_id"), F.lit(1).alias("table_index")]
    targets = table(spark, sf_dir, "part").select(F.lit(1).alias("id"), *one, F.col("p_partkey").cast("string").alias("code"))
    cells = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(*one, F.col("l_partkey").cast("string").alias("text"))
    return filters.valid_codes(targets, cells).select(F.col("code").cast("long").alias("code"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_unused(spark, sf_dir):
    one = [F.lit("r").alias("report_id"), F.lit(1).alias("table_index")]
    targets = table(spark, sf_dir, "part").select(F.lit(1).alias("id"), *one, F.col("p_partkey").cast("string").alias("code"))
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(*one, F.col("l_partkey").cast("string").alias("text"))
    return filters.missing_codes(targets, used).select(F.col("code").cast("long").alias("p_partkey"))


@query(
    """SELECT p_partkey, CASE WHEN lower(p_type) = m THEN 2 WHEN length(m) >= 5 AND contains(lower(p_type), m) THEN 1 ELSE 0 END AS score
FROM (SELECT *, lower(split_part(p_type, ' ', CAST(p_partkey % 3 + 1 AS INT))) AS m FROM part)"""
)
def metric_in_label(spark, sf_dir):
    m = F.split_part("p_type", F.lit(" "), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", filters.metric_in_labels(m, F.array("p_type")).alias("score"))


@query("SELECT c_custkey, CASE WHEN n_regionkey <= 2 THEN n_name ELSE '' END AS company_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def dim_lookup_default(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_regionkey <= 2").select(F.col("n_nationkey").alias("ticker"), F.col("n_name").alias("company_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("ticker"))
    return extract.with_names(rows, names).select("c_custkey", "company_name")


# --- neighbours

_EVENTS = "e AS (SELECT * FROM events)"


@query(
    f"""WITH {_EVENTS}, m AS (SELECT user_id, ts, max(event_id) AS mark FROM e WHERE event_type = 'signup' GROUP BY ALL)
SELECT p.event_id, p.user_id, coalesce(m.mark, -1) AS mark FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.ts >= m.ts"""
)
def marker_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    marks = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("mark"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return spans.asof(left, marks, ["user_id"], "ts", "ts", "mark", default=-1).drop("ts")


_ISLANDS = f"""{_EVENTS}, l AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS starts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM l)"""


def _islands(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return spans.chains(e.withColumn("same", F.coalesce(F.lag("event_type").over(w) == F.col("event_type"), F.lit(False))), ["user_id"], ["ts", "event_id"], F.col("same"))


@query(f"WITH {_ISLANDS} SELECT user_id, chain, event_type, count(*) AS n, arg_min(event_id, (ts, event_id)) AS head FROM c GROUP BY ALL")
def chain_islands(spark, sf_dir):
    return _islands(spark, sf_dir).groupBy("user_id", "chain", "event_type").agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("head"))


@query(
    f"""WITH {_ISLANDS}, h AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, chain ORDER BY ts, event_id) AS head, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM c),
t AS (SELECT user_id, rank, CASE WHEN head <> event_id THEN [user_id || '|' || event_id, user_id || '|' || head] ELSE [user_id || '|' || event_id] END AS ts FROM h)
SELECT user_id AS id, count(DISTINCT tag) AS n_tags, sha256(string_agg(DISTINCT tag, ',' ORDER BY tag)) AS tags FROM (SELECT user_id, unnest(ts) AS tag FROM t) GROUP BY user_id"""
)
def tags_with_parent(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    head = F.first("event_id").over(Window.partitionBy("user_id", "chain").orderBy("ts", "event_id"))
    rows = _islands(spark, sf_dir).select(F.col("user_id").alias("id"), F.row_number().over(w).alias("rank"), F.col("user_id").cast("string").alias("report_id"), F.col("event_id").alias("start_line"), head.alias("parent_table_start_line"))
    found = rank.tags(rows)
    return found.select("id", F.size("relevant_tables").cast("long").alias("n_tags"), F.sha2(F.array_join(F.array_sort("relevant_tables"), ","), 256).alias("tags"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_returnflag, l_linestatus, CAST(CAST(l_quantity AS INT) % 3 AS VARCHAR)] AS a FROM lineitem),
p AS (SELECT *, lag(a) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(((a[1] = b[1])::INT + (a[2] = b[2])::INT + (a[3] = b[3])::INT) / 3::DOUBLE, 6) AS share FROM p"""
)
def header_repeat_ratio(spark, sf_dir):
    own = F.array("l_returnflag", "l_linestatus", (F.col("l_quantity").cast("int") % 3).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", own.alias("a"))
    before = F.lag("a").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return rows.withColumn("b", before).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(extract.similar_header(F.col("a"), F.col("b")), 6).alias("share"))


@query(
    """WITH g AS (SELECT l_orderkey, list(CAST(l_suppkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey) AS c0, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey) AS c1, list(CAST(l_linenumber AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey) AS c2 FROM lineitem GROUP BY l_orderkey),
c AS (SELECT l_orderkey, list_filter(list_concat(list_concat(c0, c1), c2), lambda x: length(x) <= 4) AS cs FROM g)
SELECT l_orderkey, array_to_string(list_sort(list_distinct(cs)), ',') AS codes, cs[1] AS first_code, CAST(list_min(list_transform(cs, lambda x: CAST(x AS INT))) AS BIGINT) AS min_code, CAST(list_max(list_transform(cs, lambda x: CAST(x AS INT))) AS BIGINT) AS max_code FROM c"""
)
def code_profile(spark, sf_dir):
    row = F.array(*[F.col(c).cast("string") for c in ("l_suppkey", "l_partkey", "l_linenumber")])
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("r")))).alias("x"))
    codes = rows.select("l_orderkey", extract.account_codes(F.transform("x", lambda e: e["r"])).alias("c"))
    summary = extract.scope_summary(F.col("c"), F.col("c"))
    return codes.select("l_orderkey", F.array_join(F.array_sort("c"), ",").alias("codes"), F.get("c", F.lit(0)).alias("first_code"), summary["min_code"].cast("long").alias("min_code"), summary["max_code"].cast("long").alias("max_code"))


@query(
    f"""WITH {_EVENTS}, m AS (SELECT *, event_type = 'error' AS hit, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id FROM m WHERE k <= 5 OR k > n - 2 OR hit OR before = 'error' OR after = 'error'"""
)
def table_excerpt(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return lookup.excerpt(e, ["user_id"], "at", F.col("event_type") == "error").select("user_id", "event_id")


@query("SELECT a.l_orderkey AS report_id, a.l_linenumber AS first, b.l_linenumber AS second FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")
def split_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("table_index")).distinct()
    return lookup.split_pairs(rows)


# --- cells: an order is a table, its items are rows of (label, code, quantity, price)


def _cells(spark, sf_dir) -> DataFrame:
    # dealt out by report_id once, as what follows for a table is
    row = F.row_number().over(Window.partitionBy("report_id").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    cents = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    own = F.array(F.concat(F.lit("part "), F.col("l_partkey").cast("string")), (F.col("l_suppkey") % 10).cast("string"), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linestatus") == "O", F.lit("-")).otherwise(cents))
    line = table(spark, sf_dir, "lineitem").withColumn("report_id", F.col("l_orderkey").cast("string"))
    rows = line.select("report_id", F.lit(1).alias("table_index"), row.alias("row"), own.alias("r"))
    return rows.select("report_id", "table_index", "row", F.posexplode("r").alias("col", "text")).withColumn("num", numeric.to_number("text"))


_ROWS = "r AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS row, 'part ' || l_partkey AS label, l_suppkey % 10 AS code, CAST(l_quantity AS INT) AS quantity, CASE WHEN l_linestatus = 'O' THEN NULL ELSE round(l_extendedprice, 2) END AS price FROM lineitem)"


def _plans(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return o.select(F.col("l_orderkey").alias("id"), F.lit(1).alias("table_pos"), F.col("l_orderkey").cast("string").alias("report_id"), F.lit(1).alias("table_index"), F.lit(3).alias("val_col"))


@query(
    f"""WITH {_ROWS}, l AS (SELECT id, row, 1 AS col FROM r WHERE code = id % 10 UNION ALL SELECT id, row, 2 FROM r WHERE quantity = id % 10),
f AS (SELECT *, min(col) OVER (PARTITION BY id) AS m FROM l)
SELECT id, CAST(row AS INT) AS row, col FROM f WHERE col = m"""
)
def row_by_code(spark, sf_dir):
    targets = _plans(spark, sf_dir).select("report_id", "table_index", (F.col("id") % 10).cast("string").alias("code"))
    found = lookup.rows_by_code(_cells(spark, sf_dir), targets)
    return found.select(F.col("report_id").cast("long").alias("id"), "row", "col")


@query(
    f"""WITH {_ROWS}, t1 AS (SELECT id, arg_min(price, row) AS value FROM r WHERE code = id % 10 AND price IS NOT NULL
     AND true GROUP BY id), o AS (SELECT DISTINCT id FROM r),
q AS (SELECT id, min(quantity) IS NOT NULL AND bool_or(code = id % 10) AS coded FROM r GROUP BY id),
t2 AS (SELECT id, arg_min(CASE WHEN code <> 0 THEN code ELSE NULL END, row) AS c, arg_min(quantity, row) FILTER (quantity <> 0) AS qn FROM r GROUP BY id),
w AS (SELECT id, arg_min(v, (col, row)) AS value FROM (SELECT id, row, 1 AS col, CAST(code AS DOUBLE) AS v FROM r UNION ALL SELECT id, row, 2, quantity FROM r UNION ALL SELECT id, row, 3, price FROM r) WHERE v IS NOT NULL AND v <> 0 GROUP BY id)
SELECT o.id, round(coalesce(t1.value, w.value, 0), 2) AS value, CASE WHEN t1.value IS NOT NULL THEN 1 WHEN w.value IS NOT NULL THEN 2 ELSE 0 END AS tier
FROM o LEFT JOIN t1 USING (id) LEFT JOIN w USING (id)"""
)
def cascade(spark, sf_dir):
    """Tier 1: the price of the first row with the code; tier 2: the first number but 0."""
    cells, plans = _cells(spark, sf_dir), _plans(spark, sf_dir)
    # codes stand in column 1 here; quantities of the same text are no codes
    coded = cells.where("col <> 2")
    codes = plans.select("id", F.lit(0).alias("code_pos"), (F.col("id") % 10).cast("string").alias("code"))
    none = [F.lit(None).cast("string").alias("report_id"), F.lit(None).cast("int").alias("table_index")]
    found = lookup.cascade(
        plans.select("id"),
        lambda ids: lookup.by_code(plans.join(ids, "id", "left_semi"), coded, codes),
        lambda ids: lookup.first_nonzero(plans.join(ids, "id", "left_semi"), cells).select("id", "value", *none),
    )
    return found.select("id", F.round("value", 2).alias("value"), "tier")


@query(
    f"""WITH {_ROWS}, w AS (SELECT id, arg_min(v, (col, row)) AS value FROM (SELECT id, row, 1 AS col, CAST(code AS DOUBLE) AS v FROM r UNION ALL SELECT id, row, 2, quantity FROM r UNION ALL SELECT id, row, 3, price FROM r) WHERE v IS NOT NULL AND v <> 0 GROUP BY id)
SELECT id, round(value, 2) AS value FROM w"""
)
def first_nonzero(spark, sf_dir):
    return lookup.first_nonzero(_plans(spark, sf_dir), _cells(spark, sf_dir)).select("id", F.round("value", 2).alias("value"))


_HEADS = ("Số đầu năm", "31/12/2020", "Năm trước", "2019", "Ghi chú")
_PERIODS = ("số đầu năm là bao nhiêu", "số cuối năm 2020", "giá trị năm 2019", "giá trị")


@query(
    f"""WITH t AS (SELECT o_orderkey AS id, {pick_sql('o_orderkey', *_PERIODS)} AS q, {pick_sql('o_orderkey', *_HEADS)} AS h2, {pick_sql('o_custkey', *_HEADS)} AS h3 FROM orders),
k AS (SELECT *, contains(q, 'đầu năm') AS opening, h2 IN ('Số đầu năm', 'Năm trước') AS p2, h3 IN ('Số đầu năm', 'Năm trước') AS p3, h2 = '31/12/2020' AS c2, h3 = '31/12/2020' AS c3,
  (contains(q, '2020') AND contains(h2, '2020')) OR (contains(q, '2019') AND contains(h2, '2019')) AS y2, (contains(q, '2020') AND contains(h3, '2020')) OR (contains(q, '2019') AND contains(h3, '2019')) AS y3 FROM t)
SELECT id, CASE WHEN opening AND (p2 OR p3) THEN CASE WHEN p3 THEN 3 ELSE 2 END WHEN y3 AND NOT opening THEN 3 WHEN y2 AND NOT opening THEN 2 WHEN c3 THEN 3 WHEN c2 THEN 2 ELSE 3 END AS val_col FROM k"""
)
def period_router(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    head = F.array(F.lit("Chỉ tiêu"), F.lit("Mã số"), pick(F.col("o_orderkey"), *_HEADS), pick(F.col("o_custkey"), *_HEADS))
    key = [F.col("o_orderkey").cast("string").alias("report_id"), F.lit(1).alias("table_index")]
    cells = o.select(*key, F.lit(0).alias("row"), F.posexplode(head).alias("col", "text"))
    asked = o.select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey"), *_PERIODS).alias("question"), *key)
    return lookup.value_column(cells, lookup.column_roles(cells), asked).select("id", "val_col")


@query(
    """WITH p AS (SELECT p_partkey, lower(p_name) AS l, list_filter(string_split(lower(p_type), ' '), lambda w: length(w) > 1) AS ws FROM part)
SELECT p_partkey, round(len(list_filter(ws, lambda w: contains(l, w))) / len(ws)::DOUBLE, 6) AS coverage FROM p"""
)
def token_label_coverage(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(fuzzy.word_coverage("p_name", "p_type"), 6).alias("coverage"))


@query()
def fuzzy_ratio(spark, sf_dir):
    """Each part's name against the next's of its brand."""
    after = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", after.alias("other")).where("other is not null")
    return rows.select("p_partkey", F.round(fuzzy.sequence_ratio("p_name", "other"), 9).alias("ratio"))


# --- ratios

_FACT_CELLS = [(s, c) for s, cs in ratios.CODES.items() for c in cs] + [("IS", "61")]


def _facts(spark, sf_dir) -> DataFrame:
    k = (F.col("o_orderkey") % len(_FACT_CELLS) + 1).cast("int")
    at = F.element_at(F.array(*[F.struct(F.lit(s).alias("sheet"), F.lit(c).alias("code")) for s, c in _FACT_CELLS]), k)
    cur = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("report_id"), at["sheet"].alias("sheet"), at["code"].alias("code"), F.col("o_orderkey").alias("row"), cur.alias("cur"), (cur * 0.9).alias("prev"))


def _ratio_sql() -> str:
    first = lambda s, c, v="cur": f"arg_min({v}, row) FILTER (sheet = '{s}' AND code = '{c}') AS {s}_{c}_{v}"
    cells = ", ".join([first(s, c) for s, cs in ratios.CODES.items() for c in cs] + [first("IS", "10", "prev"), "arg_min(cur, row) FILTER (sheet = 'IS' AND code IN ('60', '61')) AS np"])
    case = f"CASE o_orderkey % {len(_FACT_CELLS)} " + " ".join(f"WHEN {i} THEN ['{s}', '{c}']" for i, (s, c) in enumerate(_FACT_CELLS)) + " END"
    n = lambda x: f"coalesce({x}, 0)"
    over = lambda a, b: f"({a}) / nullif(coalesce({b}, 1), 0)"
    b = lambda c: f"BS_{c}_cur"
    i = lambda c: f"IS_{c}_cur"
    cf = lambda c: f"CF_{c}_cur"
    exprs = {
        "ROE": over(n("np"), b(400)), "ROA": over(n(i(60)), b(270)), "gross_margin": over(n(i(20)), i(10)), "net_margin": over(n(i(60)), i(10)),
        "debt_to_equity": over(n(b(300)), b(400)), "equity_to_assets": over(n(b(400)), b(270)), "current_ratio": over(n(b(100)), b(310)),
        "quick_ratio": over(f"{n(b(100))} - {n(b(140))}", b(310)), "interest_coverage": over(f"{n(i(50))} + {n(i(23))}", i(23)),
        "cfo_to_short_debt": over(n(cf(20)), b(310)), "days_inventory": over(n(b(140)), i(11)) + " * 365",
        "accrual_ratio": over(f"{n(i(60))} - ({n(cf(20))} + {n(cf(30))})", b(270)), "revenue_growth": over(f"{n(i(10))} - {n('IS_10_prev')}", "IS_10_prev"),
        "cfo_margin": over(n(cf(20)), i(10)), "net_working_capital": f"{n(b(100))} - {n(b(310))}", "asset_turnover": over(n(i(10)), b(270)),
        "sga_intensity": over(f"{n(i(25))} + {n(i(26))}", i(10)), "debt_ratio": over(n(b(300)), b(270)), "earnings_conversion": over(n(cf(20)), i(60)),
    }
    return (
        f"WITH f AS (SELECT o_custkey % 200 AS report_id, ({case})[1] AS sheet, ({case})[2] AS code, o_orderkey AS row, o_totalprice AS cur, o_totalprice * 0.9::DOUBLE AS prev FROM orders),\n"
        f"p AS (SELECT report_id, {cells} FROM f GROUP BY report_id)\nSELECT report_id, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in exprs.items()) + " FROM p"
    )


@query(_ratio_sql())
def financial_ratios(spark, sf_dir):
    found = ratios.ratios(_facts(spark, sf_dir))
    return found.select("report_id", *[F.round(r.name, 6).alias(r.name) for r in ratios.RATIOS])


@query(
    """WITH y AS (SELECT o_orderstatus, year(o_orderdate) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL),
l AS (SELECT *, lag(total) OVER (PARTITION BY o_orderstatus ORDER BY year) AS prev FROM y)
SELECT o_orderstatus, CAST(year AS INT) AS year, round((total - coalesce(prev, 0)) / nullif(coalesce(prev, 1), 0), 6) AS growth FROM l"""
)
def growth_yoy(spark, sf_dir):
    """Revenue growth of the ratio registry, a status and year being a report; without a year before the numerator counts."""
    years = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("cur"))
    prev = F.lag("cur").over(Window.partitionBy("o_orderstatus").orderBy("year"))
    facts = years.withColumns({"prev": prev, "sheet": F.lit("IS"), "code": F.lit("10"), "row": F.lit(1)})
    return ratios.ratios(facts, ["o_orderstatus", "year"]).select("o_orderstatus", "year", F.round("revenue_growth", 6).alias("growth"))


# --- evaluation and packaging

_GOLD = "g AS (SELECT b.item_id AS id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark, sf_dir) -> DataFrame:
    """(id, doc_id): documents that hold a whole item. The items are a stated query set against all documents."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("needle"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rank.holding(d, b, "doc_id")


_SETS = f"""{_LEXICAL}, {_GOLD}, p AS (SELECT id, list(doc_id) AS predicted FROM r WHERE rank <= 5 GROUP BY id), h AS (SELECT id, list(doc_id) AS gold FROM g GROUP BY id),
b AS (SELECT i.item_id AS id, coalesce(predicted, []) AS predicted, coalesce(gold, []) AS gold FROM benchmark i LEFT JOIN p ON p.id = i.item_id LEFT JOIN h ON h.id = i.item_id),
v AS (SELECT id, CASE WHEN len(predicted) = 0 THEN 0 ELSE len(list_intersect(predicted, gold)) / len(predicted)::DOUBLE END AS precision, CASE WHEN len(gold) = 0 THEN 0 ELSE len(list_intersect(predicted, gold)) / len(list_distinct(gold))::DOUBLE END AS recall FROM b),
f AS (SELECT *, CASE WHEN 4 * precision + recall = 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall) END AS f2 FROM v)"""


def _sets(spark, sf_dir) -> DataFrame:
    predicted = _lexical(spark, sf_dir).groupBy("id").agg(F.collect_list("doc_id").alias("predicted"))
    gold = _gold(spark, sf_dir).groupBy("id").agg(F.collect_list("doc_id").alias("gold"))
    return evaluate.prf2(items(spark, sf_dir).select("id").join(predicted, "id", "left").join(gold, "id", "left"))


@query(f"WITH {_SETS} SELECT id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f2, 6) AS f2 FROM f")
def retrieval_prf2(spark, sf_dir):
    return _sets(spark, sf_dir).select("id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f2")])


@query(f"WITH {_SETS} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f2), 6) AS macro_f2, count(*) AS n FROM f")
def retrieval_macro(spark, sf_dir):
    return evaluate.macro(_sets(spark, sf_dir)).select(*[F.round(f"macro_{c}", 6).alias(f"macro_{c}") for c in ("precision", "recall", "f2")], "n")


@query(
    f"""WITH {_LEXICAL}, {_GOLD}, h AS (SELECT r.id, 1.0::DOUBLE / min(rank) AS rr FROM r JOIN g USING (id, doc_id) WHERE rank <= 5 GROUP BY r.id)
SELECT round(avg(coalesce(rr, 0)), 6) AS mrr, count(*) AS n FROM (SELECT DISTINCT id FROM g) LEFT JOIN h USING (id)"""
)
def retrieval_mrr5(spark, sf_dir):
    ranked = _lexical(spark, sf_dir).withColumnRenamed("doc_id", "key")
    return evaluate.mrr(ranked, _gold(spark, sf_dir).withColumnRenamed("doc_id", "key")).select(F.round("mrr", 6).alias("mrr"), "n")


@query(
    """WITH a AS (SELECT o_orderkey, o_totalprice AS g, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice * (1 + (o_orderkey % 5) * 0.005::DOUBLE) END AS a FROM orders)
SELECT count(*) AS n, round(avg(CASE WHEN abs(a - g) <= 0.01::DOUBLE * greatest(abs(a), abs(g)) THEN 1 ELSE 0 END), 6) AS accuracy FROM a"""
)
def answer_tolerance(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    gold = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("answer"))
    answers = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 5) * 0.005)).alias("answer"))
    return evaluate.accuracy(gold, answers).select("n", F.round("accuracy", 6).alias("accuracy"))


_RANKED = f"WITH {_LEXICAL}, t AS (SELECT r.id, r.doc_id, source AS report_id, rank FROM r JOIN documents USING (doc_id) WHERE rank <= 5)"


def _ranked(spark, sf_dir) -> DataFrame:
    sources = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("report_id"))
    found = _lexical(spark, sf_dir).join(sources, "doc_id")
    return found.select("id", "report_id", F.col("doc_id").alias("table_index"), (F.col("doc_id") + 100).alias("start_line"), "rank", F.format_string("%s_table_%d.csv", "report_id", "doc_id").alias("csv_path"))


@query(f"{_RANKED} SELECT id, string_agg('df' || rank || '=' || report_id || '_table_' || doc_id || '.csv', ';' ORDER BY rank) AS evidence FROM t GROUP BY id")
def evidence_list(spark, sf_dir):
    found = answer.evidence(_ranked(spark, sf_dir))
    return found.select("id", F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["variable"], e["csv_path"])), ";").alias("evidence"))


@query(
    f"""{_RANKED}, u AS (SELECT * FROM t WHERE doc_id % 2 = 0), k AS (SELECT * FROM u UNION ALL SELECT * FROM t WHERE id NOT IN (SELECT id FROM u))
SELECT id, doc_id AS table_index, row_number() OVER (PARTITION BY id ORDER BY rank) AS rank FROM k"""
)
def evidence_pruned(spark, sf_dir):
    ranked = cut(_ranked(spark, sf_dir), "ranked")  # searched once: five rows an item
    return answer.prune(ranked, ranked.where("table_index % 2 = 0")).select("id", "table_index", "rank")


@query(f"{_RANKED} SELECT id, string_agg(report_id || '|' || (doc_id + 100), ';' ORDER BY rank) AS by_line, string_agg(report_id || '|' || doc_id, ';' ORDER BY rank) AS by_index FROM t GROUP BY id")
def dual_export(spark, sf_dir):
    found = answer.dual_export(_ranked(spark, sf_dir))
    return found.select("id", F.array_join("by_line", ";").alias("by_line"), F.array_join("by_index", ";").alias("by_index"))


@query(f"{_RANKED} SELECT DISTINCT report_id || '_table_' || doc_id || '.csv' AS csv_path FROM t")
def packaging_paths(spark, sf_dir):
    from ..sources.writers import packaged_paths

    return packaged_paths(answer.evidence(_ranked(spark, sf_dir)))


# --- names, variants, summaries

_NAMES = (("roe", "ROE"), ("gross_margin of the year", "gross_margin"), ("margin", "gross_margin"), ("Current_Ratio", "current_ratio"), ("xyz", None), ("debt", "debt_to_equity"))


@query(
    f"""WITH n AS (SELECT DISTINCT {pick_sql('o_orderkey', *[n for n, _ in _NAMES])} || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' ' END AS name FROM orders)
SELECT name, CASE trim(name) {' '.join(f"WHEN '{n}' THEN '{f}'" for n, f in _NAMES if f and n not in ('roe', 'margin', 'debt'))} WHEN 'roe' THEN CASE WHEN name = 'roe' OR contains(name, 'roe') THEN 'ROE' END
  WHEN 'margin' THEN CASE WHEN name = 'margin' THEN 'gross_margin' END WHEN 'debt' THEN CASE WHEN name = 'debt' THEN 'debt_to_equity' END END AS formula FROM n"""
)
def formula_names(spark, sf_dir):
    name = F.concat(pick(F.col("o_orderkey"), *[n for n, _ in _NAMES]), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(" "))
    names = table(spark, sf_dir, "orders").select(name.alias("name")).distinct()
    return intent.resolve_formula(spark, names, [r.name for r in ratios.RATIOS])


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 2 END AS n_variants, CASE WHEN c_nationkey % 3 = 0 THEN c_name ELSE 'T' || c_nationkey || ' ' || (2000 + c_nationkey) || ' ' || c_name END AS last FROM customer"""
)
def query_variants(spark, sf_dir):
    named = F.col("c_nationkey") % 3 != 0
    tickers = F.when(named, F.array(F.concat(F.lit("T"), F.col("c_nationkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    years = F.when(named, F.array(2000 + F.col("c_nationkey"))).otherwise(F.array().cast("array<int>"))
    found = table(spark, sf_dir, "customer").select("c_custkey", rank.query_variants(F.col("c_name"), tickers, years).alias("v"))
    return found.select("c_custkey", F.size("v").alias("n_variants"), F.element_at("v", -1).alias("last"))


@query(
    """SELECT p_partkey, 'Báo cáo: ' || p_brand || ' | Loại: ' || p_type || ' | Ngữ cảnh: ' || p_name || ' | Tiêu đề: ' || p_brand || ' ' || p_size || ' | Chỉ tiêu: ' || substr(repeat(p_name || ' ', 20), 1, 150) AS summary FROM part"""
)
def table_summary(spark, sf_dir):
    headers = F.array("p_brand", F.col("p_size").cast("string"))
    text_ = rank.summary_text(F.col("p_brand"), F.col("p_type"), F.col("p_name"), headers, F.repeat(F.concat("p_name", F.lit(" ")), 20))
    return table(spark, sf_dir, "part").select("p_partkey", text_.alias("summary"))


def _formula_texts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A text for each order, the table of its items that it names, and the cells: label, line number, quantity. By the key modulo 6 the text is right (0) or has to be mended."""
    at = F.row_number().over(Window.partitionBy("report_id").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    line = table(spark, sf_dir, "lineitem").withColumn("report_id", F.col("l_orderkey").cast("string")).select("report_id", F.lit(1).alias("table_index"), at.alias("row"), "l_partkey", "l_linenumber", "l_quantity")
    each = F.array(
        F.struct(F.lit(0).alias("col"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"), F.lit(None).cast("double").alias("num")),
        F.struct(F.lit(1).alias("col"), F.col("l_linenumber").cast("string").alias("text"), F.col("l_linenumber").cast("double").alias("num")),
        F.struct(F.lit(2).alias("col"), F.col("l_quantity").cast("string").alias("text"), F.col("l_quantity").alias("num")),
    )
    cells = line.select("report_id", "table_index", "row", F.explode(each).alias("c")).select("report_id", "table_index", "row", "c.*")
    key = F.col("o_orderkey")
    text_ = F.when(key % 6 == 0, _formula(key)).when(key % 6 == 1, "float(df1[df1['1'] == '99']['2'].values[0])").when(key % 6 == 2, "__import__('os').getcwd()").when(key % 6 == 3, "get_val(df8, '1')").otherwise("2 / (1 - 1)")
    texts = table(spark, sf_dir, "orders").select(key.cast("string").alias("id"), text_.alias("text"))
    frames = texts.select("id", F.lit("df1").alias("variable"), F.col("id").alias("report_id"), F.lit(1).alias("table_index"))
    return texts, frames, cells


def _formula(key: Column) -> Column:
    return F.concat(F.lit("float(df1[df1['1'].astype(str).str.strip() == '1']['2'].values[0]) * 2 + "), (key % 7).cast("string"))


@query(
    """WITH f AS (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) = 1)
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 6 < 5 THEN l_quantity * 2 + o_orderkey % 7 END AS value,
       CAST(CASE WHEN o_orderkey % 6 < 5 AND l_orderkey IS NOT NULL THEN o_orderkey % 6 ELSE 4 END AS INT) AS attempt,
       CASE WHEN o_orderkey % 6 = 5 THEN 'division by zero' WHEN l_orderkey IS NULL THEN 'no such row' END AS error
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey"""
)
def formula_correction(spark, sf_dir):
    """Formulas given as text; a model mends those of keys that are 1 to 4 modulo 6 at that attempt."""
    texts, frames, cells = _formula_texts(spark, sf_dir)
    key = F.col("id").cast("long")
    mend = lambda failed: failed.where(key % 6 == F.col("attempt")).select("id", _formula(key).alias("text"))
    return expressions.corrected(texts, frames, cells, mend).select("id", "value", "attempt", "error")
