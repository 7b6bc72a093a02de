"""Secret scans by ownership over the whole corpus, in DataFrame functions only.

Patterns propose candidates in every text. The hashes of their values are aggregated over the
corpus: by how many repositories and owners is each value used? A value that many owners have is a
copied example; one that few have, and that looks random, is taken for live. Owners decide, as one
owner may use a live value in many repositories; how many these are is told beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, table
from .spans import Kind, all_spans, base_digest, count_of, having, places_of, rebuilt, span_sql, strays, told

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    Kind("assign", ASSIGN, "", lambda h, _: F.length(F.regexp_extract(h, ASSIGN, 1)) >= 8, lambda h: F.regexp_extract(h, ASSIGN, 1)),
    # a match of these that is too short holds no later start that is long enough, so the length stands in the pattern
    Kind("access", r"AKIA[A-Z0-9]{12,}+", "AKIA"),
    Kind("hex", r"[0-9a-f]{32,}+"),
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", "gh"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
    Kind("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN "),
)
BASE, ASSIGNED, PEM = 3, 0, 5
#: A private key to its END or to the end of the text, whose group 1 is the body; one with fewer characters of base64 than KEY_CHARS holds no key.
BLOCK, KEY_CHARS = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----([\s\S]*?)(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|\z)", 16
#: From so many owners on a value counts as copied; shorter values, and those of one character class, don't look live.
WIDE, LIVE_CHARS = 3, 16


def looks_live(value: Column) -> Column:
    low = F.lower(value)
    return (F.length(value) >= LIVE_CHARS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~low.rlike("example|changeme|xxxx|1234567890123456")


#: Assigned values that are no secrets whoever has them, in lower case: placeholders, references to a variable, the words themselves, one character over and over.
PLACEHOLDER = (
    r"example|changeme|change[_-]me|placeholder|redacted|xxxx|1234567890123456|^12345678(?:9|90)?$|^your|^-----begin$|^(.)\1*$"
    r"|^(?:password|passwd|secret|token|api_?key|undefined|required|optional|disabled)[0-9]*$|^(?:os|process|env|self|this|config|settings|request|params)\."
)


def looks_secret(span: Column) -> Column:
    """Whether a span's value is redacted if it has few owners: one of a kind with a fixed format is, an assigned one unless it is a placeholder."""
    return (span["place"] != ASSIGNED) | ~F.lower(span["value"]).rlike(PLACEHOLDER)


def key_bodies(text: Column) -> Column:
    """The bodies of private keys in a text, without the white space around them."""
    bodies = F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1)), lambda b: F.btrim(b, F.lit(" \t\r\n")))
    some = F.filter(bodies, lambda b: F.length(F.regexp_replace(b, "[^A-Za-z0-9+/]", "")) >= KEY_CHARS)
    return F.when(F.contains(text, F.lit("PRIVATE KEY-----")), some).otherwise(F.array().cast("array<string>"))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with secrets: array<struct(start, place, end, value, score)>; a column of that name is replaced.

    Null and empty texts have none. Row by row; other columns pass through.
    """
    return df.withColumn("secrets", all_spans(F.col(text_col), KINDS))


def ownership(candidates: DataFrame, wide: int = WIDE) -> DataFrame:
    """candidates (hash, repo, owner) to (hash, n_repos, n_owners, copied).

    Null repositories and owners count as one each. Duplicates are first met on the map side, then
    by (hash, repo, owner), so a value that a third of the corpus holds shrinks before it is shuffled.
    """
    distinct = candidates.select("hash", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner")).distinct()
    by_repo = distinct.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_repo.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners")).withColumn("copied", F.col("n_owners") >= wide)


def judge(df: DataFrame, repo: Column, owner: Column, text_col: str = "text", wide: int = WIDE, whole: bool = False) -> DataFrame:
    """Per row of df (its columns but the text): secrets, n_copied, n_live (distinct values), max_owners, max_repos (of its most common value, 0 without), live (their values).

    A live value is one with fewer than ``wide`` owners that looks random; the rest are copied or
    weak. ``whole``: values that aren't looks_secret() are left out, the bodies of private keys are
    values, and all values with fewer than ``wide`` owners are live. Rows that repeat stay. An empty
    table gives an empty one. Columns of df named secrets, n_copied, n_live, max_owners, max_repos, live,
    row_id, repo_, owner_, values_ and bodies_ are replaced or dropped.
    """
    kept = [c for c in df.columns if c not in (text_col, "secrets", "n_copied", "n_live", "max_owners", "max_repos", "live", "row_id", "repo_", "owner_", "values_", "bodies_")]
    found = scan(df.withColumns({"repo_": repo.cast("string"), "owner_": owner.cast("string")}), text_col).select(*kept, "repo_", "owner_", "secrets", *([key_bodies(F.col(text_col)).alias("bodies_")] if whole else []))
    values = F.array_distinct(F.transform(F.filter("secrets", lambda s: (s["place"] != PEM) & (looks_secret(s) if whole else F.lit(True))), lambda s: s["value"]))
    if whole:
        values = F.array_union(values, "bodies_")
    looks = F.lit(True) if whole else looks_live(F.col("value"))
    # the id is written with the row, so it stays what it is
    rows = materialize(found.withColumn("values_", values).withColumn("row_id", F.monotonically_increasing_id()), "secret-rows")
    each = rows.select("row_id", "repo_", "owner_", F.explode("values_").alias("value")).withColumn("hash", F.sha2("value", 256))
    owned = ownership(each.select("hash", F.col("repo_").alias("repo"), F.col("owner_").alias("owner")), wide)
    judged = (
        each.join(owned, "hash")
        .groupBy("row_id")
        .agg(
            F.count_if("copied").alias("n_copied"),
            F.max("n_owners").alias("max_owners"),
            F.max("n_repos").alias("max_repos"),
            F.sort_array(F.collect_list(F.when(~F.col("copied") & looks, F.col("value")))).alias("live"),
        )
    )
    some = rows.where(F.size("values_") > 0).join(judged, "row_id").select(*kept, "secrets", "n_copied", F.size("live").cast("long").alias("n_live"), "max_owners", "max_repos", "live")
    none = rows.where(F.size("values_") == 0).select(*kept, "secrets", F.lit(0).cast("long").alias("n_copied"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("max_owners"), F.lit(0).cast("long").alias("max_repos"), F.array().cast("array<string>").alias("live"))
    return some.unionByName(none)


#: Up to so many live values are each sought in their whole text; of more, only those that may stand elsewhere than where they were found.
FEW = 16
#: Texts in which none of KINDS can find a value don't match this.
HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|gh[pousr]_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{8}|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"""


def redact_live(docs: DataFrame, mark: str = "[SECRET]", wide: int = WIDE) -> DataFrame:
    """docs (documents' columns) with every live value replaced by mark wherever it stands in its text, n_chars with it.

    The places of the values are put together and the text is rebuilt from what lies between them, so
    of values that overlap, or that begin or lie in one another, nothing is left. Only the texts that
    may hold a value are shuffled, keyed by doc_id and the text's hash; rows that are equal in these
    get equal texts. Texts without secrets pass unchanged, null ones too. The owner is the column
    source, the repository source/lang. Columns of any other name pass through.
    """
    maybe = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    k_id, k_hash, k_chars, live_ = (fresh(n, docs.columns) for n in ("k_id", "k_hash", "k_chars", "live_"))
    keyed = docs.where(maybe).withColumns({k_id: F.col("doc_id"), k_hash: F.xxhash64("text"), k_chars: F.length("text")})
    live = (
        judge(keyed.select(F.col(k_id).alias("k_id"), F.col(k_hash).alias("k_hash"), F.col(k_chars).alias("k_chars"), "source", "lang", "text"), F.concat_ws("/", "source", "lang"), F.col("source"), wide=wide, whole=True)
        .where("n_live > 0")
        .select(F.col("k_id").alias("l_id"), F.col("k_hash").alias("l_hash"), F.col("k_chars").alias("l_chars"), F.col("live").alias(live_))
        .dropDuplicates(["l_id", "l_hash", "l_chars"])
    )
    same = keyed[k_id].eqNullSafe(live["l_id"]) & (keyed[k_hash] == live["l_hash"]) & (keyed[k_chars] == live["l_chars"])
    met = keyed.join(live, same, "left").select(*[keyed[c] for c in docs.columns], live[live_])
    text, found = F.col("text"), F.col(live_)
    place = lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), F.lit(mark).alias("mark"))
    there = lambda v: F.transform(places_of(text, v), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mark).alias("mark")))
    spans_, seek_, marks_, text_ = (fresh(n, docs.columns) for n in ("spans_", "seek_", "marks_", "text_"))
    some = lambda c: F.when(found.isNotNull(), c)
    # step by step, as Spark resolves so deep an expression in so many rounds only
    changed = met.withColumn(spans_, some(all_spans(text, KINDS)))
    changed = changed.withColumn(spans_, some(having(F.col(spans_), found)))
    changed = changed.withColumn(seek_, F.when(F.size(found) <= FEW, found).otherwise(some(strays(text, F.col(spans_), found))))
    changed = changed.withColumn(marks_, some(F.concat(F.transform(spans_, place), F.flatten(F.transform(seek_, there)))))
    changed = changed.withColumn(text_, F.when(found.isNotNull(), rebuilt(text, F.col(marks_))).otherwise(text))
    changed = changed.withColumn("n_chars", F.when(found.isNotNull(), F.length(text_).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col(text_))
    return docs.where(~maybe).unionByName(changed.select(*docs.columns))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    s = F.col("secrets")
    return judge(docs, F.concat_ws("/", "source", "lang"), F.col("source")).select(
        "doc_id",
        *[count_of(s, i).alias(f"n_{k.name}") for i, k in enumerate(KINDS[:BASE])],
        base_digest(s, KINDS, BASE).alias("base_sha256"),
        told(s, KINDS).alias("spans"),
        "n_copied",
        "n_live",
        "max_owners",
        "max_repos",
    )


def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pipeline's secrets stage makes of all documents."""
    return redact_live(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


_WORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _WORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_GROUP = "regexp_extract(hit, '{}', 2)".format(_ASSIGN.replace("'", "''"))
_KINDS_SQL = [
    ("assign", _ASSIGN, f"length({_GROUP}) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "length(hit) >= 16"),
    ("hex", "[0-9a-f]+", "length(hit) >= 32"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
]
OP5_SQL = (
    "WITH"
    + span_sql(_KINDS_SQL)
    + f""",
v AS (SELECT DISTINCT rid, CASE place WHEN 0 THEN {_GROUP} ELSE hit END AS value FROM y WHERE place <> 5),
o AS (SELECT value, count(DISTINCT coalesce(source, '')) AS n_owners, count(DISTINCT concat(source, chr(10), concat_ws('/', source, lang))) AS n_repos FROM v JOIN d USING (rid) GROUP BY value),
w AS (SELECT rid, max(n_owners) AS max_owners, max(n_repos) AS max_repos, count(*) FILTER (n_owners >= {WIDE}) AS n_copied,
             count(*) FILTER (n_owners < {WIDE} AND length(value) >= {LIVE_CHARS} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
                              AND NOT regexp_matches(lower(value), 'example|changeme|xxxx|1234567890123456')) AS n_live
      FROM v JOIN o USING (value) GROUP BY rid),
g AS (SELECT rid, {', '.join(f"count(*) FILTER (place = {i}) AS n_{k.name}" for i, k in enumerate(KINDS[:BASE]))},
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < {BASE}) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM y GROUP BY rid)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS[:BASE])},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live, coalesce(max_owners, 0) AS max_owners, coalesce(max_repos, 0) AS max_repos
FROM d LEFT JOIN g USING (rid) LEFT JOIN w USING (rid)
"""
)

# values of few owners, where they stand, with what overlaps put together
_NO_SECRET = PLACEHOLDER.replace(r"|^(.)\1*$", "").replace("(?:", "(")
REDACTION_SQL = (
    "WITH"
    + span_sql(_KINDS_SQL)
    + f""",
r_p AS (SELECT rid, e, CASE place WHEN 0 THEN {_GROUP} ELSE hit END AS value FROM y WHERE place <> 5
      AND (place <> 0 OR NOT (regexp_matches(lower({_GROUP}), '{_NO_SECRET}') OR replace(lower({_GROUP}), left(lower({_GROUP}), 1), '') = ''))),
r_k AS (SELECT rid, unnest(list_transform(regexp_extract_all(text, '{BLOCK}', 1), lambda b: trim(b, E' \\t\\r\\n'))) AS value FROM d WHERE contains(text, 'PRIVATE KEY-----')),
r_v AS (SELECT DISTINCT rid, value FROM (SELECT rid, value FROM r_p UNION ALL SELECT rid, value FROM r_k WHERE length(regexp_replace(value, '[^A-Za-z0-9+/]', '', 'g')) >= {KEY_CHARS})),
r_o AS (SELECT value FROM r_v JOIN d USING (rid) GROUP BY value HAVING count(DISTINCT coalesce(source, '')) < {WIDE}),
r_g AS (SELECT rid, value, string_split(text, value) AS gaps FROM r_v JOIN r_o USING (value) JOIN d USING (rid)),
r_h AS (SELECT rid, value, unnest(gaps[1:len(gaps) - 1]) AS gap, unnest(range(1, len(gaps))) AS i FROM r_g),
r_s AS (SELECT rid, CAST(sum(length(gap) + length(value)) OVER (PARTITION BY rid, value ORDER BY i) AS BIGINT) AS e, length(value) AS n FROM r_h
      UNION ALL SELECT rid, e, length(value) AS n FROM r_p JOIN r_o USING (value)),
r_m AS (SELECT rid, e - n AS s, e, max(e) OVER (PARTITION BY rid ORDER BY e - n, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM (SELECT DISTINCT rid, e, n FROM r_s)),
r_r AS (SELECT *, sum(CASE WHEN upto IS NULL OR s >= upto THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT DISTINCT * FROM r_m)),
r_u AS (SELECT rid, part, min(s) AS s, max(e) AS e FROM r_r GROUP BY rid, part),
r_w AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS since FROM r_u),
r_x AS (SELECT rid, string_agg(substr(text, since + 1, s - since) || '[SECRET]', '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS clean FROM r_w JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CASE WHEN clean IS NULL THEN n_chars ELSE length(clean) END AS n_chars, sha256(coalesce(clean, text)) AS text_sha256 FROM d LEFT JOIN r_x USING (rid)
"""
)
