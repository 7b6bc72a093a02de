"""Ranking: documents and tables by questions.

Containment scores (a token counts if it is part of any word) are computed over distinct words:
tokens are joined with the vocabulary, not with texts, and the result meets the postings by equality.
That is exact because a token holds word characters only, and it shuffles words instead of texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import contains_any, strip, strip_accents, words
from ..functions.vectors import cosine
from .cut import cut

TOKEN_CHARS = 3
#: Dictionaries of no more than so many rows, of a word or two each, are broadcast.
BROADCAST_ROWS = 500_000
TOP_TABLES = 5
FIELD_WEIGHTS = {"context": 3.0, "headers": 2.0, "items": 1.5, "rest": 1.0}


def top_k(scored: DataFrame, keys: Sequence[str], order: Sequence[Column], k, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark keeps k rows a partition before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def query_tokens(questions: DataFrame, distinct: bool = True) -> DataFrame:
    """(id, token) of questions (id, question): words of three characters or more."""
    out = questions.select("id", F.explode(words("question", TOKEN_CHARS)).alias("token"))
    return out.distinct() if distinct else out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has no more than so many (short) rows; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def token_hits(tokens: DataFrame, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, field, token) for each text field that holds a token as part of a word; rows may repeat. Dealt out by keys.

    texts: (keys, field, text); tokens: (token). The containment join is between distinct tokens and
    the vocabulary; common words stand in it once. Its result is a dictionary of words, broadcast
    while it is small, so the texts' words aren't shuffled, only what they hit.
    """
    postings = texts.select(*keys, "field", F.explode(F.array_distinct(words("text"))).alias("word"))
    vocabulary = postings.select("word").distinct()
    wanted = tokens.select("token").distinct()
    # a token is looked up by its first characters in each word's substrings of that length
    grams = vocabulary.where(F.length("word") >= TOKEN_CHARS).select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - TOKEN_CHARS + 1), lambda i: F.substr(F.col("word"), i, F.lit(TOKEN_CHARS))))).alias("gram"))
    met = wanted.withColumn("gram", F.substring("token", 1, TOKEN_CHARS)).join(grams, "gram").where(F.contains(F.col("word"), F.col("token"))).select("token", "word").distinct()
    met = cut(met, "dictionary")
    return postings.join(small(met), "word").select(*keys, "field", "token").repartition(*keys)


def lexical_scores(questions: DataFrame, texts: DataFrame, keys: Sequence[str], weights: dict[str, float] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(id, keys, score): over a question's distinct tokens, the weight of the best field that holds it.

    With pairs (id, keys) only these are scored. Without, the questions' tokens come to the texts,
    which stay dealt out by keys, so that the pairs of all questions and texts are never shuffled:
    a top k that follows is cut in each partition first.
    """
    weights = FIELD_WEIGHTS if weights is None else weights
    tokens = query_tokens(questions)
    w = F.lit(1.0)
    for field, x in weights.items():
        w = F.when(F.col("field") == field, F.lit(float(x))).otherwise(w)
    if pairs is not None:
        pairs = pairs.select("id", *keys).distinct()
        texts = texts.join(pairs.select(*keys).distinct(), list(keys), "left_semi")
        best = token_hits(tokens, texts, keys).groupBy(*keys, "token").agg(F.max(w).alias("w"))
        return pairs.join(tokens, "id").join(best, [*keys, "token"]).groupBy("id", *keys).agg(F.sum("w").alias("score"))
    best = token_hits(tokens, texts, keys).groupBy(*keys, "token").agg(F.max(w).alias("w"))
    return best.join(small(tokens), "token").groupBy("id", *keys).agg(F.sum("w").alias("score"))


def rank_documents(questions: DataFrame, tables: DataFrame, k: int = 5) -> DataFrame:
    """(id, report_id, score): a report's score is its best table's, a table's the question's tokens (repeats count) in its text.

    tables: (report_id, table_index, text).
    """
    texts = tables.select("report_id", "table_index", F.lit("rest").alias("field"), "text")
    tokens = query_tokens(questions, distinct=False).groupBy("id", "token").agg(F.count("*").alias("n"))
    keys = ["report_id", "table_index"]
    hits = token_hits(tokens, texts, keys).dropDuplicates([*keys, "token"])
    scores = hits.join(small(tokens), "token").groupBy("id", *keys).agg(F.sum("n").cast("double").alias("score"))
    best = scores.groupBy("id", "report_id").agg(F.max("score").alias("score"))
    return top_k(best, ["id"], [F.desc("score"), F.col("report_id")], k)


def bm25(questions: DataFrame, texts: DataFrame, key: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, key, score); texts (key, text). Words in lower case; those that a question repeats count again."""
    counted = texts.select(key, words("text").alias("ws"))
    stats = counted.agg(F.count("*").cast("double").alias("n_docs"), F.avg(F.size("ws")).alias("mean_len"))
    tokens = questions.select("id", F.explode(words("question")).alias("token")).groupBy("id", "token").agg(F.count("*").alias("times"))
    wanted = small(tokens.select("token").distinct())
    found = counted.select(key, F.size("ws").alias("len"), F.explode("ws").alias("token")).join(wanted, "token", "left_semi")
    # dealt out by text once; what follows needs no other shuffle until the top k
    postings = cut(found.groupBy(key, "len", "token").agg(F.count("*").alias("tf")), "postings").repartition(key)
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    known = cut(tokens.join(df, "token").crossJoin(F.broadcast(stats)), "known-tokens")  # stats is one row
    return postings.join(small(known), "token").groupBy("id", key).agg(F.sum(F.col("times") * idf * weight).alias("score"))


def holding(texts: DataFrame, needles: DataFrame, key: str) -> DataFrame:
    """(id, key) of the texts (key, text) that hold a whole needle (id, needle).

    A text that holds a needle has each of its inner words; it is looked up by the one that fewest
    texts have, and then compared. Needles of fewer than three words are compared with all texts.
    """
    ws = F.regexp_extract_all("needle", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    inner = needles.select("id", F.explode(F.array_distinct(F.slice(ws, 2, F.greatest(F.size(ws) - 2, F.lit(0))))).alias("word"))
    wanted = small(inner.select("word").distinct())
    found = cut(texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word")).join(wanted, "word", "left_semi"), "needle-words")
    often = found.groupBy("word").agg(F.count("*").alias("n"))
    # a needle with a word that no text has isn't there
    rarest = inner.join(often, "word", "left").groupBy("id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    pairs = found.join(small(rarest), "word").select("id", key)
    met = texts.join(pairs, key).join(small(needles), "id").where(F.contains(F.col("text"), F.col("needle")))
    short = needles.where(F.size(ws) < 3)
    all_ = texts.join(small(short), F.contains(F.col("text"), F.col("needle")))
    return met.select("id", key).unionByName(all_.select("id", key))


def statement_type(table_type: Column, text: Column) -> Column:
    """BS, IS or CF, the first that the table's type is or its text names (accents aside), else NOTE."""
    names = {"BS": "Balance Sheet", "IS": "Income Statement", "CF": "Cash Flow Statement"}
    plain = strip_accents(text)
    found = F.lit("NOTE")
    for kind, ws in reversed(C.STATEMENT_WORDS):
        found = F.when(F.coalesce(table_type == names[kind], F.lit(False)) | contains_any(plain, ws), F.lit(kind)).otherwise(found)
    return found


def code_boost(codes: Column, account_codes: Column) -> Column:
    return F.when(F.arrays_overlap(codes, account_codes), 200.0).otherwise(0.0)


def phrase_boost(metrics: Column, items: Column, labels: Column, context: Column) -> Column:
    """struct(score, hit): metrics in order; one in the items ends with 150, each before it in the context adds 50."""

    def step(acc: Column, m: Column) -> Column:
        low = F.lower(strip(m))
        usable = F.length(low) >= 4
        in_items = F.contains(items, low) | F.exists(labels, lambda x: F.contains(F.lower(x), low))
        score = F.when(~usable | acc["hit"], acc["score"]).when(in_items, acc["score"] + 150.0).when(F.contains(context, low), acc["score"] + 50.0).otherwise(acc["score"])
        return F.struct(score.alias("score"), (acc["hit"] | (usable & in_items)).alias("hit"))

    return F.aggregate(metrics, F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("hit")), step)


def fragment_penalty(metrics: Column, items: Column, matched: Column) -> Column:
    some = F.exists(metrics, lambda m: F.exists(F.split(F.lower(m), r"(?U)\s+"), lambda w: (F.length(w) >= 3) & F.contains(items, w)))
    return F.when(~matched & some, -30.0).otherwise(0.0)


def topic_boost(asked: Column, context: Column) -> Column:
    """100 for the first topic whose words the question and the context have; -100 for investments where interest is asked for."""
    out = F.when(contains_any(asked, C.INTEREST_QUESTION) & contains_any(context, C.INVESTMENT_TABLE), -100.0).otherwise(0.0)
    boost = F.lit(0.0)
    for _, question_words, notes in reversed(C.TOPICS):
        boost = F.when(contains_any(asked, question_words) & contains_any(context, notes), 100.0).otherwise(boost)
    return boost + out


def related_penalty(question: Column, context: Column) -> Column:
    return F.when(contains_any(context, C.RELATED_TABLE) & ~contains_any(question, C.RELATED_QUESTION), -100.0).otherwise(0.0)


def route_boost(question: Column, asked: Column, statement: Column) -> Column:
    """By the first class that the question belongs to, what the table's statement gets. asked: the question and its metrics; the question alone rules a class out."""
    out = F.lit(0.0)
    for _, some, unless, gets in reversed(C.ROUTES):
        score = F.lit(0.0)
        for kind, x in gets.items():
            score = F.when(statement == kind, F.lit(x)).otherwise(score)
        out = F.when(contains_any(asked, some) & ~contains_any(question, unless), score).otherwise(out)
    return out


def scope_nudge(question: Column, report_id: Column) -> Column:
    separate, consolidated = contains_any(question, C.SCOPE_SEPARATE), contains_any(question, C.SCOPE_CONSOLIDATED)
    report = F.lower(report_id)
    own = lambda w, other: F.when(F.contains(report, F.lit(w)), 15.0).when(F.contains(report, F.lit(other)), -15.0).otherwise(0.0)
    return F.when(separate & ~consolidated, own("separate", "consolidated")).when(consolidated & ~separate, own("consolidated", "separate")).otherwise(0.0)


def rule_scores(candidates: DataFrame) -> DataFrame:
    """candidates (id, question, metrics, codes, lexical score, catalog's columns) with score and statement."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    items, question = low("item_col_text"), low("question")
    memory = memory_text(F.col("table_type"), F.col("table_context"), F.col("headers"), F.col("preview"), F.col("item_col_text"))
    context = F.lower(F.concat_ws(" ", "table_context", memory))
    asked = F.concat_ws("\n", question, F.lower(F.array_join("metrics", "\n")))
    phrase = phrase_boost(F.col("metrics"), items, F.col("exact_metric_labels"), context)
    marked = candidates.withColumns({"statement": statement_type(F.col("table_type"), context), "phrase_": phrase, "code_": code_boost(F.col("codes"), F.col("account_codes_set"))})
    score = (
        F.coalesce("lexical", F.lit(0.0))
        + F.col("code_")
        + F.col("phrase_.score")
        + fragment_penalty(F.col("metrics"), items, F.col("phrase_.hit") | (F.col("code_") > 0))
        + topic_boost(asked, context)
        + related_penalty(question, context)
        + route_boost(question, asked, F.col("statement"))
        + scope_nudge(question, F.col("report_id"))
    )
    return marked.withColumn("score", score).drop("phrase_", "code_")


def rerank(ranked: DataFrame, question_vectors: DataFrame | None, table_vectors: DataFrame | None, weight: float = 300.0, keep: int = TOP_TABLES) -> DataFrame:
    """The best ``keep`` tables of each question by score, then by score plus weight x cosine.

    Vectors are (id, qv) and (report_id, table_index, tv); they meet the few tables that are left
    only. A missing vector counts as 0.
    """
    tie = [F.col("report_id"), F.col("table_index")]
    first = top_k(ranked, ["id"], [F.desc("score"), *tie], keep)
    if question_vectors is None or table_vectors is None:
        return first
    both = first.join(question_vectors, "id", "left").join(table_vectors, ["report_id", "table_index"], "left")
    final = both.withColumn("score", F.col("score") + weight * F.coalesce(cosine("qv", "tv"), F.lit(0.0))).drop("qv", "tv", "rank")
    return top_k(final, ["id"], [F.desc("score"), *tie], keep)


def tags(tables: DataFrame) -> DataFrame:
    """(id, relevant_tables): report|line of each table in rank order, its parent's after it, each once."""
    tag = lambda c: F.concat_ws("|", "report_id", F.col(c).cast("string"))
    parent = F.when(F.col("parent_table_start_line").isNotNull() & (F.col("parent_table_start_line") != F.col("start_line")), F.array(tag("parent_table_start_line"))).otherwise(F.array().cast("array<string>"))
    own = tables.select("id", "rank", F.concat(F.array(tag("start_line")), parent).alias("t"))
    listed = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "t"))).alias("x"))
    return listed.select("id", F.array_distinct(F.flatten(F.transform("x", lambda e: e["t"]))).alias("relevant_tables"))


def memory_text(kind: Column, context: Column, headers: Column, preview: Column, items: Column) -> Column:
    """All that is told of a table, labelled: what its rules are matched against. Nulls are empty."""
    own = lambda c: F.coalesce(c, F.lit(""))
    return strip(F.format_string("Loại bảng: %s | Ngữ cảnh: %s | Cột: %s | Mẫu: %s | Chỉ tiêu: %s", own(kind), own(context), own(F.array_join(headers, " ")), own(preview), own(items)))


def summary_text(report_id: Column, kind: Column, context: Column, headers: Column, items: Column) -> Column:
    """A table's labelled summary, with the first 150 characters of its items: what is embedded."""
    return F.format_string("Báo cáo: %s | Loại: %s | Ngữ cảnh: %s | Tiêu đề: %s | Chỉ tiêu: %s", report_id, kind, context, F.array_join(headers, " "), F.substring(items, 1, 150))


def query_variants(question: Column, tickers: Column, years: Column) -> Column:
    """The question, and the question with its entities and years in front; each once."""
    names = F.concat_ws(" ", F.array_join(tickers, " "), F.array_join(F.transform(years, lambda y: y.cast("string")), " "))
    return F.array_distinct(F.array(question, F.trim(F.concat_ws(" ", names, question))))
