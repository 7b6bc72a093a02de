"""The whole way from reports and questions to answers, as one lineage of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer, extract, filters, intent, lookup, rank, ratios
from ..operators.cut import cut
from ..operators.rank import TOP_TABLES


def retrieve(intents: DataFrame, catalog: DataFrame, question_vectors: DataFrame | None = None, table_vectors: DataFrame | None = None) -> DataFrame:
    """(id, rank, score, statement, catalog's columns) of the tables that answer each intent.

    Filters first, then rule scores on the catalog's short columns (never its cells), then vectors for
    the few that are left.
    """
    lean = catalog.drop("rows")
    keys = ["report_id", "table_index"]
    candidates = cut(filters.prefer_scope(filters.hard_filter(intents, lean)).drop("report_type", "keyed"), "candidates")
    texts = lean.select(
        "report_id",
        "table_index",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("field"), c.alias("text"))
                    for f, c in (("context", F.col("table_context")), ("headers", F.array_join("headers", " ")), ("items", F.col("item_col_text")), ("rest", F.col("preview")))
                ]
            )
        ).alias("t"),
    ).select("report_id", "table_index", "t.*")
    lexical = rank.lexical_scores(intents.select("id", "question"), texts, keys, pairs=candidates).withColumnRenamed("score", "lexical")
    wanted = intents.select("id", "question", "metrics", "codes", "top_n")
    scored = rank.rule_scores(candidates.join(wanted, "id").join(lexical, ["id", *keys], "left"))
    best = rank.rerank(scored, question_vectors, table_vectors, keep=TOP_TABLES)
    return best.where(F.col("rank") <= F.greatest(F.col("top_n"), F.lit(1)))


def documents_of(intents: DataFrame, catalog: DataFrame, limit: int = 5) -> DataFrame:
    """(id, relevant_docs): the filtered reports; where no entity is named and there are many, the best by their tables' words.

    Reports are filtered by their names, tickers and years; the tables' texts are only read if there is a question that needs them.
    """
    reports = catalog.select("report_id", "ticker", "year").distinct()
    candidates = filters.prefer_scope(filters.hard_filter(intents, reports))
    docs = cut(candidates.select("id", "report_id").distinct(), "documents")
    counted = docs.groupBy("id").agg(F.count("*").alias("n")).join(intents.select("id", F.size("tickers").alias("nt")), "id")
    many = counted.where((F.col("nt") == 0) & (F.col("n") > limit)).select("id")
    kept = docs
    if not many.isEmpty():
        tables = catalog.select("report_id", "table_index", F.concat_ws(" ", "table_context", F.array_join("headers", " "), "table_type").alias("text"))
        ranked = rank.rank_documents(intents.join(many, "id", "left_semi").select("id", "question"), tables, limit).select("id", "report_id")
        kept = docs.join(many, "id", "left_anti").unionByName(docs.join(ranked, ["id", "report_id"], "left_semi"))
    return kept.groupBy("id").agg(F.array_sort(F.collect_set("report_id")).alias("relevant_docs"))


def answer_questions(
    questions: DataFrame,
    catalog: DataFrame,
    aliases: DataFrame,
    reports: DataFrame | None = None,
    understand: Callable[[DataFrame, DataFrame], DataFrame] = intent.understand,
    question_vectors: DataFrame | None = None,
    table_vectors: DataFrame | None = None,
) -> DataFrame:
    """questions (id, question) to answers: relevant_docs, relevant_tables, evidence, query, answer.

    A ratio is computed from the statement facts of the retrieved reports; other metrics go through
    the cascade code, label, text, and last the first number but 0. ``understand`` may be another
    provider of intents (a language model, say) with the same columns.
    """
    keys = ["report_id", "table_index"]
    intents = cut(understand(questions, aliases), "intents")
    ranked = cut(retrieve(intents, catalog, question_vectors, table_vectors), "ranked")
    tables = cut(catalog.join(ranked.select(*keys).distinct(), keys, "left_semi"), "tables")
    cells = cut(extract.cells_of(tables), "cells")
    roles = cut(lookup.column_roles(cells), "roles")
    columns = lookup.value_column(cells, roles, ranked.select("id", "question", *keys))
    plans = cut(columns.join(ranked.select("id", *keys, F.col("rank").alias("table_pos")), ["id", *keys]), "plans")

    entity = catalog.join(ranked.select("report_id").distinct(), "report_id", "left_semi")
    all_cells = cut(extract.cells_of(entity), "entity-cells")
    values = ratios.tall(ratios.ratios(lookup.facts(entity, all_cells, lookup.column_roles(all_cells))))
    first_report = ranked.where("rank = 1").select("id", *keys)
    by_ratio = intents.where("formula is not null").select("id", "formula").join(first_report, "id").join(values, ["report_id", "formula"]).where("value is not null").select("id", "value", *keys)

    codes = intents.select("id", F.posexplode("codes").alias("code_pos", "code"))
    metrics = intents.select("id", F.posexplode("metrics").alias("metric_pos", "metric"))
    texts = tables.select(*keys, F.col("table_context").alias("text"))
    if reports is not None:
        near = lookup.surroundings(reports, tables)
        texts = texts.join(near.withColumnRenamed("text", "near"), keys, "left").select(*keys, F.concat_ws("\n", "text", "near").alias("text"))
    narrow = plans.drop("question")
    found = lookup.cascade(
        intents.select("id", "question", "scaling_factor", "is_percent", "formula", "codes"),
        lambda ids: by_ratio.join(ids, "id", "left_semi"),
        lambda ids: lookup.by_code(narrow.join(ids, "id", "left_semi"), cells, codes),
        lambda ids: lookup.by_label(plans.join(ids, "id", "left_semi"), cells, roles, metrics).drop("score"),
        lambda ids: lookup.by_text(narrow.join(ids, "id", "left_semi"), texts, metrics),
        lambda ids: lookup.first_nonzero(narrow.join(ids, "id", "left_semi"), cells).select("id", "value", F.lit(None).cast("string").alias("report_id"), F.lit(None).cast("int").alias("table_index")),
        cut=lambda df: cut(df, "tier"),
    )
    scaled = F.when(F.col("tier") == 1, F.round(ratios.scaled(F.col("value"), F.col("formula"), F.col("is_percent")), 6)).otherwise(answer.scale(F.col("value"), F.col("scaling_factor"), F.col("is_percent")))
    answered = cut(found.withColumn("answer", scaled), "answered")
    used = answered.where("report_id is not null").select("id", *keys)
    kept = answer.prune(ranked, used)
    query = F.when(F.col("report_id").isNotNull(), answer.plan_text(F.col("report_id"), F.col("table_index"), F.get("codes", F.lit(0)), F.col("scaling_factor")))
    return (
        answered.select("id", "question", "answer", "tier", answer.executable(query, F.col("answer")).alias("query"))
        .join(documents_of(intents, catalog), "id", "left")
        .join(rank.tags(kept), "id", "left")
        .join(answer.evidence(kept), "id", "left")
    )
