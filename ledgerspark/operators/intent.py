"""Questions to structured intents, for all questions at once.

Keyword rules are expressions; entity names are found by one automaton, in one pass over each text.
They are a configuration table of some hundred rows; beyond ALIAS_LIMIT they are joined instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.numeric import is_percent, unit_name, unit_scale
from ..functions.text import col, contains_all, contains_any, quoted, strip
from .cut import cut
from .rank import small

#: Up to so many names, and bytes of them, are one automaton in each task.
ALIAS_LIMIT = 100_000
ALIAS_BYTES = 16 << 20
RUN = r"[\p{L}\p{N}]+"


def uppercase_codes(question: Column | str) -> Column:
    """Words of three capitals, each once."""
    return F.array_distinct(F.regexp_extract_all(col(question), F.lit(r"(?U)\b([A-Z]{3})\b"), F.lit(1)))


def alias_matches(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, ticker, alias, start, stop): where an alias first stands between non-alphanumerics, case aside; in code points.

    questions (id, question), aliases (ticker, alias). While the aliases are a bounded dimension, all
    of them are found in one pass over each text; beyond, they are looked up by words. Null questions
    and null or empty aliases match nothing.
    """
    names = aliases.select("ticker", F.lower("alias").alias("alias")).where("alias <> ''").distinct()
    size = names.limit(ALIAS_LIMIT + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("alias") + F.coalesce(F.octet_length("ticker"), F.lit(0))), F.lit(0)).alias("bytes")).first()
    if size["n"] > ALIAS_LIMIT or size["bytes"] > ALIAS_BYTES:
        return _aliases_by_word(questions, names)
    found = _alias_pass([(r["ticker"], r["alias"]) for r in names.collect()])
    kind = questions.schema["id"].dataType.simpleString()
    return questions.select("id", F.lower("question").alias("q")).where("q is not null").mapInArrow(found, f"id {kind}, ticker string, alias string, start int, stop int")


def _alias_pass(names: Sequence[tuple[str | None, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first match of each name in each row of (id, q): one walk of a trie with failure links, however many names there are."""
    tickers: dict[str, list[str | None]] = {}
    for ticker, alias in names:
        tickers.setdefault(alias, []).append(ticker)

    def first(automaton: ahocorasick.Automaton, q: str) -> dict[str, int]:
        at: dict[str, int] = {}
        for last, alias in automaton.iter(q):
            begin = last + 1 - len(alias)
            if alias not in at and not (begin and q[begin - 1].isalnum()) and not q[last + 1 : last + 2].isalnum():
                at[alias] = begin
        return at

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for alias in tickers:
            automaton.add_word(alias, alias)
        automaton.make_automaton()
        for batch in batches if tickers else ():
            hits = [(row, t, alias, begin) for row, q in enumerate(batch["q"]) for alias, begin in first(automaton, q.as_py()).items() for t in tickers[alias]]
            out = {
                "id": batch["id"].take(pa.array([h[0] for h in hits], pa.int64())),
                "ticker": pa.array([h[1] for h in hits], pa.string()),
                "alias": pa.array([h[2] for h in hits], pa.string()),
                "start": pa.array([h[3] for h in hits], pa.int32()),
                "stop": pa.array([h[3] + len(h[2]) for h in hits], pa.int32()),
            }
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return work


def _aliases_by_word(questions: DataFrame, names: DataFrame) -> DataFrame:
    """alias_matches() of names (ticker, alias): an alias is looked up by its first run of alphanumerics, which is such a run of the question, too; those without any are compared with all questions."""
    names = names.withColumn("word", F.regexp_extract("alias", RUN, 0))
    q = questions.select("id", F.lower("question").alias("q"))
    runs = q.select("id", "q", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(RUN), F.lit(0)))).alias("word"))
    met = runs.join(names.where("word <> ''"), "word").where(F.contains(F.col("q"), F.col("alias"))).select("id", "q", "ticker", "alias")
    met = met.unionByName(q.join(names.where("word = ''"), F.contains(F.col("q"), F.col("alias"))).select("id", "q", "ticker", "alias"))
    # no look-behind: Java's sees half of a letter beyond the basic plane
    pattern = F.concat(F.lit(r"(?s)^(.*?(?:^|[^\p{L}\p{N}]))"), quoted(F.col("alias")), F.lit(r"(?![\p{L}\p{N}])"))
    met = met.where(F.regexp_like("q", pattern)).withColumn("start", F.length(F.call_function("regexp_extract", F.col("q"), pattern, F.lit(1))))
    return met.select("id", "ticker", "alias", "start", (F.col("start") + F.length("alias")).alias("stop"))


def outermost(matches: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """matches without those that lie in a strictly longer one of the same key. Equal matches all stay.

    One sweep over each key's matches by start: the greatest stop so far, and the greatest of those
    that begin at the same place.
    """
    before = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy(*keys, "start")
    reach = matches.withColumns({"before_": F.max("stop").over(before), "beside_": F.max("stop").over(beside)})
    return reach.where((F.coalesce("before_", F.lit(-1)) < F.col("stop")) & (F.col("beside_") <= F.col("stop"))).drop("before_", "beside_")


def resolve_brokers(tickers: Column, question: Column, parents: Mapping[str, str] = C.BROKER_PARENTS) -> Column:
    """Where the question is about brokers: a broker goes first and its parent goes."""
    out = tickers
    broker = contains_any(F.lower(question), C.BROKER_WORDS)
    for child, parent in parents.items():
        first = F.concat(F.array(F.lit(child)), F.array_except(out, F.array(F.lit(child), F.lit(parent))))
        out = F.when(broker & F.array_contains(out, child), first).otherwise(out)
    return out


def years_of(question: Column | str) -> Column:
    """Years 20xx, with ranges of up to ten years filled, ascending."""
    q = col(question)
    pattern = r"(?iu)(20\d{2})\s*(?:-|–|—|/|đến|sang|tới)\s*(20\d{2})"
    number = lambda x: x.cast("int")
    begins = F.transform(F.regexp_extract_all(q, F.lit(pattern), F.lit(1)), number)
    ends = F.transform(F.regexp_extract_all(q, F.lit(pattern), F.lit(2)), number)
    spans = F.zip_with(begins, ends, lambda a, b: F.when(F.abs(a - b) <= 10, F.sequence(F.least(a, b), F.greatest(a, b))).otherwise(F.array(a, b)))
    single = F.transform(F.regexp_extract_all(q, F.lit(r"(?U)\b(20\d{2})\b"), F.lit(1)), number)
    return F.array_sort(F.array_distinct(F.concat(F.flatten(spans), single)))


def scope_of(question: Column | str) -> Column:
    return F.when(contains_any(F.lower(col(question)), C.SEPARATE_WORDS), "separate").otherwise("consolidated")


def metrics_of(question: Column | str) -> Column:
    """struct(formula, metrics) of the first rule that fits, else the question itself as the metric."""
    q = F.lower(col(question))
    out = F.struct(F.lit(None).cast("string").alias("formula"), F.array(col(question)).alias("metrics"))
    for some, every, formula, metrics in reversed(C.METRIC_RULES):
        fits = contains_any(q, some) | (contains_all(q, every) if every else F.lit(False))
        out = F.when(fits, F.struct(F.lit(formula).cast("string").alias("formula"), F.array(*[F.lit(m) for m in metrics]).alias("metrics"))).otherwise(out)
    return out


def resolve_formula(spark: SparkSession, names: DataFrame, registry: Sequence[str]) -> DataFrame:
    """names (name) with the first formula of the registry that contains it or is contained in it, case aside."""
    dim = spark.createDataFrame([(i, r) for i, r in enumerate(registry)], "ord int, formula string")
    a, b = F.lower("name"), F.lower("formula")
    met = names.join(F.broadcast(dim), F.contains(a, b) | F.contains(b, a), "left")
    return met.groupBy(*names.columns).agg(F.min_by("formula", "ord").alias("formula"))


def code_dimension(spark: SparkSession, sections: Mapping[str, Sequence[tuple[str, str]]] = C.SECTIONS, synonyms: Sequence[tuple[str, Sequence[str]]] = C.METRIC_SYNONYMS) -> DataFrame:
    """(kind, section, ord, label, codes): the account codes by label, in the order in which they are tried."""
    rows = [("synonym", "", i, label.lower(), list(codes)) for i, (label, codes) in enumerate(synonyms)]
    rows += [("standard", s, i, label.lower(), [code]) for s, entries in sections.items() for i, (label, code) in enumerate(entries)]
    return spark.createDataFrame(rows, "kind string, section string, ord int, label string, codes array<string>")


def codes_of(metrics: DataFrame, codes: DataFrame) -> DataFrame:
    """metrics (id, pos, metric) to (id, pos, metric, codes): the codes of the first synonym in the metric, else of the best standard label.

    Standard labels are tried income first for income words, else balance first; then income, then cash.
    """
    m = F.lower(strip("metric"))
    rows = metrics.withColumn("m", m)
    met = rows.join(
        small(codes),
        (F.col("m") == F.col("label")) | F.contains(F.col("m"), F.col("label")) | ((F.col("kind") == "standard") & (F.length("m") > 5) & F.contains(F.col("label"), F.col("m"))),
    )
    income = contains_any(F.col("m"), C.INCOME_WORDS) & ~contains_any(F.col("m"), C.NOT_INCOME_WORDS)
    place = F.when(F.col("kind") == "synonym", 0).when(F.col("section") == "cash", 3).when((F.col("section") == "income") == income, 1).otherwise(2)
    best = met.groupBy("id", "pos").agg(F.min_by("codes", F.struct(place.alias("p"), F.col("ord"))).alias("codes"))
    return metrics.join(best, ["id", "pos"], "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def quota(question: Column | str, n_years: Column, n_tickers: Column) -> Column:
    """How many tables a question may have, five at most."""
    formula = contains_any(F.lower(col(question)), C.QUOTA_FORMULA_WORDS)
    own = F.when(formula, 4).when(n_years > 1, F.greatest(F.lit(4), 2 * n_years)).when(n_tickers > 1, F.greatest(F.lit(4), 2 * n_tickers)).otherwise(2)
    return F.least(own, F.lit(5))


def understand(questions: DataFrame, aliases: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """questions (id, question) to intents: tickers, years, report_type, unit, scaling_factor, is_percent, formula, metrics, codes, top_n.

    A formula is detected by its rule; its codes then come from the ratio registry, else from the metrics.
    """
    from .ratios import RATIOS

    spark = questions.sparkSession
    codes = code_dimension(spark) if codes is None else codes
    known = aliases.select(F.upper("ticker").alias("code")).distinct()
    by_code = questions.select("id", F.explode(uppercase_codes("question")).alias("code")).join(known, "code").select("id", F.col("code").alias("ticker"))
    matches = cut(alias_matches(questions, aliases), "alias-matches")
    by_name = outermost(matches)
    # a code that only stands inside a longer name isn't a mention
    covered = matches.select("id", "ticker", F.lower("ticker").alias("t"), "alias").where("t = alias").select("id", "ticker")
    kept = by_name.select("id", "ticker")
    by_code = by_code.join(covered.exceptAll(kept), ["id", "ticker"], "left_anti")
    found = by_code.unionByName(kept).groupBy("id").agg(F.sort_array(F.collect_set("ticker")).alias("tickers"))
    q = F.col("question")
    intents = questions.join(found, "id", "left").select(
        "id",
        "question",
        resolve_brokers(F.coalesce("tickers", F.array().cast("array<string>")), q).alias("tickers"),
        years_of(q).alias("years"),
        scope_of(q).alias("report_type"),
        unit_name(q).alias("unit"),
        unit_scale(q).alias("scaling_factor"),
        is_percent(q).alias("is_percent"),
        metrics_of(q)["formula"].alias("formula"),
        metrics_of(q)["metrics"].alias("metrics"),
    )
    by_metric = codes_of(intents.where("formula is null").select("id", F.posexplode("metrics").alias("pos", "metric")), codes)
    listed = by_metric.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "codes"))), lambda x: x["codes"])).alias("metric_codes"))
    none = F.array().cast("array<string>")
    own = none
    for r in RATIOS:
        own = F.when(F.col("formula") == r.name, F.array(*[F.lit(c) for c in r.target_codes]) if r.target_codes else none).otherwise(own)
    return (
        intents.join(listed, "id", "left")
        .withColumn("codes", F.when(F.col("formula").isNotNull(), own).otherwise(F.coalesce("metric_codes", none)))
        .drop("metric_codes")
        .withColumn("top_n", quota(q, F.size("years"), F.size("tickers")))
    )
