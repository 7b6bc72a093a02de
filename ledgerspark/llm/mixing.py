"""Mixing sources to target weights along a time-varying curriculum.

Three steps. Targets: all sources share the budget by weight, none above ``most`` times its own
size (water filling). Placing: a source's documents lie end to end in a pseudo-random order; the
target is taken from that stream, pass after pass, so a document is taken whole, twice, or (at most
one a source) in part. Curriculum: a source's weight changes over training time t in [0, 1]; the
integral of its schedule is its cumulative demand, and inverting it at the words taken so far gives
each document the time at which it is due. ``by_position`` range-sorts documents by that time.

The running sums are made in two levels: sums by (source, leading hex digits of the document's
hash) first, then within each such bin, so that a source with a third of all rows is spread over
thousands of bins. Only ids, sizes and hashes are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, word_count

#: Weights by place of the source, and the schedule of each: its rate at t=0 and at t=1 (their mean is 1).
WEIGHTS = (3.0, 1.0, 2.0)
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))


def placed(sizes: DataFrame, parts: int = 32) -> DataFrame:
    """sizes (source, ...) with place: from 0 on, by code point, null last. Sources are dealt out by range and numbered within each range."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id_", F.monotonically_increasing_id())
    ranged = materialize(ranged, "mix-sources")
    # the upper bits of such an id are the range's number
    ranged = ranged.withColumn("range_", F.shiftright("id_", 33))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("range_").agg(F.count("*").alias("n_")).withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0)))  # a row a range
    return ranged.join(F.broadcast(ranges), "range_").withColumn("place", F.col("before_") + F.col("id_").bitwiseAND((1 << 33) - 1)).drop("id_", "range_", "n_", "before_")


def targets(sizes: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) to (source, source_size, place, target): the water-filling shares.

    Sources are placed by code point, null last; weights repeat. There is one row a source. All
    sources share the budget by weight; those above their caps get these, and the rest is shared by
    the others, until none is above: each turn is one aggregate over the sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = materialize(placed(sizes).withColumns({"w": w, "cap": F.col("source_size") * F.lit(float(most))}), "mix-targets")
    total, open_weight = rows.agg(F.sum("source_size"), F.sum("w")).first()
    budget, capped, level = (total or 0) * float(share), 0.0, 0.0
    while open_weight:
        level = (budget - capped) / open_weight
        over = F.col("cap") <= F.lit(level) * F.col("w")
        now, left = rows.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if left == open_weight:
            break
        capped, open_weight = now, left
    fits = (F.col("cap") <= F.lit(level) * F.col("w")) if open_weight else F.lit(True)
    return rows.select("source", "source_size", "place", F.when(fits, F.col("cap")).otherwise(F.col("w") * F.lit(level)).alias("target"))


def demand_time(done: Column, start: Column, end: Column) -> Column:
    """The time t at which a schedule rising linearly from start to end (mean 1) has met the share ``done``: the root of start t + (end - start) t^2 / 2 = done."""
    bend = end - start
    root = F.coalesce(F.try_divide(2 * done, start + F.sqrt(F.greatest(start * start + 2 * bend * done, F.lit(0.0)))), F.lit(0.0))
    return F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    share: float = 1.5,
    most: float = 2.0,
    digits: int = 3,
    size: Column | None = None,
) -> DataFrame:
    """docs (doc_id, source, text) to (doc_id, source, size, source_size, target, taken, passes, position, positions).

    taken: the words that the mix takes, repeats counted; passes: in how many passes; position: the
    time in [0, 1] of the first pass (null where nothing is taken); positions: the times of all
    passes (see ``by_pass``). A null text has size 0. A null
    source is a source of its own, the last one. Documents are ordered within a source by the MD5 of
    doc_id (null: empty), then size: rows that repeat share that place and are told apart by nothing,
    so their results are the same as a set on each run. Documents of size 0 take nothing. An empty
    table gives an empty one. Other columns are dropped. ``digits``: leading hex digits that name a
    bin; 16**digits bins a source.
    """
    size = word_count(F.col("text")) if size is None else size
    small = docs.select(
        "doc_id",
        "source",
        size.alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
    ).withColumn("bin", F.substring("h", 1, digits))
    small = materialize(small, "mix-sizes")
    bins = small.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    totals = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most)
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    known = bins.alias("b").join(totals.alias("t"), F.expr("b.source <=> t.source")).select(
        "b.source", "b.bin", "bin_start", "source_size", "place", "target"
    )
    within = Window.partitionBy("source", "bin").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = small.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = local.alias("d").join(known.alias("k"), F.expr("d.source <=> k.source AND d.bin = k.bin")).select(
        "d.doc_id", "d.source", "d.size", "source_size", "target", "place", (F.col("bin_start") + F.col("local")).alias("at")
    )
    goal = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    more = goal - full * F.col("source_size")
    partly = F.least(F.greatest(more - F.col("at"), F.lit(0)), F.col("size"))
    pick = lambda k: F.element_at(F.array(*[F.lit(float(s[k])) for s in schedules]), (F.col("place") % len(schedules) + 1).cast("int"))
    # the stream of a source begins again after source_size words
    due = lambda k: demand_time(F.try_divide(F.col("at") + k * F.col("source_size"), goal), pick(0), pick(1))
    each = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), due))
    return (
        rows.withColumn("taken", (full * F.col("size") + partly).cast("long"))
        .withColumn("passes", F.when(F.col("size") > 0, full + (partly > 0).cast("long")).otherwise(0).cast("long"))
        .withColumn("position", F.when(F.col("taken") > 0, demand_time(F.try_divide(F.col("at"), goal), pick(0), pick(1))))
        .withColumn("positions", F.coalesce(each, F.array().cast("array<double>")))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "position", "positions")
    )


def by_pass(mixed: DataFrame) -> DataFrame:
    """A row for each pass of a document: pass from 1 on, taken and position are this pass's. All passes but the last of a source are whole."""
    each = mixed.select("*", F.posexplode("positions").alias("pass_", "due_"))
    # the last pass takes what the others leave
    taken = F.when(F.col("pass_") < F.col("passes") - 1, F.col("size")).otherwise(F.col("taken") - (F.col("passes") - 1) * F.col("size"))
    return each.withColumns({"pass": F.col("pass_") + 1, "taken": taken, "position": F.col("due_")}).drop("pass_", "due_", "positions")


def by_position(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; documents that aren't taken come last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    last = F.round(F.get("positions", F.size("positions") - 1), 9)
    return by_position(mixed).select("doc_id", "size", "source_size", "target", "taken", "passes", F.round("position", 9).alias("position"), last.alias("last_position"))


def mixing_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curriculum: a row for each pass of each document, with the words taken in it and its training position."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return by_position(by_pass(mixed)).select("doc_id", "pass", "taken", F.round("position", 9).alias("position"))


_MIXED = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source
), p AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget FROM p
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), c AS (
  SELECT *, cap <= level * w AS capped FROM l
), t AS (
  SELECT *, CASE WHEN capped THEN cap ELSE w * first_value(level) OVER (ORDER BY capped, cap / w, place) END AS target FROM c
), r AS (
  SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, t.place, CAST(floor(t.target) AS BIGINT) AS goal,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS full_passes FROM r
), g AS (
  SELECT *, full_passes * size + least(greatest(goal - full_passes * source_size - pos, 0), size) AS taken,
         CASE place % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS a,
         CASE place % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS b FROM f
), u AS (
  SELECT *, CASE WHEN size > 0 THEN full_passes + CASE WHEN taken > full_passes * size THEN 1 ELSE 0 END ELSE 0 END AS passes FROM g
)
"""
_TIME = "round(least(greatest((2 * (({0})::DOUBLE / goal)) / (a + sqrt(greatest(a * a + 2 * (b - a) * (({0})::DOUBLE / goal), 0))), 0), 1), 9)"
PASSES_SQL = (
    _MIXED
    + f"""SELECT doc_id, CAST(k + 1 AS BIGINT) AS pass, CAST(CASE WHEN k < passes - 1 THEN size ELSE taken - (passes - 1) * size END AS BIGINT) AS taken, {_TIME.format('pos + k * source_size')} AS position
FROM (SELECT *, unnest(range(0, passes)) AS k FROM u)
"""
)
OP7_SQL = (
    _MIXED
    + f"""SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, CAST(passes AS BIGINT) AS passes,
       CASE WHEN taken > 0 THEN {_TIME.format('pos')} END AS position, CASE WHEN taken > 0 THEN {_TIME.format('pos + (passes - 1) * source_size')} END AS last_position
FROM u
"""
)
