"""Ranked lexical search by a tiered index.

Index: the documents stream into segments of about a million words, each a row of a table in the
shared folder, made once. A segment has a directory of its terms (64-bit hashes) and its postings
(document, occurrences) in three tiers, each a column of its own: the postings of highest impact
first, by the weight that a term has within the segment. For each term the directory knows how many
postings stand in each tier, and the residual bounds: the best share that any posting below a tier has.

Search: the first tier of all segments gives each item lower bounds of scores, and the best of these
a threshold that a result has to reach. Then an item is proven in a segment if no document there that
may still reach the threshold, by what it has and the residual bounds of the terms that it has not
shown, has a score that isn't exact yet. Items without proof fall through to the next tier, in the
segments where they lack it only; below the last tier all bounds are 0. Columns of lower tiers are
read for such segments alone. So results are exact, whatever the tiers.

The items come to the executors in blocks of bounded size; what they share is the document frequency
of the block's terms and a threshold an item. Each segment tells its best ``k`` per item; these are
ranked over the corpus. Words are compared by their 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LONG_ROWS, WordHashes, bounded_batches, discard, materialize, table, word_blocks

TOP = 20
#: A segment is closed after so many words; the first tier has so large a share of its postings, the first two so large.
SEGMENT_WORDS, SHARES = 1_000_000, (0.25, 0.5)
TIERS = len(SHARES) + 1
#: Items that are searched for at once.
BLOCK = 1024
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_hashes = WordHashes()
_U = np.uint64


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of a text, ascending, and how often each occurs."""
    parts = []
    for words in word_blocks(text):
        parts.append(np.unique(np.fromiter(map(_hashes.__getitem__, words), dtype=_U, count=len(words)), return_counts=True))
    if len(parts) < 2:
        return parts[0] if parts else (np.empty(0, dtype=_U), np.empty(0, dtype=np.int64))
    terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    return terms, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What of a term's weight its occurrences earn, in millionths; m is 100 for a document of mean length."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def lengths(n_terms: list[int], docs: int, total: int) -> np.ndarray:
    return np.array([75 + 25 * n * docs // total if total else 100 for n in n_terms], dtype=np.int64)


def statistics(docs: DataFrame) -> tuple[int, int]:
    """How many documents have terms, and how many terms they have in all."""
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0))
    got = docs.agg(F.count_if(n > 0).alias("docs"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("terms")).first()
    return got["docs"], got["terms"]


def _segment_schema(id_type: T.DataType) -> T.StructType:
    binary = ["terms", *[f"count{k}" for k in range(TIERS)], *[f"rest{k}" for k in range(TIERS - 1)], *[f"docs{k}" for k in range(TIERS)], *[f"tf{k}" for k in range(TIERS)]]
    fields = [T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("lengths", T.BinaryType())]
    return T.StructType([*fields, *[T.StructField(n, T.BinaryType()) for n in binary]])


def tiered(docs: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray, shares=SHARES) -> dict[str, bytes]:
    """Postings (document, term, occurrences) as a segment's columns: its directory, and its tiers by term, then document."""
    order = np.lexsort((docs, terms))
    docs, terms, tf = docs[order], terms[order], tf[order]
    names, begin, df = np.unique(terms, return_index=True, return_counts=True)
    at = np.repeat(np.arange(len(names)), df)
    q = share(tf, m[docs])
    impact = q * np.log((2 * len(m) + 2) / (2 * df + 1))[at]
    tier = np.zeros(len(q), dtype=np.int8)
    for s in shares:
        if len(q):
            tier += impact < np.quantile(impact, 1 - s)
    out = {"terms": names.tobytes()}
    for k in range(len(shares) + 1):
        own = tier == k
        out[f"count{k}"] = np.bincount(at[own], minlength=len(names)).astype(np.int32).tobytes()
        out[f"docs{k}"], out[f"tf{k}"] = docs[own].astype(np.int32).tobytes(), tf[own].astype(np.int32).tobytes()
        if k < len(shares):
            below = np.where(tier > k, q, 0)
            out[f"rest{k}"] = (np.maximum.reduceat(below, begin) if len(begin) else below).astype(np.int32).tobytes()
    return out


def build_index(docs: DataFrame, n_docs: int, n_terms: int, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """docs (doc_id, text) to segments (segment, doc_ids, lengths, terms, and by tier count, rest, docs, tf), stored in the shared folder.

    A segment's documents are numbered in the order of their ids, null ones last.
    """

    def close(ids: list, sizes: list[int], found: list) -> pd.DataFrame:
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, 0 if ids[k] is None else ids[k]))
        m = lengths([sizes[k] for k in order], n_docs, n_terms)
        place = np.concatenate([np.full(len(found[k][0]), j) for j, k in enumerate(order)])
        terms, tf = (np.concatenate([found[k][i] for k in order]) for i in (0, 1))
        own = {"doc_ids": [ids[k] for k in order], "lengths": m.tobytes()} | tiered(place, terms, tf, m)
        return pd.DataFrame({c: [v] for c, v in own.items()})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, sizes, found, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"]):
                own = counted(text)
                if not len(own[0]):
                    continue  # without terms no score is above 0
                ids.append(None if pd.isna(doc_id) else doc_id)
                sizes.append(int(own[1].sum()))
                found.append(own)
                held += sizes[-1]
                if held >= segment_words:
                    yield close(ids, sizes, found)
                    ids, sizes, found, held = [], [], [], 0
        if ids:
            yield close(ids, sizes, found)

    made = docs.select("doc_id", "text").mapInPandas(index, _segment_schema(docs.schema["doc_id"].dataType))
    return materialize(made.select(F.monotonically_increasing_id().alias("segment"), "*"), "tiered-index", **LONG_ROWS)


def items_of(bench: DataFrame) -> DataFrame:
    """bench (item_id, text) to (item, item_id, terms, times), a row a row; stored."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = [counted(t) for t in b["text"]]
            yield pd.DataFrame({"item": b["item"], "item_id": b["item_id"], "terms": [t.tobytes() for t, _ in told], "times": [n.astype(np.int64).tobytes() for _, n in told]})

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", bench.schema["item_id"].dataType), T.StructField("terms", T.BinaryType()), T.StructField("times", T.BinaryType())])
    return materialize(bench.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInPandas(count, schema), "search-items")


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many documents have each of terms (ascending): only these leave the segments."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for seg in b.itertuples(index=False):
                have = np.frombuffer(seg.terms, dtype=_U)
                df = sum(np.frombuffer(getattr(seg, f"count{k}"), dtype=np.int32).astype(np.int64) for k in range(TIERS))
                _, mine, place = np.intersect1d(have, shared.value, assume_unique=True, return_indices=True)
                yield pd.DataFrame({"place": place, "n": df[mine]})

    summed = index.select("terms", *[f"count{k}" for k in range(TIERS)]).mapInPandas(look, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), dtype=np.int64)
    out[summed["place"].to_numpy()] = summed["n"].to_numpy()
    return out


class Block:
    """Some items: their terms as places in the block's distinct terms, with what a full share of each earns, and the score that a result has to reach."""

    def __init__(self, rows: pd.DataFrame):
        self.items = rows["item"].tolist()
        own = [np.frombuffer(t, dtype=_U) for t in rows["terms"]]
        self.times = [np.frombuffer(t, dtype=np.int64) for t in rows["times"]]
        self.terms = np.unique(np.concatenate(own)) if own else np.empty(0, dtype=_U)
        self.places = [np.searchsorted(self.terms, t) for t in own]
        self.earn: list[np.ndarray] = []
        self.least = np.ones(len(self.items), dtype=np.int64)

    def weigh(self, df: np.ndarray, docs: int) -> None:
        weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], dtype=np.int64)
        self.earn = [weight[p] * t for p, t in zip(self.places, self.times)]


class Segment:
    """A segment's row with the columns of its first tiers, read as arrays when they are asked for."""

    def __init__(self, row, block: Block):
        self.row = row
        self.m = np.frombuffer(row.lengths, dtype=np.int64)
        self.own = np.searchsorted(np.frombuffer(row.terms, dtype=_U), block.terms)
        have = np.frombuffer(row.terms, dtype=_U)
        self.known = have[np.minimum(self.own, len(have) - 1)] == block.terms if len(have) else np.zeros(len(block.terms), dtype=bool)
        self._tiers: dict[int, tuple] = {}

    def tier(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of a tier's lists by term, their documents and shares, and by term the best share below the tier."""
        if k not in self._tiers:
            read = lambda c: np.frombuffer(getattr(self.row, f"{c}{k}"), dtype=np.int32)
            docs = read("docs")
            q = share(read("tf").astype(np.int64), self.m[docs])
            rest = read("rest").astype(np.int64) if k < TIERS - 1 else np.zeros(len(read("count")), dtype=np.int64)
            self._tiers[k] = (np.concatenate([[0], np.cumsum(read("count"))]), docs, q, rest)
        return self._tiers[k]

    def scores(self, block: Block, i: int, upto: int) -> tuple[np.ndarray, np.ndarray] | None:
        """An item's scores by document: at least, and at most, as the tiers up to one tell; None without any of its terms."""
        places = block.places[i]
        on = self.known[places] & (block.earn[i] > 0)
        if not on.any():
            return None
        terms, earn = self.own[places[on]].tolist(), block.earn[i][on].tolist()
        score, shown = np.zeros(len(self.m), dtype=np.int64), np.zeros(len(self.m), dtype=np.int64)
        rest = self.tier(upto)[3]
        for k in range(upto + 1):
            bounds, docs, q, _ = self.tier(k)
            for t, e in zip(terms, earn):
                a, b = bounds[t], bounds[t + 1]
                if a < b:
                    own = docs[a:b]
                    score[own] += e * q[a:b]
                    if rest[t]:
                        shown[own] += e * int(rest[t])
        return score, score + (sum(e * int(rest[t]) for t, e in zip(terms, earn)) - shown)


def _best(score: np.ndarray, least: int, k: int) -> np.ndarray:
    """The documents of the k best scores from ``least`` on, best first, of equal ones the first."""
    own = np.flatnonzero(score >= least)
    if len(own) > 4 * k:
        cut = np.partition(score[own], len(own) - k)[len(own) - k]
        own = own[score[own] >= cut]
    return own[np.argsort(-score[own], kind="stable")[:k]]


def thresholds(index: DataFrame, block: Block, k: int) -> np.ndarray:
    """By item, what its k-th best document has at least, by the first tier of all segments; 1 where fewer are known."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        for b in batches:
            for row in b.itertuples(index=False):
                seg = Segment(row, block)
                places, lows = [], []
                for i in range(len(block.items)):
                    got = seg.scores(block, i, 0)
                    if got is not None:
                        best = _best(got[0], 1, k)
                        places += [i] * len(best)
                        lows += got[0][best].tolist()
                yield pd.DataFrame({"place": pd.Series(places, dtype="int64"), "low": pd.Series(lows, dtype="int64")})

    lows = index.select("lengths", "terms", "count0", "rest0", "docs0", "tf0").mapInPandas(bound, "place long, low long")
    own = Window.partitionBy("place").orderBy(F.desc("low"))
    best = lows.withColumn("n", F.row_number().over(own)).where(F.col("n") <= k)
    found = best.groupBy("place").agg(F.min("low").alias("low"), F.count("*").alias("n")).where(F.col("n") == k).toArrow()
    out = np.ones(len(block.items), dtype=np.int64)
    out[found["place"].to_numpy()] = np.maximum(found["low"].to_numpy(), 1)
    return out


def _told_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("segment", T.LongType()), T.StructField("item", T.LongType()), T.StructField("tier", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])


def search_tier(index: DataFrame, block: Block, pending: DataFrame | None, tier: int, k: int) -> DataFrame:
    """(segment, item, tier, doc_id, score): what a tier and those above it prove, and a row without score for each item that lacks proof in a segment.

    pending (segment, places) says which items still lack it where; without, all items are asked for everywhere.
    """
    shared = index.sparkSession.sparkContext.broadcast(block)
    columns = ["segment", "doc_ids", "lengths", "terms", *[f"{c}{j}" for c in ("count", "docs", "tf") for j in range(tier + 1)], *[f"rest{j}" for j in range(min(tier + 1, TIERS - 1))]]
    asked, some = index.select(columns), pending is not None
    if some:
        # a row a segment, of at most a block's items: the segments themselves are not shuffled
        asked = asked.join(F.broadcast(pending), "segment")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = shared.value
        for b in batches:
            for row in b.itertuples(index=False):
                seg = Segment(row, block)
                items, docs, scores = [], [], []
                for i in row.places if some else range(len(block.items)):
                    got = seg.scores(block, i, tier)
                    if got is None:
                        continue
                    low, high = got
                    may = high >= block.least[i]
                    if (low[may] < high[may]).any():
                        items.append(block.items[i]), docs.append(None), scores.append(None)
                        continue
                    best = _best(low, int(block.least[i]), k)
                    items += [block.items[i]] * len(best)
                    docs += [row.doc_ids[d] for d in best.tolist()]
                    scores += low[best].tolist()
                yield pd.DataFrame({"segment": row.segment, "item": pd.Series(items, dtype="int64"), "tier": tier, "doc_id": pd.Series(docs, dtype=object), "score": pd.Series(scores, dtype="Int64")})

    return materialize(asked.mapInPandas(find, _told_schema(index.schema["doc_ids"].dataType.elementType)), f"search-tier{tier}")


def search(docs: DataFrame, bench: DataFrame, k: int = TOP, block: int = BLOCK, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The k best of docs (doc_id, text) for each row of bench (item_id, text): (item_id, rank, doc_id, score, tier).

    Terms are runs of 0-9, a-z (A-Z lower-cased) and all beyond ASCII; null and empty texts have none
    and are neither found nor find any. Equal scores are ranked by doc_id, null ids last. Rows of docs
    that repeat are ranked each; rows of bench that repeat have results each. ``tier`` says which tier
    proved a result (from 0). Empty tables give an empty result. Other columns are dropped.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n_docs, n_terms = statistics(docs)
    index = build_index(docs, n_docs, n_terms, segment_words)
    items = items_of(bench)
    blocks = -(-items.count() // block) or 1
    told = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else items
        asked = Block(own.select("item", "terms", "times").toPandas())
        asked.weigh(frequencies(index, asked.terms), n_docs)
        asked.least = thresholds(index, asked, k)
        known = {item: i for i, item in enumerate(asked.items)}
        names = spark.createDataFrame(list(known.items()), "item long, place int")  # a row an item of the block
        pending = None
        for tier in range(TIERS):
            got = search_tier(index, asked, pending, tier, k)
            told.append(got.where("score is not null"))
            lacking = got.where("score is null").join(F.broadcast(names), "item")
            pending = lacking.groupBy("segment").agg(F.sort_array(F.collect_list("place")).alias("places"))  # at most a block's items
            if lacking.limit(1).count() == 0:
                break
    found = told[0]
    for t in told[1:]:
        found = found.unionByName(t)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = materialize(ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score", "tier"), "search-results")
    discard(index, items, *told)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT row_number() OVER () AS bid, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL
), c AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d WHERE len(words) > 0
), m AS (
  SELECT rid, doc_id, 75 + (25 * CAST(len(words) AS BIGINT) * n_docs) // n_terms AS m FROM d, c WHERE len(words) > 0
), p AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(words) AS term FROM d) GROUP BY rid, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c
), q AS (
  SELECT bid, item_id, term, count(*) AS times FROM (SELECT bid, item_id, unnest(words) AS term FROM b) GROUP BY ALL
), s AS (
  SELECT bid, item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY bid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
