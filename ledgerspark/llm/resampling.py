"""Importance resampling towards a target distribution of hashed n-grams, by an external sort-count.

Streams: the features of the texts, as the numbers of their buckets, are packed as uint16 one text
after the other, with the offset at which each text's stretch begins: a table of blocks of bounded
size in the shared folder, written once. A very long text goes on in the next block.

Counts: each block's stream is sorted and run-length encoded; Spark adds up the runs of all blocks,
of which there are at most ``buckets`` a block. Gains: a table of ``buckets`` numbers, made on the
driver of the counts of both sides. Weights: the blocks are read once more, the gains are gathered by
the stream and added up between the offsets (``np.add.reduceat``).

The draw is the Gumbel trick: to each weight comes noise that depends on the seed and the document's
id alone, and the highest scores are taken. All documents are sorted by range, their ranks are the
rows before them in the ranges before, counted by range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, table, word_blocks

BUCKETS, GRAM = 10_000, 3
#: Documents of fewer words aren't drawn; so many of a hundred are, with this seed.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: A block is closed after so many features.
BLOCK_FEATURES = 1 << 20


def bucket_stream(text: str | None, buckets: int = BUCKETS, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray]]:
    """A text's (words, buckets of its features) part by part: runs of 1 to ``gram`` consecutive words, joined by a space, by the CRC-32 of their bytes.

    The checksum of a longer run goes on from that of the run without its last word.
    """
    before: list[bytes] = []
    for words in word_blocks(text):
        old, own = len(before), before + words
        spaced = [b" " + w for w in own]
        sums = list(map(crc32, own))
        out = [np.fromiter(sums[old:], dtype=np.uint32, count=len(words))]
        for n in range(1, gram):
            sums = list(map(crc32, spaced[n:], sums))  # the runs of n + 1 words, by their first word
            new = sums[max(old - n, 0) :]  # those that end in this part
            out.append(np.fromiter(new, dtype=np.uint32, count=len(new)))
        yield len(words), (np.concatenate(out) % np.uint32(buckets)).astype(np.uint16)
        before = own[len(own) - gram + 1 :] if gram > 1 and len(own) >= gram else own if gram > 1 else []


STREAMS = "doc_ids array<string>, texts array<long>, n_words array<long>, offsets array<long>, stream binary"


def write_streams(docs: DataFrame, buckets: int = BUCKETS, gram: int = GRAM, block: int = BLOCK_FEATURES) -> DataFrame:
    """docs (doc_id, text) to blocks (doc_ids, texts, n_words, offsets, stream), stored in the shared folder.

    Ids are kept as texts, as pandas has whole numbers beside a null as floats. texts numbers the rows of docs; a text
    whose stream goes on in a further block stands in both, with the words that it has in each.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is a uint16")
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows, words, offsets, parts, held = [], [], [], [], [], 0

        def close() -> pd.DataFrame:
            out = pd.DataFrame({"doc_ids": [list(ids)], "texts": [list(rows)], "n_words": [list(words)], "offsets": [list(offsets)], "stream": [np.concatenate(parts).tobytes() if parts else b""]})
            for x in (ids, rows, words, offsets, parts):
                x.clear()
            return out

        for batch in batches:
            for doc_id, text, row in zip(batch["doc_id"], batch["text"], batch["row"]):
                doc_id = None if pd.isna(doc_id) else doc_id
                begun = False
                for n, found in bucket_stream(text, buckets, gram):
                    if not begun or not ids:
                        ids.append(doc_id), rows.append(row), words.append(0), offsets.append(held)
                        begun = True
                    words[-1] += n
                    parts.append(found)
                    held += len(found)
                    if held >= block:
                        yield close()
                        held = 0
                if not begun:
                    ids.append(doc_id), rows.append(row), words.append(0), offsets.append(held)
                if len(ids) >= block:
                    yield close()
                    held = 0
        if ids:
            yield close()

    return materialize(docs.mapInPandas(write, STREAMS), "bucket-streams")


def sorted_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: each block's stream sorted and run-length encoded, the runs added up by bucket."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stream in batch["stream"]:
                own = np.sort(np.frombuffer(stream, dtype=np.uint16))
                if len(own):
                    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    yield pd.DataFrame({"bucket": own[starts].astype(np.int32), "n": np.diff(np.append(starts, len(own)))})

    summed = streams.select("stream").mapInPandas(runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def gains_of(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """By bucket, 1000 times the logarithm of the smoothed ratio of its shares, rounded down."""
    buckets = len(source)
    t_all, s_all = int(target.sum()) + buckets, int(source.sum()) + buckets
    ratio = [(float(t + 1) * s_all) / (float(s + 1) * t_all) for t, s in zip(target.tolist(), source.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def gumbel(doc_id: str | None, seed: int = SEED) -> int:
    """The noise of a document: by the first eight hexadecimal digits of SHA-256 of ``seed:doc_id``, a null id as the empty string."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:4])
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(streams: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """streams to (doc_id, n_words, n_features, weight, noise), a row a text: the gains of its features, added up between its offsets. doc_id is a text."""
    shared = streams.sparkSession.sparkContext.broadcast(gains)
    schema = "doc_id string, row long, n_words long, n_features long, weight long, noise long, part long"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                stream = np.frombuffer(b.stream, dtype=np.uint16)
                offsets = np.asarray(b.offsets, dtype=np.int64)
                sizes = np.diff(np.append(offsets, len(stream)))
                # reduceat gives an element where there is none to add, and needs offsets inside
                sums = np.add.reduceat(np.append(shared.value[stream], 0), np.minimum(offsets, len(stream))) if len(offsets) else offsets
                ends = np.zeros(len(offsets), dtype=np.int64)
                if len(ends):
                    ends[0], ends[-1] = 1, 1
                ids = list(b.doc_ids)
                yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "row": b.texts, "n_words": b.n_words, "n_features": sizes, "weight": np.where(sizes > 0, sums, 0), "noise": [gumbel(i, seed) for i in ids], "part": ends})

    parts = streams.mapInPandas(add, schema)
    # only a block's first and last text may have parts in other blocks
    whole, cut = parts.where("part = 0"), parts.where("part = 1")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    one = cut.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums, F.first("noise").alias("noise"))
    return whole.drop("part").unionByName(one).drop("row")


def ranked(scored: DataFrame, first: int) -> DataFrame:
    """scored (doc_id, score, drawn boolean, ...) with rank: 1 to ``first`` for the rows drawn, by falling score, then doc_id (null ids last); else null.

    The rows are dealt out by range; a row's rank is its place in its range and the rows of the ranges before.
    """
    order = [F.desc("drawn"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ranges = scored.sparkSession.sparkContext.defaultParallelism
    ranges = max(ranges, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(scored.repartitionByRange(ranges, *order).withColumn("range_", F.spark_partition_id()), "resampling-ranges")
    sizes = dict(placed.groupBy("range_").count().toPandas().itertuples(index=False))  # a row a range
    before, starts = 0, {}
    for k in sorted(sizes):
        starts[k], before = before, before + sizes[k]
    spark = scored.sparkSession
    known = spark.createDataFrame([(int(k), int(v)) for k, v in starts.items()], "range_ int, before_ long")
    own = Window.partitionBy("range_").orderBy(*order)
    place = F.col("before_") + F.row_number().over(own)
    return placed.join(F.broadcast(known), "range_").withColumn("rank", F.when(F.col("drawn") & (place <= first), place)).drop("range_", "before_")


def resample(docs: DataFrame, bench: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, block: int = BLOCK_FEATURES) -> DataFrame:
    """docs (doc_id, text) drawn towards bench (text): (doc_id, n_words, n_features, weight, score, rank), a row for each row of docs.

    Words are runs of 0-9, a-z (A-Z lower-cased) and all beyond ASCII. Null and empty texts have no
    features and weigh 0. Of the texts of ``least_words`` words or more, floor(percent / 100 of them)
    have a rank, from 1. Rows of one id have equal noise; rows that repeat are ranked each, in any
    order. An empty docs table gives an empty result, an empty target even shares. Other columns are
    dropped.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    target = write_streams(bench.select(F.lit(0).alias("doc_id"), "text"), buckets, block=block)
    streams = write_streams(docs, buckets, block=block)
    gains = gains_of(sorted_counts(target, buckets), sorted_counts(streams, buckets))
    discard(target)
    weights = weigh(streams, gains, seed).withColumns({"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "score": F.col("weight") + F.col("noise")}).drop("noise")
    scored = materialize(weights.withColumn("drawn", F.col("n_words") >= least_words), "resampling-weights")
    discard(streams)
    first = scored.where("drawn").count() * percent // 100
    return ranked(scored, first).drop("drawn")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def _crc_table() -> str:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return "[" + ",".join(map(str, out)) + "]"


OP12_SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, false AS target, doc_id, text FROM documents
  UNION ALL SELECT -row_number() OVER (), true, NULL, text FROM benchmark
), w AS (
  SELECT rid, target, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM t
), f AS (
  SELECT rid, target, array_to_string(words[k:k + n - 1], ' ') AS feature
  FROM (SELECT rid, target, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM w, (SELECT unnest([1, 2, 3]) AS n))
), u AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)
), c AS (
  SELECT feature, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT)),
                                  lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket FROM u
), b AS (
  SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM f JOIN c USING (feature) GROUP BY bucket
), a AS (
  SELECT sum(s) AS s_all, sum(t) AS t_all FROM b
), g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * (s_all + {BUCKETS})::DOUBLE) / (CAST(s + 1 AS DOUBLE) * (t_all + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM b, a
), x AS (
  SELECT rid, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN c USING (feature) JOIN g USING (bucket) WHERE NOT target GROUP BY rid
), d AS (
  SELECT rid, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN x USING (rid) WHERE NOT target
), r AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM d WHERE n_words >= {LEAST_WORDS}
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank, CAST(n_words AS BIGINT) AS n_words
FROM d LEFT JOIN r USING (rid)
"""
