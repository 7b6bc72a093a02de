"""Benchmark decontamination by a distributed positional inverted index.

Index: the documents stream into segments, each an inverted index of its own over some 100,000
words: for each term (the 64-bit hash of a word) its postings, sorted by (document, position). The
segments are a table in the shared folder, made once. Only the benchmark's terms are ever looked up,
so only their postings are stored; a bitmap of fixed size tells them. Word counts cover all words.

Search: how often each term occurs in the whole corpus is summed over the segments, in a table of
fixed size. The benchmark's windows are a table, too, and come to the executors in blocks of at most
``block`` windows, as arrays. Each window is looked up in each segment, its rarest term first:
postings of the further terms, shifted by their offset, are intersected with what is left, until
nothing is. With ``slop`` a term may stand up to that many words off its place (proximity); without,
the matches are exact phrases.

So nothing that is collected or broadcast grows with the corpus or the benchmark. A frequent passage
is spread over the segments that hold it; no document is compared with another. Words are compared
by their 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_WORDS, WordHashes, bounded_batches, discard, has_low_bits, low_bitmap, materialize, table

WINDOW = 10
#: A segment is closed after so many words.
SEGMENT_WORDS = 500_000
#: Windows that are broadcast at once, and the bits of the tables of terms and of their frequencies.
BLOCK, TERM_BITS, FREQUENCY_BITS = 1 << 18, 24, 18

_hashes = WordHashes()
_U = np.uint64


def terms_of(text: str | None) -> np.ndarray:
    """The hashes of a text's words, in order."""
    words = text.encode().translate(LOWER_WORDS).split() if text else []
    return np.fromiter(map(_hashes.__getitem__, words), dtype=_U, count=len(words))


def windows_of(bench: DataFrame, window: int) -> DataFrame:
    """bench (item_id, text) to (terms, item): each item's distinct windows, as the bytes of their terms; an item of fewer words is one window, one without words none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, text in zip(b["item_id"], b["text"]):
                raw = terms_of(text)
                n = min(window, len(raw))
                raw, size = raw.tobytes(), 8 * n
                starts = range(0, len(raw) - size + 1, 8) if n else ()
                for a in range(0, len(starts), 10_000):
                    yield pd.DataFrame({"terms": [raw[k : k + size] for k in starts[a : a + 10_000]], "item": item})

    return bench.mapInPandas(cut, "terms binary, item string").distinct()


def known_terms(bench: DataFrame) -> np.ndarray:
    """A bitmap of the terms of bench (item_id, text)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["text"]:
                yield pd.DataFrame({"term": np.unique(terms_of(text)).view(np.int64)})

    return low_bitmap(bench.mapInPandas(each, "term long"), "term", TERM_BITS)


def _segment_schema(id_type: T.DataType) -> T.StructType:
    item = T.StructType([T.StructField("doc", T.IntegerType()), T.StructField("item", T.StringType())])
    return T.StructType(
        [
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("n_words", T.ArrayType(T.LongType())),
            T.StructField("terms", T.ArrayType(T.LongType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("postings", T.BinaryType()),
            # what has been found so far: items by document, and word intervals as starts, then ends
            T.StructField("items", T.ArrayType(item)),
            T.StructField("hits", T.BinaryType()),
        ]
    )


def build_index(docs: DataFrame, bitmap: np.ndarray, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """docs (doc_id, text) to segments: (doc_ids, n_words, terms, counts, postings, items, hits), stored in the shared folder.

    postings: for each term in turn, ``document << 32 | position`` as int64, ascending. Terms are
    ascending as unsigned numbers. items and hits are empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def close(ids, lengths, terms, places) -> pd.DataFrame:
        term, place = np.concatenate(terms), np.concatenate(places)
        order = np.argsort(term, kind="stable")
        names, counts = np.unique(term, return_counts=True)
        return pd.DataFrame({"doc_ids": [ids], "n_words": [lengths], "terms": [names.view(np.int64)], "counts": [counts.astype(np.int64)], "postings": [place[order].tobytes()], "items": [[]], "hits": [b""]})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, lengths, terms, places, held = [], [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"]):
                term = terms_of(text)
                at = np.flatnonzero(has_low_bits(shared.value, term.view(np.int64), TERM_BITS))
                terms.append(term[at])
                places.append(at.astype(np.int64) | (len(ids) << 32))
                ids.append(None if pd.isna(doc_id) else doc_id)
                lengths.append(len(term))
                held += len(term) + 1
                if held >= segment_words:
                    yield close(ids, lengths, terms, places)
                    ids, lengths, terms, places, held = [], [], [], [], 0
        if ids:
            yield close(ids, lengths, terms, places)

    stored = materialize(docs.select("doc_id", "text").mapInPandas(index, _segment_schema(docs.schema["doc_id"].dataType)), "positional-index")
    shared.destroy()
    return stored


def frequencies(index: DataFrame) -> np.ndarray:
    """By the low bits of a term, how often the terms with these occur in the corpus."""
    slot = F.col("x.terms").bitwiseAND((1 << FREQUENCY_BITS) - 1).alias("slot")
    summed = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(slot).agg(F.sum("x.counts").alias("n")).toArrow()
    out = np.zeros(1 << FREQUENCY_BITS, dtype=np.int64)
    out[summed["slot"].to_numpy()] = summed["n"].to_numpy()
    return out


class Block:
    """Some windows as arrays: terms (a row a window, padded), lengths, the order of their terms from the rarest, and their items."""

    def __init__(self, rows: list[tuple[bytes, str]], often: np.ndarray, window: int):
        keys = sorted({t for t, _ in rows})
        place = {t: i for i, t in enumerate(keys)}
        self.items: list[list[str]] = [[] for _ in keys]
        for t, item in rows:
            self.items[place[t]].append(item)
        self.lengths = np.array([len(t) // 8 for t in keys], dtype=np.int64)
        self.terms = np.frombuffer(b"".join(t.ljust(8 * window, b"\0") for t in keys), dtype=_U).reshape(-1, window)
        count = often[(self.terms & _U((1 << FREQUENCY_BITS) - 1)).astype(np.int64)]
        inside = np.arange(window) < self.lengths[:, None]
        self.order = np.argsort(np.where(inside, count, np.iinfo(np.int64).max), axis=1, kind="stable").astype(np.int8)

    def present(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows all whose terms are among these, and the places of their terms there."""
        own = np.arange(len(self.terms))
        places = np.zeros(self.terms.shape, dtype=np.int64)
        for j in range(self.terms.shape[1]):
            if not len(own) or not len(terms):
                break
            k = self.order[own, j].astype(np.int64)
            ask = k < self.lengths[own]  # the padding comes last
            want = self.terms[own, k]
            at = np.minimum(np.searchsorted(terms, want), len(terms) - 1)
            places[own, k] = at
            own = own[~ask | (terms[at] == want)]
        return (own if len(terms) else own[:0]), places


def _matches(order: np.ndarray, lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Where a window begins: ``document << 32 | position``. lists: the postings of its terms, in the window's order."""
    first = int(order[0])
    start = lists[first]
    start = start[(start & 0xFFFFFFFF) >= first] - first
    for k in order[1:].tolist():
        if not len(start):
            return start
        have, want = lists[k], start + k
        if slop:
            at = np.searchsorted(have, want - slop)
            start = start[(at < len(have)) & (have[np.minimum(at, len(have) - 1)] <= want + slop)]
        else:
            at = np.searchsorted(have, want)
            start = start[have[np.minimum(at, len(have) - 1)] == want]
    return start


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as disjoint ones in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([new[1:], [True]])]


HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def search(index: DataFrame, block: Block, slop: int, last: bool) -> DataFrame:
    """The index with what the block's windows add to its items and hits; of the last block, (doc_id, n_words, items, hits) for each document."""
    shared = index.sparkSession.sparkContext.broadcast(block)
    id_type = index.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", HITS)])

    def find(seg) -> tuple[dict[int, set[str]], np.ndarray, np.ndarray]:
        block = shared.value
        posts = np.frombuffer(seg.postings, dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(seg.counts)]).astype(np.int64)
        items = defaultdict(set)
        for x in seg.items:
            items[x["doc"]].add(x["item"])
        before = np.frombuffer(seg.hits, dtype=np.int64).reshape(2, -1)
        starts, ends = [before[0]], [before[1]]
        own, places = block.present(np.asarray(seg.terms, dtype=np.int64).view(_U))
        for i in own.tolist():
            n = int(block.lengths[i])
            found = _matches(block.order[i, :n], [posts[bounds[t] : bounds[t + 1]] for t in places[i, :n].tolist()], slop)
            if len(found):
                starts.append(found)
                ends.append(found + n)
                for d in np.unique(found >> 32).tolist():
                    items[d].update(block.items[i])
        return items, *merged(np.concatenate(starts), np.concatenate(ends))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seg in batch.itertuples(index=False):
                items, starts, ends = find(seg)
                told = [{"doc": d, "item": i} for d in sorted(items) for i in sorted(items[d])]
                yield pd.DataFrame([seg._replace(items=told, hits=np.concatenate([starts, ends]).tobytes())])

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seg in batch.itertuples(index=False):
                items, starts, ends = find(seg)
                hits = defaultdict(list)
                for s, e in zip(starts.tolist(), ends.tolist()):
                    hits[s >> 32].append({"start": s & 0xFFFFFFFF, "end": e - (s >> 32 << 32)})
                n = len(seg.doc_ids)
                for a in range(0, n, 10_000):
                    part = range(a, min(n, a + 10_000))
                    yield pd.DataFrame({"doc_id": pd.Series([seg.doc_ids[d] for d in part], dtype=object), "n_words": [seg.n_words[d] for d in part], "items": [sorted(items.get(d, ())) for d in part], "hits": [hits.get(d, []) for d in part]})

    return index.mapInPandas(tell, schema) if last else index.mapInPandas(add, index.schema)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = 0, block: int = BLOCK, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """docs (doc_id, text) against bench (item_id, text): (doc_id, n_words, items, hits, n_hit) for each row of docs.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window, one
    without words none. Null texts have no words. Item ids are strings here, a null one is the empty
    string; rows of one id are one item. Rows of docs that repeat each get a result; an empty docs
    table gives an empty result, an empty benchmark no hits. Other columns are dropped.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    windows = materialize(windows_of(text, window), "benchmark-windows")
    blocks = -(-windows.count() // block) or 1
    index = build_index(docs, known_terms(text), segment_words)
    often = frequencies(index)
    for b in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("terms", "item"), F.lit(blocks)) == b) if blocks > 1 else windows
        rows = own.toArrow()
        told = search(index, Block(list(zip(rows["terms"].to_pylist(), rows["item"].to_pylist())), often, window), slop, last=b == blocks - 1)
        if b < blocks - 1:
            told = materialize(told, "positional-index")
            discard(index)
            index = told
    discard(windows)
    return told.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"]))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL
), w AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[k:k + 9], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM b WHERE len(words) > 0)
), p AS (
  SELECT rid, k, n, array_to_string(words[k:k + n - 1], ' ') AS phrase
  FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM w))
), h AS (
  SELECT p.rid, p.k, p.n, w.item_id FROM p JOIN w USING (n, phrase)
), c AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS place FROM h) GROUP BY rid
), i AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""
