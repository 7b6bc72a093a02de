"""A stored index of words, and the exact best texts by it without scoring all of them.

The index is two tables. ``texts`` is the forward side: each text's words with their counts.
``blocks`` is inverted: for each word its texts, those where it counts most first, in blocks of BLOCK
with the greatest count and the least text length in each. Each task that reads the forward side
inverts what it reads, PIECE counts at a time, so counts are never shuffled and a frequent word is in
as many pieces as there are. A segment is written once; further texts are further segments, and
writing a segment again replaces it.

A search adds up what a question's terms earn in a text, and returns the best. It looks at the heads
of the blocks first. The texts of each question's rarest terms are scored, and the k-th of them is a
score that a result has to reach. Terms whose greatest earnings together stay below it cannot make a
result alone: their blocks, of the longest lists, are not read at all, nor are blocks of other terms
whose head says that they cannot reach it. What the other blocks hold is scored exactly, from the
forward side. So the result is that of scoring everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .cut import cut
from .rank import FIELD_WEIGHTS, TOKEN_CHARS, query_tokens, small, top_k

BLOCK = 256
#: Counts of words in texts that are inverted in one go.
PIECE = 500_000
#: Postings of a question's rarest terms that are looked at for the score to reach, for each text wanted.
LEAD = 16
#: What a task counts words of or sums scores over: so many bytes of text, so many counts. There are as many tasks as the index asks
#: for, so that the memory of one does not grow with it.
TASK_BYTES, TASK_COUNTS = 16 << 20, 1_000_000
#: Texts that are scored first, by what the terms looked at earn in them, for each text wanted.
MOST_HOPEFUL = 4


@dataclass(frozen=True)
class Index:
    """blocks: (segment, word, part, block, n, max_tf, min_len, entries array<struct(key, field, tf, len)>); texts: (segment, key, field, len, counts array<struct(word, tf)>)."""

    blocks: DataFrame
    texts: DataFrame


def tasks(spark: SparkSession, size: int | None, each: int) -> int:
    """How many tasks share a size, each with so much of it: the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // each))


def _inverted(batches: Sequence[pa.RecordBatch], part: int, mean: float, block: int) -> pa.RecordBatch:
    """Blocks of the rows (key, field, len, word, tf), sorted by word."""
    rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    coded = rows["word"].dictionary_encode()
    by_word = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(by_word), dtype=np.int64)
    place[by_word.to_numpy()] = np.arange(len(by_word))
    word, tf, size = place[coded.indices.to_numpy()], rows["tf"].to_numpy(), rows["len"].to_numpy()
    order = np.lexsort((-(tf / (tf + size / mean)), word))
    word, tf, size = word[order], tf[order], size[order]
    begins = np.flatnonzero(np.diff(word, prepend=-1))
    within = np.arange(len(word)) - np.repeat(begins, np.diff(begins, append=len(word)))
    starts = np.flatnonzero(within % block == 0)
    entry = {"key": rows["key"].take(pa.array(order)), "field": rows["field"].take(pa.array(order)), "tf": pa.array(tf), "len": pa.array(size)}
    entries = pa.ListArray.from_arrays(pa.array(np.append(starts, len(word)), pa.int32()), pa.StructArray.from_arrays(list(entry.values()), list(entry)))
    out = {
        "word": coded.dictionary.take(by_word.take(pa.array(word[starts]))),
        "part": pa.array(np.full(len(starts), part), pa.int64()),
        "block": pa.array(within[starts] // block, pa.int32()),
        "n": pa.array(np.diff(starts, append=len(word)), pa.int64()),
        "max_tf": pa.array(np.maximum.reduceat(tf, starts)),
        "min_len": pa.array(np.minimum.reduceat(size, starts)),
        "entries": entries,
    }
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _pieces(mean: float, piece: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= piece:
                yield _inverted(held, part, mean, block)
                part, held, n = part + 1, [], 0
        if n:
            yield _inverted(held, part, mean, block)

    return work


def write_segment(texts: DataFrame, path: str, keys: Sequence[str], segment: str = "0") -> None:
    """texts (keys, field, text) to a segment of the index below path. Null texts have no words; texts of equal keys and field count together."""
    spark = texts.sparkSession
    # dealt out by text once; what follows until it is written needs no other shuffle
    size = texts.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"]
    dealt = texts.select(F.struct(*keys).alias("key"), "field", "text").repartition(tasks(spark, size, TASK_BYTES), "key").select("key", "field", F.explode_outer(words("text")).alias("word"))
    counted = dealt.groupBy("key", "field", "word").agg(F.count("word").alias("tf"))
    pair = F.when(F.col("word").isNotNull(), F.struct("word", F.col("tf").cast("int").alias("tf")))
    forward = counted.groupBy("key", "field").agg(F.sum("tf").cast("int").alias("len"), F.collect_list(pair).alias("counts"))
    forward.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/texts/segment={segment}")
    own = spark.read.schema(forward.schema).parquet(f"{path}/texts/segment={segment}")
    mean = own.agg(F.avg("len").alias("len")).first()["len"] or 1.0
    each = own.select("key", "field", "len", F.explode("counts").alias("c")).select("key", "field", "len", "c.word", "c.tf")
    entry = ", ".join(f"{n}: {each.schema[n].dataType.simpleString()}" for n in ("key", "field", "tf", "len"))
    blocks = each.mapInArrow(_pieces(mean, PIECE, BLOCK), f"word string, part long, block int, n long, max_tf int, min_len int, entries array<struct<{entry}>>")
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks/segment={segment}")


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/texts"))


def _holding(df: DataFrame, terms: DataFrame) -> DataFrame:
    """df (word, ...) with (t, factor) of each of the terms (term, t), of TOKEN_CHARS characters or more, that is part of the word; factor is 1.

    A word's substrings of that length meet the terms' beginnings where the word lies, so words aren't shuffled.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - TOKEN_CHARS + 1), lambda i: F.substr(F.col("word"), i, F.lit(TOKEN_CHARS))))
    begins = small(terms.withColumn("gram", F.substring("term", 1, TOKEN_CHARS)))
    met = df.where(F.length("word") >= TOKEN_CHARS).withColumn("gram", F.explode(grams)).join(begins, "gram").where(F.contains(F.col("word"), F.col("term")))
    return met.drop("gram", "term").withColumn("factor", F.lit(1.0))


_BLOCK_ID = ["segment", "word", "part", "block"]


@dataclass(frozen=True)
class Found:
    """top: (id, unit's columns, score, rank); report: (id, blocks, read), how many blocks the question's terms have and how many were read for it."""

    top: DataFrame
    report: DataFrame


def best(
    index: Index, wanted: DataFrame, dictionary: DataFrame | None, earned: Column, at_most: Column, unit: Sequence[str], k: int, digits: int | None = None, prune: bool = False, many: bool = False
) -> Found:
    """The k best units for each id. A text earns the sum over the question's terms of times x the most that one of the term's words earns in it; a unit has its best text's score.

    wanted: (id, term, times); dictionary: (term, word, factor), a word a term; without one a term
    stands for all words that it is part of, with the factor 1. ``earned`` is of field, tf, len and
    factor, ``at_most`` of max_tf, min_len and factor and nowhere below. Scores are rounded to
    ``digits`` if that is given. Units are columns of the texts' key; equal scores rank by them. With
    ``prune`` blocks that cannot hold a result aren't read; without, all blocks of the terms are, and
    their texts need no second look. The result is the same. What the words earn is dealt out once, by
    unit, so that pairs of ids and units aren't shuffled before the best in each part are left; where a
    unit may have very ``many`` texts, by text, and each unit's best is found in each part first.
    """
    order = [F.desc("score"), *[F.col(u) for u in unit]]
    # numbers that are stored, and are near each other, shuffle well
    names = cut(wanted.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    if dictionary is None:
        with_terms = lambda df: _holding(df, names)
    else:
        factors = cut(dictionary.join(names, "term").select("t", "word", "factor"), "dictionary")
        with_terms = lambda df: df.join(small(factors), "word")
    wanted = cut(wanted.join(names, "term").groupBy("id", "t").agg(F.sum("times").cast("double").alias("times")), "wanted")
    # a word that isn't in a dictionary may be told to several terms
    counts = index.blocks.select("word", "n") if dictionary is None else index.blocks.select("word", "n").join(small(factors), "word")
    parts = tasks(index.blocks.sparkSession, counts.agg(F.sum("n").alias("n")).first()["n"], TASK_COUNTS if dictionary is not None else TASK_COUNTS // 4)
    stored = cut if prune else lambda df, name: df  # without, these are only read for the report
    heads = stored(with_terms(index.blocks.select(*_BLOCK_ID, "n", "max_tf", "min_len")).select("t", *_BLOCK_ID, "n", at_most.cast("double").alias("most")), "heads")
    terms = heads.groupBy("t").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    known = stored(wanted.join(terms, "t").select("id", "t", "times", "n", (F.col("times") * F.col("most")).alias("most")), "known-terms")

    def held(blocks: DataFrame) -> DataFrame:
        """(id, key, score): what the terms in blocks (id, t, block's columns) earn in their texts."""
        entries = index.blocks.select(*_BLOCK_ID, "entries").join(small(blocks), _BLOCK_ID)
        entries = entries.withColumn("factor", F.lit(1.0)) if dictionary is None else entries.join(small(factors), ["t", "word"])
        each = entries.select("id", "t", "factor", F.explode("entries").alias("e")).select("id", "t", "factor", "e.*").repartition(parts, "key", "id")
        most = each.groupBy("key", "id", "t").agg(F.max(earned.cast("double")).alias("earned"))
        return most.join(small(wanted), ["id", "t"]).groupBy("key", "id").agg(F.sum(F.col("times") * F.col("earned")).alias("score"))

    def all_held() -> DataFrame:
        """(id, key, score) of all texts: what their terms earn is found once, whoever asks for them."""
        own = [] if many else list(unit)
        lists = index.blocks.select("word", "entries")
        # several terms are part of most words, so the words are dealt out, and meet the terms then
        lists = lists if dictionary is None else with_terms(lists)
        kept = [c for c in lists.columns if c != "entries"]
        each = lists.select(*kept, F.explode("entries").alias("e")).select(*kept, "e.*")
        dealt = each.select(*[F.col(f"key.{u}") for u in own], "*").repartition(parts, *(own or ["key"]))
        met = with_terms(dealt) if dictionary is None else dealt
        most = met.groupBy(*own, "key", "t").agg(F.max(earned.cast("double")).alias("earned"))
        return most.join(small(wanted), "t").groupBy(*own, "key", "id").agg(F.sum(F.col("times") * F.col("earned")).alias("score"))

    def scored(pairs: DataFrame) -> DataFrame:
        """(id, unit, score) of pairs (id, key), from the forward side of these texts, as far as any question asks for it."""
        pairs = cut(pairs, "candidates")
        forward = index.texts.join(pairs.select("key").distinct(), "key", "left_semi").select("key", "field", "len", F.explode("counts").alias("c"))
        hits = with_terms(forward.select("key", "field", "len", "c.word", "c.tf")).select("key", "t", earned.cast("double").alias("earned"))
        earns = hits.groupBy("key", "t").agg(F.max("earned").alias("earned"))
        met = earns.join(small(wanted), "t").join(pairs, ["key", "id"], "left_semi")
        return cut(by_unit(met.groupBy("key", "id").agg(F.sum(F.col("times") * F.col("earned")).alias("score"))), "scored")

    def by_unit(scores: DataFrame) -> DataFrame:
        own = scores.select("id", *[F.col(u) if u in scores.columns else F.col(f"key.{u}") for u in unit], (F.col("score") if digits is None else F.round("score", digits)).alias("score"))
        return own.groupBy("id", *unit).agg(F.max("score").alias("score"))

    every = heads.join(wanted.select("id", "t"), "t").select("id", "t", *_BLOCK_ID)
    blocks = every.select("id", *_BLOCK_ID).distinct().groupBy("id").agg(F.count("*").alias("blocks"))
    if not prune:
        return Found(top_k(by_unit(all_held()).where(F.col("score") > 0), ["id"], order, k), blocks.withColumn("read", F.col("blocks")))
    rarest = Window.partitionBy("id").orderBy("n", "t").rowsBetween(Window.unboundedPreceding, -1)
    lead = known.withColumn("before", F.coalesce(F.sum("n").over(rarest), F.lit(0))).where(F.col("before") < LEAD * k).select("id", "t")
    first = scored(held(cut(heads.join(small(lead), "t").select("id", "t", *_BLOCK_ID), "lead-blocks")).select("id", "key"))
    slack = 0.0 if digits is None else 10.0**-digits

    def reached(scores: DataFrame) -> DataFrame:
        """(id, least): the k-th score, where there are so many; no result is below it."""
        kth = top_k(scores, ["id"], order, k).groupBy("id").agg(F.min("score").alias("kth"), F.count("*").alias("m")).where(F.col("m") == k)
        return cut(kth.select("id", (F.col("kth") * (1 - 1e-9) - slack).alias("least")), "reached")

    reach = reached(first)
    # the longest lists first, as long as all of them together stay below
    longest = Window.partitionBy("id").orderBy(F.desc("n"), "t")
    sums = {"upto": F.sum("most").over(longest), "all": F.sum("most").over(Window.partitionBy("id")), "least": F.coalesce("least", F.lit(0.0))}
    judged = known.join(small(reach), "id", "left").withColumns(sums)
    judged = cut(judged.withColumn("can", F.col("upto") >= F.col("least")), "judged-terms")
    needed = judged.where("can").select("id", "t", "times", "least", (F.col("all") - F.col("most")).alias("others"))
    needed = heads.withColumnRenamed("most", "top").join(small(needed), "t").where(F.col("times") * F.col("top") + F.col("others") >= F.col("least")).select("id", "t", *_BLOCK_ID)
    needed = cut(needed, "needed-blocks")
    # what the terms that were not looked at may add at most
    rest = judged.groupBy("id").agg(F.sum(F.when(F.col("can"), 0.0).otherwise(F.col("most"))).alias("rest"), F.first("least").alias("least"))
    hopeful = cut(held(needed).join(small(rest), "id").where(F.col("score") * (1 + 1e-9) + F.col("rest") >= F.col("least")), "hopeful")
    # the most hopeful first: what they reach leaves few others
    leading = scored(top_k(hopeful, ["id"], [F.desc("score"), F.col("key")], MOST_HOPEFUL * k).select("id", "key"))
    raised = hopeful.drop("least").join(small(reached(leading)), "id", "left")
    second = scored(raised.where(F.col("score") * (1 + 1e-9) + F.col("rest") >= F.coalesce("least", F.lit(0.0))).select("id", "key"))
    read = needed.select("id", *_BLOCK_ID).distinct().groupBy("id").agg(F.count("*").alias("read"))
    report = blocks.join(read, "id", "left").select("id", "blocks", F.coalesce("read", F.lit(0)).alias("read"))
    return Found(top_k(second.where(F.col("score") > 0), ["id"], order, k), report)


def _field_weight(weights: dict[str, float]) -> Column:
    w = F.lit(1.0)
    for field, x in weights.items():
        w = F.when(F.col("field") == field, F.lit(float(x))).otherwise(w)
    return w


def best_lexical(index: Index, questions: DataFrame, unit: Sequence[str], k: int, weights: dict[str, float] | None = None, prune: bool = False) -> Found:
    """What lexical_scores() gives, the k best: over a question's distinct tokens, the weight of the best field that holds it as part of a word."""
    weights = FIELD_WEIGHTS if weights is None else weights
    tokens = query_tokens(questions).withColumnRenamed("token", "term").withColumn("times", F.lit(1))
    return best(index, tokens, None, _field_weight(weights), F.lit(max(1.0, *weights.values())), unit, k, prune=prune)


def best_documents(index: Index, questions: DataFrame, unit: Sequence[str], k: int = 5, prune: bool = False) -> Found:
    """What rank_documents() gives: a unit's score is its best text's, a text's the question's tokens (repeats count) that are part of its words."""
    tokens = query_tokens(questions, distinct=False).groupBy("id", F.col("token").alias("term")).agg(F.count("*").alias("times"))
    return best(index, tokens, None, F.lit(1.0), F.lit(1.0), unit, k, prune=prune, many=True)


def best_bm25(index: Index, questions: DataFrame, unit: Sequence[str], k: int, k1: float = 1.5, b: float = 0.75, digits: int | None = 6, prune: bool = False) -> Found:
    """What bm25() gives, the k best; each key has one text."""
    stats = index.texts.agg(F.count("*").alias("n"), F.avg("len").alias("len")).first()
    mean = stats["len"] or 1.0
    tokens = questions.select("id", F.explode(words("question")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("times"))
    wanted = small(tokens.select(F.col("term").alias("word")).distinct())
    df = index.blocks.select("word", "n").join(wanted, "word").groupBy("word").agg(F.sum("n").alias("df"))
    idf = F.log((float(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    dictionary = df.select(F.col("word").alias("term"), "word", idf.alias("factor"))
    weight = lambda tf, size: F.col("factor") * (F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(size) / mean)))
    return best(index, tokens, dictionary, weight("tf", "len"), weight("max_tf", "min_len"), unit, k, digits, prune)
