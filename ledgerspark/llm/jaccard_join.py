"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Equal sets are one class, found by a 128-bit digest; all that follows works on classes, so a group of
exact copies costs no more than one document. Then

* small sets (up to a boundary) list all their subsets of the size that a partner must share; two
  small sets that meet in such a subset are linked by that alone;
* large sets scan inverted lists, which hold each set's rarest shingles only: as many as a set must
  list so that any two similar ones meet. An entry knows its place among its set's shingles, from
  which follows the largest partner that it can still bring; entries that can bring none are dropped.
* the boundary is where listing subsets would cost more than the lists, by the lengths of lists
  measured over all sets.

Only short inverted lists are turned into their pairs. Of longer ones, first each member is checked
against the most central one only; the links so found make components. What remains are the pairs of
a list in different components: round by round some members are checked against all others and then
leave the list, as nothing about them is open, until no open pair is left. A round makes no more than
``ROUND_PAIRS`` pairs an entry of the lists. So a group of near copies takes time in proportion to its
size, and no link between different components is lost: the components are exact. A list's members
meet in parts of ``PART``, so that no task gets a whole long list.

All this is done by the prints of the sets first, counts of shingles by bin of hash, whose difference
never exceeds that of the sets. Whole sets are then read, from the texts, only for documents that are
in a pair which passes, and the same is done with them.

How rare a shingle is comes from the documents of a fixed share of hashes, as levels in a table of
fixed size. Levels decide the order only; any order gives right results, as it is the same for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyBits, WordHashes, bounded_batches, discard, has_bit, has_low_bits, key_filter, low_bitmap, materialize, sweep, table

SHINGLE = 5
#: The least similarity is NUM / DEN.
NUM, DEN = 4, 5
#: One document in so many is looked at for how frequent shingles are.
LEVEL_SHARE = 8
LEVEL_BITS, SHARED_BITS = 22, 26
#: Beyond this size no set counts as small.
MOST_SMALL = 16
#: What checking a pair costs, in entries of a list.
CHECK_COST = 4
#: Lists of up to so many members are turned into pairs at once.
SHORT = 8
#: So many members of a list are dealt to one task; and in a round so many pairs are made for each entry of all lists.
PART, ROUND_PAIRS = 256, 8
#: Whole sets are stored with so many bytes of each 64-bit hash.
HASH_BYTES = 8
#: A set's print: how many of its shingles fall into each of so many bins, up to 255.
PRINT_BITS = 7

_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_U = np.uint64


_hashes = WordHashes()


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's distinct shingles, ascending; a text of fewer words is one shingle, one without words none."""
    words = text.encode().translate(_BYTES).split() if text else []
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=_U, count=len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, dtype=_U)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
        out *= _U(0xBF58476D1CE4E5B9)
        out ^= out >> _U(32)
    return np.unique(out)


def print_of(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> _U(64 - PRINT_BITS)).astype(np.int64), minlength=1 << PRINT_BITS), 255).astype(np.uint8).tobytes()


def pack(s: np.ndarray) -> bytes:
    """The upper HASH_BYTES bytes of ascending hashes."""
    return np.ascontiguousarray(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    x = np.zeros((len(raw) // HASH_BYTES, 8), dtype=np.uint8)
    x[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return x.reshape(-1).view(">u8").astype(_U)


def must_share(n: int, m: int) -> int:
    return -(-NUM * (n + m) // (NUM + DEN))


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


@lru_cache(maxsize=None)
def partners(n: int) -> tuple[tuple[int, int], ...]:
    """Sizes m of sets that can be similar to, and differ from, one of size n, with the number that both must share."""
    return tuple((m, must_share(n, m)) for m in range(-(-NUM * n // DEN), n * DEN // NUM + 1) if not (m == n and must_share(n, m) == n))


def subsets_of(n: int) -> int:
    return sum(comb(n, c) for _, c in partners(n))


def boundary(mean_partners: float) -> int:
    """The largest size up to which listing subsets costs no more than lists whose entries meet so many partners."""
    n = 0
    while n < MOST_SMALL and subsets_of(n + 1) <= prefix_size(n + 1) * (1 + CHECK_COST * mean_partners):
        n += 1
    return n


def _levels(docs: DataFrame, share: int) -> np.ndarray:
    """By the low bits of a shingle's hash: the logarithm of how often it occurs in one document of ``share``, 0 if less than twice."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 1000):
                yield pd.DataFrame({"s": np.concatenate([np.empty(0, _U), *map(shingles, b["text"].iloc[a : a + 1000])]).view(np.int64)})

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("level")), F.lit(share)) == 0).select("text")
    often = some.mapInPandas(explode, "s long").groupBy("s").count().where("count > 1")
    slots = often.select(F.col("s").bitwiseAND((1 << LEVEL_BITS) - 1).alias("slot"), F.floor(F.log2("count")).alias("level")).groupBy("slot").agg(F.max("level").alias("level"))
    out = np.zeros(1 << LEVEL_BITS, dtype=np.uint8)
    got = slots.toArrow()  # at most a row for each of the slots
    out[got["slot"].to_numpy()] = np.minimum(got["level"].to_numpy(), 255)
    return out


SIGNED = "doc_id {}, n int, fp binary, f long, score float, print binary, tokens array<long>, whole array<long>"


def _signatures(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """For each document: size, digest, its rarest shingles in order, how central it is (its mean level), and all shingles if it is small. Stored in the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = shared.value
        names = [x.split()[0] for x in SIGNED.split(", ")]
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].astype(object), b["text"]):
                s = shingles(text)
                fp = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                level = table_[s & _U((1 << LEVEL_BITS) - 1)]
                order = np.argsort(level, kind="stable")  # then by hash
                tokens = s[order[: prefix_size(len(s))]] if len(s) else s
                rows.append((None if pd.isna(doc_id) else doc_id, len(s), fp, int.from_bytes(fp[:8], "little", signed=True), float(level.mean()) if len(s) else 0.0, print_of(s), tokens.view(np.int64), s.view(np.int64) if len(s) <= MOST_SMALL else None))
                if len(rows) >= 2000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    ids = docs.schema["doc_id"].dataType.simpleString()
    signed = materialize(docs.select("doc_id", "text").mapInPandas(sign, SIGNED.format(ids)), "jaccard-signed")
    shared.destroy()
    return signed


def _entries(signed: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(fp, n, score, token, pos): the classes' entries in lists that may have other members. Stored in the shared folder."""
    shared = signed.sparkSession.sparkContext.broadcast(bitmap)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["tokens"].map(len).to_numpy()
            if not sizes.sum():
                continue
            tokens = np.concatenate([np.asarray(t, dtype=np.int64) for t in b["tokens"]])
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = np.repeat(np.arange(len(b)), sizes)
            at = np.flatnonzero(has_low_bits(shared.value, tokens, SHARED_BITS))
            for a in range(0, len(at), 100_000):
                part = at[a : a + 100_000]
                yield pd.DataFrame({"fp": b["fp"].to_numpy()[own[part]], "n": b["n"].to_numpy()[own[part]], "score": b["score"].to_numpy()[own[part]], "token": tokens[part], "pos": pos[part].astype(np.int32)})

    found = signed.where("n > 0").select("fp", "n", "score", "tokens").mapInPandas(keep, "fp binary, n int, score float, token long, pos int")
    entries = materialize(found.dropDuplicates(["fp", "token"]), "jaccard-entries")
    shared.destroy()
    return entries


def _most(n: Column, pos: Column) -> Column:
    """The largest size of a partner that an entry at this place can bring: must_share(n, m) <= n - pos."""
    return F.floor(((NUM + DEN) * (n - pos) - NUM * n) / NUM)


def _live(entries: DataFrame) -> DataFrame:
    """Entries that can bring a partner of their list, with ``most``; lists of one member go."""
    told = entries.withColumn("most", _most(F.col("n"), F.col("pos")))
    lists = told.groupBy("token").agg(F.count("*").alias("k"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("most").alias("brings")).where("k > 1").drop("k")
    fits = (F.col("most") >= F.col("least_n")) & (F.col("brings") >= F.col("n")) & (F.col("most_n") * DEN >= F.col("n") * NUM) & (F.col("n") * DEN >= F.col("least_n") * NUM)
    return told.join(lists, "token").where(fits).drop("least_n", "most_n", "brings")


def _pair_test(x: str, y: str, small: int) -> Column:
    c = lambda a, b: F.col(f"{a}.{b}")
    return (
        (c(x, "n") * DEN >= c(y, "n") * NUM)
        & (c(y, "n") * DEN >= c(x, "n") * NUM)
        & (c(x, "most") >= c(y, "n"))
        & (c(y, "most") >= c(x, "n"))
        & (F.greatest(c(x, "n"), c(y, "n")) > small)
        & (c(x, "comp") != c(y, "comp"))
    )


def _small_links(signed: DataFrame, small: int) -> DataFrame:
    """Links (a, b) between small sets that meet in a subset of the size that both must share."""

    def subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["fp", "key", "first", "equal"]
        for b in batches:
            rows = []
            for fp, whole in zip(b["fp"], b["whole"]):
                s = np.sort(np.asarray(whole, dtype=np.int64))
                n = len(s)
                for m, c in partners(n):
                    if m > small:
                        continue
                    for part in combinations(s.tolist(), c):
                        rows.append((fp, xxhash.xxh3_128_digest(np.array([min(n, m), max(n, m), *part], dtype=np.int64).tobytes()), n <= m, n == m))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    own = signed.where((F.col("n") > 0) & (F.col("n") <= small)).select("fp", "whole").dropDuplicates(["fp"])
    met = materialize(own.mapInPandas(subsets, "fp binary, key binary, first boolean, equal boolean"), "jaccard-subsets")
    # of a list for two sizes, each member is linked to the least one of the other size; of a list for one size, to the least
    lists = met.groupBy("key").agg(F.min(F.when(F.col("first"), F.col("fp"))).alias("low"), F.min(F.when(~F.col("first"), F.col("fp"))).alias("high"))
    partner = F.when(F.col("first") & ~F.col("equal"), F.col("high")).otherwise(F.col("low"))
    linked = met.join(lists, "key").select(F.col("fp").alias("a"), partner.alias("b"))
    return linked.where("b is not null and a <> b").distinct()


def _close(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prints differ by no more than similar sets of their sizes can."""

    @F.pandas_udf("boolean")
    def test(p: pd.Series, q: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1).astype(np.int16) for v in (p, q))
        sizes = n.to_numpy(dtype=np.int64) + m.to_numpy(dtype=np.int64)
        return pd.Series(np.abs(x - y).sum(axis=1) <= sizes - 2 * -(-NUM * sizes // (NUM + DEN)))

    first = pairs.join(prints.select(F.col("fp").alias("a"), F.col("print").alias("p"), F.col("n").alias("np")), "a")
    both = first.join(prints.select(F.col("fp").alias("b"), F.col("print").alias("q"), F.col("n").alias("nq")), "b")
    return both.where(test("p", "q", "np", "nq")).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets."""
    pairs = materialize(pairs, "jaccard-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp"))
    sets = sets.where(key_filter(ends, "fp")(F.col("fp")))

    @F.pandas_udf("boolean")
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), dtype=bool)
        for i, (p, q) in enumerate(zip(x, y)):
            a, b = unpack(p), unpack(q)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = int(np.count_nonzero(b[at] == a))
            out[i] = both * DEN >= NUM * (len(a) + len(b) - both)
        return pd.Series(out)

    first = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a")
    both = first.join(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
    found = materialize(both.where(test("x", "y")).select("a", "b"), "jaccard-links")
    discard(pairs)
    return found


def _is_stars(edges: DataFrame) -> bool:
    """Whether each vertex with an edge to a lesser one has just that edge, and that one has none."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (fp, comp): each vertex with the least of its component, by alternating large and small stars."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "jaccard-edges")
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "jaccard-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, edges = edges, materialize(small.where("a <> b").distinct(), "jaccard-edges")
        discard(before, large)
    return edges.select(F.col("a").alias("fp"), F.col("b").alias("comp"))


def _all_pairs(entries: DataFrame, small: int) -> DataFrame:
    found = entries.alias("x").join(entries.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.fp") < F.col("y.fp")) & _pair_test("x", "y", small))
    return found.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def _central(entries: DataFrame, turn: int) -> DataFrame:
    """One entry of each list: the most central, and in later turns one by a hash that differs each turn."""
    rank = F.struct("score", "fp") if turn == 0 else F.struct(F.xxhash64("fp", F.lit(turn)), F.col("fp"))
    found = entries.groupBy("token").agg(F.max_by(F.struct("fp", "n", "most", "comp", "k"), rank).alias("y"))
    return found.select("token", "y.*")


def _parts() -> Column:
    return F.ceil(F.col("k") / PART).cast("int")


def _parted(entries: DataFrame) -> DataFrame:
    """entries with the part of their list, of length k, that they are dealt to."""
    return entries.withColumn("part", F.pmod(F.xxhash64("fp"), _parts()).cast("int"))


def _to_parts(lists: DataFrame) -> DataFrame:
    """A row for each part of a list of length k."""
    return lists.withColumn("part", F.explode(F.sequence(F.lit(0), _parts() - 1)))


def _meet(entries: DataFrame, heads: DataFrame, small: int) -> DataFrame:
    """Pairs of each list's members with its heads. Members are dealt out by parts of their list, to each of which all heads of the list come; k is the list's length."""
    x, y = _parted(entries), _to_parts(heads)
    met = x.alias("x").join(y.alias("h").withColumn("y", F.struct("fp", "n", "most", "comp")).select("token", "part", "y"), ["token", "part"]).where(_pair_test("x", "y", small))
    return met.select(F.least(F.col("x.fp"), F.col("y.fp")).alias("a"), F.greatest(F.col("x.fp"), F.col("y.fp")).alias("b")).distinct()


def _between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    first = pairs.join(comps.select(F.col("fp").alias("a"), F.col("comp").alias("c")), "a", "left")
    both = first.join(comps.select(F.col("fp").alias("b"), F.col("comp").alias("d")), "b", "left")
    return both.where(F.coalesce("c", "a") != F.coalesce("d", "b")).select("a", "b")


def _rounds(lists: DataFrame, links: DataFrame, small: int, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """links and those that check() finds among the lists' pairs, as far as they join different components.

    Each round takes some members of every list that is still open, one at least, checks them with all
    others and takes them off: nothing about them is open then. It ends when no list is left.
    """
    known, turn = links, 0
    left = materialize(lists, "jaccard-left")
    total = left.count()
    while total:
        turn += 1
        comps = components(known)
        at = left.join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        # lists whose members are all of one component are done with
        seen = at.groupBy("token", "comp").agg(F.count("*").alias("n_"), F.max("k").alias("k"))
        open_ = seen.groupBy("token").agg(F.count("*").alias("c"), F.sum("n_").alias("now_k"), F.sum(F.col("n_") ** 2).alias("s"), F.max("k").alias("k")).where("c > 1")
        open_ = materialize(open_.select("token", "k", "now_k", ((F.col("now_k") ** 2 - F.col("s")) / 2).alias("pairs")), "jaccard-open-lists")
        pairs = open_.agg(F.sum("pairs")).first()[0] or 0
        if not pairs:
            break
        now = _parted(at).drop("k").join(_to_parts(open_).select("token", "part", F.col("now_k").alias("k")), ["token", "part"]).drop("part")
        now = materialize(now, "jaccard-open")
        share = min(1.0, ROUND_PAIRS * total / (2 * pairs))
        drawn = F.lit(True) if share >= 1 else F.pmod(F.xxhash64("fp", F.lit(-turn)), F.lit(1 << 20)) < int(share * (1 << 20))
        heads = now.where(drawn).select("token", "fp", "n", "most", "comp", "k")
        if share < 1:
            heads = materialize(heads.unionByName(_central(now, turn)).dropDuplicates(["token", "fp"]), "jaccard-heads")
        new = materialize(check(_meet(now, heads, small)), "jaccard-new")
        known = comps.select(F.col("fp").alias("a"), F.col("comp").alias("b")).unionByName(new)
        links = materialize(links.unionByName(new), "jaccard-all-links")
        if share >= 1:
            discard(now, open_)
            break
        rest = materialize(now.drop("comp").join(heads.select("token", "fp"), ["token", "fp"], "left_anti"), "jaccard-left")
        discard(now, heads, open_, left)
        left = rest
    discard(left)
    return links


def _list_links(docs: DataFrame, members: DataFrame, entries: DataFrame, prints: DataFrame, small: int, links: DataFrame) -> DataFrame:
    """links and those that the inverted lists add: all that connect different components."""
    live = _live(entries)
    lengths = live.groupBy("token").agg(F.count("*").alias("k"))
    live = materialize(live.join(lengths, "token"), "jaccard-lists").withColumn("comp", F.col("fp"))
    long = live.where(F.col("k") > SHORT)
    # by prints alone: every link is a pair that passes, or lies within a component of such pairs
    near = materialize(_close(_all_pairs(live.where(F.col("k") <= SHORT), small).unionByName(_meet(long, _central(long, 0), small)).distinct(), prints), "jaccard-near")
    near = _rounds(long.drop("comp"), near, small, lambda pairs: _close(pairs, prints))
    wanted = materialize(near.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "jaccard-wanted")
    sets = materialize(_sets(docs, members, wanted), "jaccard-sets")
    sweep(docs.sparkSession)
    # by whole sets: each class with the most central of its partners first, then what else joins two components
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ranked = both.join(prints.select(F.col("fp").alias("b"), "score"), "b")
    chosen = ranked.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialize(links.unionByName(_similar(chosen, sets)), "jaccard-all-links")
    links = materialize(links.unionByName(_similar(_between(near, components(links)), sets)), "jaccard-all-links")
    rest = materialize(long.drop("comp").join(wanted, "fp"), "jaccard-rest")
    links = _rounds(rest, links, small, lambda pairs: _similar(_close(pairs, prints), sets))
    discard(sets, live, rest)
    return links


def jaccard_components(docs: DataFrame, level_share: int = LEVEL_SHARE) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_shingles, component_id), a row for each row of docs.

    Two texts are linked when their shingle sets have a Jaccard similarity of NUM / DEN or more;
    component_id is the smallest doc_id reachable by links. Null and empty texts, and those without
    words, have no shingles and are linked with nothing: component_id is their own doc_id. A null
    doc_id takes part; it is the smallest only where there is no other. Rows that repeat are equal
    texts and so linked. An empty table gives an empty one. Other columns are dropped.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = _signatures(docs, _levels(docs, level_share))
    lists = signed.select("f", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("f").alias("c"), F.max("f").alias("d"))
    bitmap = low_bitmap(lists.where("c <> d"), "token", SHARED_BITS)
    entries = _entries(signed, bitmap)
    n_entries = signed.agg(F.sum(F.size("tokens"))).first()[0] or 0
    met = entries.groupBy("token").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
    small = boundary(met / max(1, n_entries))
    prints = materialize(signed.where("n > 0").select("fp", "n", "score", "print").dropDuplicates(["fp"]), "jaccard-prints")
    links = materialize(_small_links(signed, small), "jaccard-all-links")
    members = materialize(signed.select("doc_id", "n", "fp"), "jaccard-members")
    discard(signed)
    comps = components(_list_links(docs, members, entries, prints, small, links))
    discard(entries, prints)

    classes = members.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("low")).join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    classes = materialize(classes, "jaccard-classes")
    lowest = classes.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "comp").select("fp", "component_id")
    full = members.where("n > 0").select("doc_id", "n", "fp").join(named, "fp")
    none = members.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(none)


def _sets(docs: DataFrame, members: DataFrame, fps: DataFrame) -> DataFrame:
    """(fp, set): the whole sets of the classes in fps, and by chance of some others, read from the texts once more.

    Of each class only the documents with its smallest doc_id are read; a bitmap tells most others off.
    """
    one = members.join(fps, "fp").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    known = KeyBits(one.select(own.alias("key")), "key", 1 << SHARED_BITS)
    shared = known.shared

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # tested here, as a filter of its own would take another Python worker for each task
            sets = [s for s in map(shingles, b["text"][has_bit(shared.value, b["slot"].to_numpy())]) if len(s)]
            yield pd.DataFrame({"fp": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "set": [pack(s) for s in sets]})

    found = docs.select(known.slot(own).alias("slot"), "text").mapInPandas(build, "fp binary, set binary")
    return found.groupBy("fp").agg(F.first("set").alias("set"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(words[k:k + 4], ' ') AS shingle
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS k FROM d WHERE len(words) > 0)
), n AS (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), l AS (
  SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.shingle = b.shingle JOIN n na ON na.rid = a.rid JOIN n nb ON nb.rid = b.rid
  GROUP BY a.rid, b.rid, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT r.a AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)
"""
