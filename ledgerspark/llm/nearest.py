"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Projection: vectors are multiplied by a few random directions of the 2-stable (normal) distribution.
For two vectors at distance d, the squared distance of their projections, divided by d squared, has
the chi-square distribution with as many degrees of freedom.

Index: a kd-tree over a bounded sample of projections cuts the projected space into cells; each cell's
rows are dealt to segments of bounded size, each with a kd-tree of its own over projections, its leaves
with their boxes. All rows are indexed; of equal vectors those with the k + 1 smallest ids, as no other
can be among k neighbours.

Search: in a segment the leaves come by the distance of their boxes from the query's projection, so the
projected neighbours are met in rings of growing radius, and are verified by their true distance. Once
the radius, squared and divided by the squared distance of the k-th neighbour so far, has passed the
chi-square quantile ``sure``, a nearer vector that has not been met would have to be one of those rare
ones whose projection is that far off: the search stops. A query is first asked in its own cell, which
gives a k-th distance; then in the other cells whose boxes are not beyond the radius where it would stop.
Both times queries come in blocks to the segments they ask.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, materialize, table

TOP, QUERY_STEP = 10, 100
#: Random directions (an even number), the seed of their numbers, and the share of neighbours that a search is to meet.
DIMENSIONS, SEED, SURE = 8, 7, 0.93
#: Rows of the sample that the cells are cut by, rows that a cell is to have, most cells, rows of a segment, of a leaf, queries of a block.
SAMPLE, CELL_ROWS, CELLS, SEGMENT_ROWS, LEAF_ROWS, QUERY_BLOCK = 50_000, 16_384, 4096, 16_384, 256, 256


def chi_square_quantile(p: float, freedom: int) -> float:
    """Where the chi-square distribution with an even number of degrees of freedom reaches p."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def leaves(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """Places of the points by leaf of a kd-tree: halved at the median of the widest axis until a leaf has no more than ``rows``."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= rows:
            out.append(own)
            continue
        axis = int(np.argmax(np.ptp(points[own], axis=0)))
        own = own[np.argpartition(points[own, axis], len(own) // 2)]
        todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return out


class Cells:
    """A kd-tree whose leaves are numbered: each halves its part of the sample at the median of the widest axis."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.cut, self.count = [], [], 0
        self.kids: list[tuple[int, int]] = []
        self._grow(sample, cells)

    def _grow(self, points: np.ndarray, cells: int) -> int:
        """The node's number, or for a leaf -1 minus its own."""
        if cells > 1 and len(points) > 1:
            axis = int(np.argmax(np.ptp(points, axis=0)))
            cut = float(np.median(points[:, axis]))
            left = points[:, axis] < cut
            if left.any():
                node = len(self.axis)
                self.axis.append(axis), self.cut.append(cut), self.kids.append((0, 0))
                self.kids[node] = (self._grow(points[left], cells // 2), self._grow(points[~left], cells - cells // 2))
                return node
        self.count += 1
        return -self.count

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.zeros(len(points), dtype=np.int64) if self.axis else np.full(len(points), -1)
        axis, cut, kids = np.array(self.axis, dtype=int), np.array(self.cut), np.array(self.kids).reshape(-1, 2)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = points[inner, axis[node]] >= cut[node]
            at[inner] = kids[node, right.astype(int)]
        return -at - 1


def usable(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding) to (vec_id, vector array<double>): distinct rows with an id and a vector of numbers throughout, not all 0."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.alias("vector")).where("vec_id is not null").where(F.coalesce(fine, F.lit(False))).distinct()


def usual_length(vectors: DataFrame) -> int:
    """The length that most vectors have, of equally frequent ones the greatest; 1 without any."""
    found = vectors.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return found["n"] if found else 1


def _as_matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


def _project(directions: np.ndarray):
    """A mapInPandas function from (vec_id, vector) to ROW, in cell 0."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _as_matrix(b["vector"])
                y = x @ directions
                yield pd.DataFrame({"vec_id": b["vec_id"], "vector": [v.tobytes() for v in x], "projected": [v.tobytes() for v in y], "cell": 0})

    return go


ROW = "vec_id long, vector binary, projected binary, cell long"


def _matrix(rows: list[bytes] | pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(-1, width)


def build_segments(rows: DataFrame, width: int, dims: int) -> DataFrame:
    """rows (ROW, segment) to a row a segment: (cell, segment, ids, vectors, points, sizes, low, high), the rows in the order of the kd-tree's leaves; stored."""

    def build(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(b["projected"], dims)
        found = leaves(points, LEAF_ROWS)
        order = np.concatenate(found)
        own = [points[f] for f in found]
        one = {
            "cell": int(key[0]),
            "segment": int(key[1]),
            "ids": b["vec_id"].to_numpy(dtype=np.int64)[order].tobytes(),
            "vectors": _matrix(b["vector"], width)[order].tobytes(),
            "points": points[order].tobytes(),
            "sizes": np.array([len(f) for f in found], dtype=np.int64).tobytes(),
            "low": np.array([p.min(axis=0) for p in own]).tobytes(),
            "high": np.array([p.max(axis=0) for p in own]).tobytes(),
        }
        return pd.DataFrame({c: [v] for c, v in one.items()})

    schema = "cell long, segment long, ids binary, vectors binary, points binary, sizes binary, low binary, high binary"
    return materialize(rows.groupBy("cell", "segment").applyInPandas(build, schema), "kd-segments")


class Tree:
    """A segment, to be searched."""

    def __init__(self, row, width: int, dims: int):
        read = lambda c, w: np.frombuffer(getattr(row, c), dtype=np.float64).reshape(-1, w)
        self.ids = np.frombuffer(row.ids, dtype=np.int64)
        self.vectors, self.points, self.low, self.high = read("vectors", width), read("points", dims), read("low", dims), read("high", dims)
        self.ends = np.cumsum(np.frombuffer(row.sizes, dtype=np.int64))

    def near(self, query: np.ndarray, point: np.ndarray, own: int, kth: float, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, int]:
        """The k nearest that are met (ids, squared distances), and how many were verified; own is left out, kth the squared distance known from elsewhere."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        ring = (gap**2).sum(axis=1)
        order = np.argsort(ring, kind="stable")
        slack = 1e-9 * (1 + point @ point)  # equal vectors may be projected with other roundings
        ids, far = np.empty(0, dtype=np.int64), np.empty(0)
        waiting, radius = np.empty(0, dtype=np.int64), np.empty(0)
        verified = 0
        for j in range(len(order) + 1):
            # all projected neighbours up to here are in the leaves that are open
            reach = ring[order[j]] if j < len(order) else np.inf
            met = radius <= np.minimum(reach, stop * kth + slack)
            if met.any():
                at = waiting[met]
                waiting, radius = waiting[~met], radius[~met]
                d = ((self.vectors[at] - query) ** 2).sum(axis=1)
                verified += len(at)
                ids, far = np.concatenate([ids, self.ids[at]]), np.concatenate([far, d])
                best = np.lexsort((ids, far))[:k]
                ids, far = ids[best], far[best]
                if len(far) == k:
                    kth = min(kth, far[-1])
            if j == len(order) or reach > stop * kth + slack:
                break
            end = self.ends[order[j]]
            at = np.arange(self.ends[order[j] - 1] if order[j] else 0, end)
            at = at[self.ids[at] != own]
            waiting = np.concatenate([waiting, at])
            radius = np.concatenate([radius, ((self.points[at] - point) ** 2).sum(axis=1)])
        return ids, far, verified


def ask(segments: DataFrame, queries: DataFrame, width: int, dims: int, k: int, stop: float) -> DataFrame:
    """queries (query_id, vector, projected, kth, cell) in the segments of their cells: (query_id, vec_id, far, verified); stored.

    Queries come to a segment in blocks of QUERY_BLOCK or so.
    """
    # by hash into as many blocks as the cell's queries need
    sizes = queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    dealt = queries.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("blocks")))
    blocks = dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("query_id", "vector", "projected", "kth")).alias("queries")).drop("block")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                tree = Tree(row, width, dims)
                out = []
                for q in row.queries:
                    ids, far, n = tree.near(np.frombuffer(q["vector"]), np.frombuffer(q["projected"]), q["query_id"], q["kth"], k, stop)
                    out.append(pd.DataFrame({"query_id": q["query_id"], "vec_id": ids, "far": far, "verified": n}))
                yield pd.concat(out)

    return materialize(segments.join(blocks, "cell").mapInPandas(find, "query_id long, vec_id long, far double, verified long"), "kd-found")


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, sure: float = SURE, dims: int = DIMENSIONS, seed: int = SEED, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """For each of queries (vec_id, embedding) its k nearest of vectors (vec_id, embedding) that are met: (query_id, rank, vec_id, score).

    score is the Euclidean distance, in double precision; nearest first, ties to the smaller vec_id. Rows
    without id, and vectors that are null, zero, or hold null or a number that isn't finite, take no
    part, nor do those of another length than most vectors. A query's own id is no candidate; rows that are
    equal count once. Each true neighbour is met with probability ``sure`` or more. Empty tables give an
    empty result. Other columns are dropped.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    own = usable(vectors)
    width = usual_length(own)
    # of equal vectors, no more than k + 1 can be among anybody's neighbours
    same = Window.partitionBy("vector").orderBy("vec_id")
    kept = own.where(F.size("vector") == width).withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
    directions = np.random.default_rng(seed).standard_normal((width, dims))
    raw = materialize(kept.mapInPandas(_project(directions), ROW), "kd-projected")
    n = raw.count()
    cells = min(CELLS, -(-n // cell_rows))
    taken = raw.select("projected").orderBy(F.xxhash64("vec_id")).limit(sample).toPandas() if cells > 1 else pd.DataFrame({"projected": []})
    tree = Cells(_matrix(taken["projected"], dims), cells)
    placed = _with_cell(raw, tree, dims)
    segment = F.pmod(F.xxhash64("vec_id"), F.greatest(F.ceil(F.col("rows") / segment_rows), F.lit(1)))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("rows"))  # a row a cell
    segments = build_segments(placed.join(F.broadcast(sizes), "cell").withColumn("segment", segment).drop("rows"), width, dims)
    wanted = usable(queries).where(F.size("vector") == width)
    asked = materialize(_with_cell(wanted.mapInPandas(_project(directions), ROW), tree, dims).select(F.col("vec_id").alias("query_id"), "vector", "projected", F.col("cell")), "kd-queries")
    stop = chi_square_quantile(sure, dims)
    home = ask(segments, asked.withColumn("kth", F.lit(float("inf"))), width, dims, k, stop)
    best = Window.partitionBy("query_id").orderBy("far", "vec_id")
    found = home.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kth = found.groupBy("query_id").agg(F.max("far").alias("far"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") == k, F.col("far")).otherwise(float("inf")).alias("kth"))
    known = asked.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
    away = ask(segments, _other_cells(known, segments, dims, stop), width, dims, k, stop)
    both = home.unionByName(away).select("query_id", "vec_id", "far").distinct()
    ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = materialize(ranked.select("query_id", "rank", "vec_id", F.sqrt("far").alias("score")), "nearest")
    discard(raw, segments, asked, home, away)
    return out


def _with_cell(rows: DataFrame, tree: Cells, dims: int) -> DataFrame:
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=tree.of(_matrix(b["projected"], dims)))

    return rows.mapInPandas(go, ROW)


def _other_cells(queries: DataFrame, segments: DataFrame, dims: int, stop: float) -> DataFrame:
    """queries (query_id, vector, projected, kth, cell), once for each other cell whose box may hold a projection within the radius where the search stops.

    The boxes, one a cell, are few: there are CELLS at most.
    """

    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                low, high = (np.frombuffer(x).reshape(-1, dims) for x in (r.low, r.high))
                yield pd.DataFrame({"cell": r.cell, "axis": range(dims), "low": low.min(axis=0), "high": high.max(axis=0)})

    by_axis = segments.select("cell", "low", "high").mapInPandas(axes, "cell long, axis long, low double, high double")
    told = by_axis.groupBy("cell", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values(["cell", "axis"])
    shared = queries.sparkSession.sparkContext.broadcast((told["cell"].to_numpy()[::dims].tolist(), told["low"].to_numpy().reshape(-1, dims), told["high"].to_numpy().reshape(-1, dims)))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, low, high = shared.value
        for b in batches:
            for q in b.itertuples(index=False):
                point = np.frombuffer(q.projected)
                gap = np.maximum(np.maximum(low - point, point - high), 0)
                near = np.flatnonzero((gap**2).sum(axis=1) <= stop * q.kth + 1e-9 * (1 + point @ point))
                other = [names[i] for i in near.tolist() if names[i] != q.cell]
                yield pd.DataFrame({"query_id": q.query_id, "vector": q.vector, "projected": q.projected, "kth": q.kth, "cell": pd.Series(other, dtype="int64")})

    return queries.mapInPandas(go, "query_id long, vector binary, projected binary, kth double, cell long")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0)).select("query_id", "rank", "vec_id", "score")
