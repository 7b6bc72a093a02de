"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is the logistic function of ``b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``.
The pairwise part takes time linear in the features by the identity
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)``.

Features: each distinct word, hashed; each structure statistic (shares of character classes, of
distinct words, pairs and lines, lengths), cut into bins, so that the machine learns its shape and
its interplay with others; each metadata number, binned by its logarithm. Whole texts are read.

Fitting: on all labelled rows, dealt out by the hash of doc_id to parts of about PART_ROWS. Each part is
fitted in a task, from the same start; the model is the parts' mean by their rows. Scoring runs over batches on the executors; the broadcast model has a fixed size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, key_filter, materialize, table

WORD_BITS = 16
#: Labelled rows of a part, which a task holds at once, and numbers of a model that are averaged together.
PART_ROWS, BLOCK = 10_000, 1 << 13
THRESHOLD = 0.3
#: Bins of shares: their upper ends.
EDGES = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.11, 0.16, 0.25, 0.4, 0.55, 0.7, 0.85, 0.95])
BINS = len(EDGES) + 1
STATS = ("upper", "lower", "digit", "mark", "symbol", "space", "beyond", "distinct_words", "distinct_pairs", "distinct_lines", "top_word", "short_words", "word_chars", "words", "line_chars")
_CLASSES = np.zeros((256, 7), dtype=np.int64)
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"()-?!", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t\n\r\v\f", range(128, 256))):
    _CLASSES[list(_bytes), _k] = 1
_ALPHABET = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _log_share(x: float, top: float) -> float:
    """A count as a share of the range of its logarithm."""
    return min(1.0, np.log2(1.0 + x) / top)


def structure(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """The statistics of STATS, each from 0 to 1; all 0 for an empty text."""
    if not words:
        return [0.0] * len(STATS)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / len(raw)
    lines = [x for x in raw.split(b"\n") if x]
    pairs = len(words) - 1
    return [
        *shares.tolist(),
        len(counts) / len(words),
        len(set(zip(words, words[1:]))) / pairs if pairs else 1.0,
        len(set(lines)) / len(lines),
        max(counts.values()) / len(words),
        sum(n for w, n in counts.items() if len(w) <= 3) / len(words),
        _log_share(sum(len(w) * n for w, n in counts.items()) / len(words), 6.0),
        _log_share(len(words), 20.0),
        _log_share(len(raw) / len(lines), 14.0),
    ]


def featurize(text: str | None, meta: Sequence[float], word_bits: int = WORD_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values. Words have unit length together, and so have the statistics and the metadata."""
    raw = (text or "").encode()
    words = raw.translate(_ALPHABET).split()
    counts = Counter(words)
    mask = (1 << word_bits) - 1
    hashed = Counter()
    for w, n in counts.items():
        hashed[zlib.crc32(w) & mask] += n
    index = np.fromiter(hashed.keys(), dtype=np.int32, count=len(hashed))
    value = np.log1p(np.fromiter(hashed.values(), dtype=np.float32, count=len(hashed)))
    if len(value):
        value /= np.linalg.norm(value)
    bins = np.searchsorted(EDGES, structure(raw, words, counts)) + np.arange(len(STATS)) * BINS
    known = [0 if x is None or x != x else 1 + int(min(40, np.log2(1 + max(0.0, float(x))))) for x in meta]
    own = np.concatenate([bins, len(STATS) * BINS + np.arange(len(known)) * 64 + known]).astype(np.int32) + (1 << word_bits)
    return np.concatenate([index, own]), np.concatenate([value, np.full(len(own), len(own) ** -0.5, np.float32)])


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of x from each start to the next; no row is empty, as each has statistics."""
    return np.add.reduceat(x, starts, axis=0)


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    meta: int
    word_bits: int = WORD_BITS

    @classmethod
    def empty(cls, meta: int, rank: int = 8, word_bits: int = WORD_BITS, seed: int = 7) -> FactorisationMachine:
        n = (1 << word_bits) + len(STATS) * BINS + 64 * meta
        return cls(0.0, np.zeros(n, np.float32), np.random.default_rng(seed).normal(0, 0.05, (n, rank)).astype(np.float32), meta, word_bits)

    def numbers(self) -> np.ndarray:
        """All that is fitted, in one array of doubles."""
        return np.concatenate([[self.bias], self.weights, self.factors.ravel()]).astype(np.float64)

    def with_numbers(self, numbers: np.ndarray) -> FactorisationMachine:
        """A machine of this shape with what numbers() gave."""
        n = len(self.weights)
        return FactorisationMachine(float(numbers[0]), numbers[1 : n + 1].astype(np.float32), numbers[n + 1 :].reshape(self.factors.shape).astype(np.float32), self.meta, self.word_bits)

    def margin(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows lie end to end in index and value."""
        vx = self.factors[index] * value[:, None]
        pairs = (_sums(vx, starts) ** 2 - _sums(vx**2, starts)).sum(axis=1) / 2
        return self.bias + _sums(self.weights[index] * value, starts) + pairs

    def score(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])[:-1]])
        m = self.margin(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(m.astype(np.float64), -40, 40)))

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int | None = None, rate: float = 0.08, decay: float = 1e-5, batch: int = 64, seed: int = 7) -> None:
        """AdaGrad on the logistic loss, in an order drawn from the seed; unless told, as many epochs as make about 120,000 row visits."""
        if not len(rows):
            return
        epochs = epochs or min(200, max(10, 120_000 // len(rows)))
        share = (labels.sum() + 1) / (len(labels) + 2)
        self.bias = float(np.log(share / (1 - share)))
        rng = np.random.default_rng(seed)
        seen_w, seen_v, seen_b = np.full_like(self.weights, 1e-2), np.full_like(self.factors, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                index = np.concatenate([rows[k][0] for k in part])
                value = np.concatenate([rows[k][1] for k in part])
                sizes = np.array([len(rows[k][0]) for k in part])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                vx = self.factors[index] * value[:, None]
                sums = _sums(vx, starts)
                m = self.bias + _sums(self.weights[index] * value, starts) + (sums**2 - _sums(vx**2, starts)).sum(axis=1) / 2
                slope = ((1 / (1 + np.exp(-np.clip(m, -40, 40))) - labels[part]) / len(part)).astype(np.float32)
                each = np.repeat(slope, sizes) * value
                used, at = np.unique(index, return_inverse=True)
                gw = np.bincount(at, weights=each, minlength=len(used)).astype(np.float32) + decay * self.weights[used]
                pull = each[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
                by = np.argsort(at, kind="stable")
                gv = np.add.reduceat(pull[by], np.searchsorted(at[by], np.arange(len(used))), axis=0) + decay * self.factors[used]
                seen_w[used] += gw**2
                seen_v[used] += gv**2
                self.weights[used] -= rate * gw / np.sqrt(seen_w[used])
                self.factors[used] -= rate * gv / np.sqrt(seen_v[used])
                gb = float(slope.sum())
                seen_b += gb**2
                self.bias -= rate * gb / seen_b**0.5


def _meta_columns(df: DataFrame, meta: Sequence[str]) -> Column:
    return F.array(*[df[c].cast("double") for c in meta]) if meta else F.array().cast("array<double>")


def train(docs: DataFrame, labels: DataFrame, meta: Sequence[str] = ("n_chars",), part_rows: int = PART_ROWS, label_col: str = "quality") -> FactorisationMachine:
    """Fit on docs (doc_id, text, meta) with labels (doc_id, a 0/1 column).

    Null labels and ids are left out; rows of one id count by the mean of their labels, and of
    documents of one id the first text in order is taken. All of them are used, in parts of about
    ``part_rows`` ids: that bounds what a task holds, and the driver gets one model however many there are.
    Without any label the score is 0.5 plus noise of the untrained factors.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    known = materialize(known, "quality-labels")
    parts = max(1, -(-known.count() // part_rows))
    ids = docs.select("doc_id").schema[0].dataType
    # texts are only shuffled where there is a label
    labelled = docs.where(key_filter(known, "doc_id", 1 << 25)(F.col("doc_id"))) if known.schema["doc_id"].dataType == ids else docs
    texts = labelled.select("doc_id", "text", _meta_columns(docs, meta).alias("meta"))
    one = texts.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "meta")).alias("d"), F.first("y").alias("y"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [featurize(t, m) for t, m in zip(b["text"], b["meta"])]
            yield pd.DataFrame({"part": b["part"], "doc_id": b["doc_id"], "y": b["y"], "index": [i.tobytes() for i, _ in made], "value": [v.tobytes() for _, v in made]})

    begin = FactorisationMachine.empty(len(meta))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held).sort_values("doc_id")
        model = FactorisationMachine.empty(len(meta))
        model.fit([(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(rows["index"], rows["value"])], rows["y"].to_numpy())
        flat = model.numbers()
        blocks = [flat[at : at + BLOCK].tobytes() for at in range(0, len(flat), BLOCK)]
        yield pd.DataFrame({"block": range(len(blocks)), "part": rows["part"].iloc[0], "n": len(rows), "numbers": blocks})

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total = sum(np.frombuffer(x, np.float64) * n for x, n in zip(rows["numbers"], rows["n"]))
        return pd.DataFrame({"block": rows["block"].iloc[:1], "numbers": [(total / rows["n"].sum()).tobytes()]})

    made = one.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), "doc_id", "y", "d.text", "d.meta").mapInPandas(features, f"part int, doc_id {ids.simpleString()}, y int, index binary, value binary")
    # a part is a task
    each = made.repartitionById(parts, F.col("part")).mapInPandas(fit, "block int, part int, n long, numbers binary")
    got = each.groupBy("block").applyInPandas(mean, "block int, numbers binary").toPandas().sort_values("block")
    discard(known)
    return begin.with_numbers(np.concatenate([np.frombuffer(x, np.float64) for x in got["numbers"]])) if len(got) else begin


def with_score(df: DataFrame, model: FactorisationMachine, meta: Sequence[str] = ("n_chars",), text_col: str = "text", name: str = "score") -> DataFrame:
    """df with the score of its texts, from 0 to 1; a column of that name is replaced.

    Null and empty texts are scored by their statistics (all 0) and metadata; null metadata has a
    bin of its own. Rows that repeat get equal scores; an empty table gives an empty one.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fm = shared.value
        for texts, metas in batches:
            out, held, size = [], [], 0
            for t, m in zip(texts, metas):
                held.append(featurize(t, m, fm.word_bits))
                size += len(held[-1][0])
                if size > 200_000:
                    out.append(fm.score(held))
                    held, size = [], 0
            out.append(fm.score(held))
            yield pd.Series(np.concatenate(out))

    return df.withColumn(name, judge(F.col(text_col), _meta_columns(df, meta)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(spark: SparkSession, sf_dir: str) -> FactorisationMachine:
    """The model of the query and the pipeline: fitted on the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return train(table(spark, sf_dir, "documents"), labels)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_score(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), fitted(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
