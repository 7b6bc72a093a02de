"""What the operators of this subpackage share: the shared folder, lineage cuts, word patterns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local session, as in tests; on a cluster it would
    be another one on each machine, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgerspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths below the shared folder that this session made and nobody has deleted yet.
_made: dict[str, None] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = None
    return path


#: For tables of few long rows: a row group is closed by its bytes after any row. Else Parquet looks at its size after a hundred
#: rows only, and a reader takes in as many of a group's rows at once as it has.
LONG_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """What scratch() gave and is still there, in order."""
    return list(_made)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete paths of scratch(), which nothing may read any more, and let Spark drop shuffle files that no plan needs."""
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        _made.pop(path, None)
    sweep(spark)


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote for these tables, which nothing may read any more."""
    spark = tables[0].sparkSession
    found = {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}
    name = lambda path: path.rpartition("/")[2]
    delete(spark, [p for p in made() if name(p) in {name(f) for f in found}])


def sweep(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver has collected what refers to them; ask for that now, and give back the driver's freed memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


#: Words are runs of 0-9, a-z (A-Z lower-cased) and all beyond ASCII. On UTF-8 bytes that is one translation.
LOWER_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_blocks(text: str | None, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The LOWER_WORDS of a text in order, those of about so many bytes at a time; none for a null text."""
    raw, at = (text or "").encode().translate(LOWER_WORDS), 0
    while at < len(raw):
        end = raw.find(b" ", at + block)
        end = len(raw) if end < 0 else end
        if words := raw[at:end].split():
            yield words
        at = end


BATCH_BYTES = 1 << 22


def bounded_batches(spark: SparkSession) -> None:
    """Send about BATCH_BYTES to a Python worker at once, where nobody has set a bound: texts may be long.

    This is a setting of the session, as plans are run after the operators return.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores until it is none of those taken, case aside."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


class WordHashes(dict):
    """64-bit hashes of words, those met last kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def low_bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """The low bits of a long column as a bitmap of 2 ** bits bits, however many keys there are."""
    at = keys.select((F.col(column).bitwiseAND((1 << bits) - 1) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect()
    out = np.zeros(1 << bits >> 3, dtype=np.uint8)
    for p in parts:
        one = np.frombuffer(p["map"], dtype=np.uint8)
        out[(p["bucket"] - 1) * len(one) : p["bucket"] * len(one)] = one
    return out


def has_low_bits(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    at = keys & ((1 << bits) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slot(c: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(bits)) + 1


class KeyBits:
    """Which values stand in keys[column], as a bitmap of fixed size: true for each of them, and rarely for others.

    The keys are hashed to ``bits`` bits, which Spark gathers in bitmaps; what comes to the driver and
    goes to the executors is bits / 8 bytes, however many keys there are. With far more keys than
    bits the test lets all pass, which costs time and changes no result.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = 1 << 23):
        self.bits = bits
        at = keys.select(_slot(F.col(column), bits).alias("at"))
        parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect()
        packed = np.zeros(-(-bits // 8), dtype=np.uint8)
        for p in parts:
            one = np.frombuffer(p["map"], dtype=np.uint8)
            begin = (p["bucket"] - 1) * len(one)
            packed[begin : begin + len(one)] = one[: len(packed) - begin]
        self.shared = keys.sparkSession.sparkContext.broadcast(packed)

    def slot(self, c: Column) -> Column:
        return _slot(c, self.bits)


def has_bit(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    x = slots - 1
    return (packed[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1


def key_filter(keys: DataFrame, column: str, bits: int = 1 << 23):
    """KeyBits as a test from Column to Column."""
    known = KeyBits(keys, column, bits)
    shared = known.shared

    @F.pandas_udf("boolean")
    def test(slots: pd.Series) -> pd.Series:
        return pd.Series(has_bit(shared.value, slots.to_numpy()))

    return lambda c: test(known.slot(c))
