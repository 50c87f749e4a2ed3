"""Shared helpers: table access, written intermediates, Arrow row slices, block pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


#: Bytes of a row group of a written intermediate.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors and keeps column pruning."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # a writer holds a row group of every open file in memory
    df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df``, written, with a column that numbers the rows, and that column's name."""
    row = "row_number"
    while row in df.columns:
        row += "_"
    return saved(df.withColumn(row, F.monotonically_increasing_id()), name), row


#: About so many bytes of a batch become Python objects at once.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[list[list]]:
    """Column lists of at most ``size`` rows, and about ``SLICE_BYTES``, of each batch."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, min(size, rows * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, rows, step):
            part = batch.slice(at, step)
            yield [column.to_pylist() for column in part.columns]


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; what it held is given back to the system at the end of
    the task, because Python workers live on from stage to stage."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return tidied


def _release() -> None:
    import ctypes
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)


def remainder(column: str, modulus: int):
    """crc32(doc_id as text) mod ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64), vectorised."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Memo(dict):
    """A bounded memo of ``make(key)``: cleared when full, long keys are not kept;
    results never depend on it."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class WordHashes:
    """64-bit hash of every word, with a memo that lives as long as its owner (a task)."""

    def __init__(self, limit: int = 150_000):
        import xxhash
        self.memo = Memo(xxhash.xxh3_64_intdigest, limit)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of every run of ``size`` words; a shorter sequence counts as one shingle."""
    if len(words) == 0:
        return words
    width = min(size, len(words))
    h = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        h = mix64(h + words[j:j + len(h)] + np.uint64(j + 1))
    return h


def block_pairs(members: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """Deal the members of every group into blocks of about ``block`` rows and
    copy each to every pair of blocks it takes part in.

    ``members`` needs a column ``n_members`` (size of the group). Adds ``pair``
    ("group:i:j") and ``side`` (0: block i, 1: block j, 2: both, i = j), so that
    no group reaches one task whole, whatever its size.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_members") / F.lit(block))).cast("int")
    own = F.pmod(F.xxhash64(F.col(member)), F.col("_k")).cast("int")
    out = (members.withColumn("_k", blocks).withColumn("_own", own)
           .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))))
    lo, hi = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = (F.when(F.col("_own") == F.col("_other"), 2)
            .when(F.col("_own") < F.col("_other"), 0).otherwise(1))
    return (out.withColumn("pair", F.concat_ws(":", F.col(group).cast("string"), lo, hi))
            .withColumn("side", side).drop("_k", "_own", "_other"))


#: A-Z to a-z; everything below 0x80 that is no letter or digit to a blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20 for b in range(256))


def bloom_bits(keys: int, per_key: int = 16, most: int = 1 << 29) -> int:
    return min(most, 1 << (per_key * max(1, keys)).bit_length())


def bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """One bit per key hash (the first column, a long), or-ed together over the
    partitions in a tree; its size is fixed by ``bits`` whatever the number of keys."""
    def part(batches):
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy() & (bits - 1)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())],
                                             names=["bits"])

    found = keys.mapInArrow(part, "bits binary").rdd.map(
        lambda r: np.frombuffer(r[0], np.uint8))
    return found.treeAggregate(np.zeros(bits // 8, np.uint8), np.bitwise_or, np.bitwise_or, 2)


def bloom_hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the (unsigned) keys may be in the filter; none that is in it is missed."""
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)]
            >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
