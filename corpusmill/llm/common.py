"""Shared helpers of the training-data operators: durable intermediates, text batches, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Table, materialize, path_of, shared_dir

#: Bytes that separate words: space and U+0009..U+000D; all other bytes belong to words.
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: Java form of a run of the same separators, for native plans.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
#: Stands for a null id inside sorts and joins; it comes before every real id.
NULL_ID = -(2**63)

#: The session's limit of an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

U64 = np.uint64


__all__ = ["IS_WORD", "NULL_ID", "SEPARATORS", "Table", "connected_components", "delete", "materialize", "mix64", "partitions", "random_u64", "release", "settle", "shared_dir", "short_batches", "slices", "tidy", "utf8", "word_hashes", "words_of"]


def delete(spark: SparkSession, path: str) -> None:
    fs, at = path_of(spark, path)
    fs.delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Scatters uint64 values (the usual xor-shift-multiply finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_u64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random words, from a rule."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The rows of a string column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(texts: pa.Array | list[bytes | None], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about `limit` bytes at most; a longer text is a range of its own."""
    lens = [len(t or b"") for t in texts] if isinstance(texts, list) else pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    lo = size = 0
    for i, n in enumerate(lens):
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(lens):
        yield lo, len(lens)


def release() -> None:
    """Gives freed memory of this Python process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def settle(spark: SparkSession) -> None:
    """Between the phases of a long operator: what finished jobs hold goes (plans on the driver, and with them their
    shuffle files on the executors)."""
    release()
    spark._jvm.System.gc()


def short_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """From now on an Arrow batch of this session holds about `limit` bytes, unless the session names a limit itself. By
    Spark's default it holds 10,000 texts; executors have a batch in memory several times over, outside the heap and in Python."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, limit)


def tidy(run):
    """A function of batches for mapInArrow that gives memory back when its task ends: idle workers stay small."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, start of each word, end of each word, index of each row's first word with the total at the end)."""
    buf = np.frombuffer(b"".join(t or b"" for t in texts), dtype=np.uint8)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t or b"") for t in texts], out=offsets[1:])
    is_word = IS_WORD[buf]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    full = offsets[1:] > offsets[:-1]
    at, end = offsets[:-1][full], offsets[1:][full] - 1
    first[at] = is_word[at]
    last[end] = is_word[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return buf, starts, ends, np.searchsorted(starts, offsets)


#: Bytes of a word that are hashed all at once; longer words are hashed one by one.
SHORT = 16


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A keyed 64-bit hash of every word's bytes: other seeds give hashes that collide elsewhere.

    Words of up to 16 bytes are two scattered 64-bit words (vectorised over the batch), longer ones XXH64.
    """
    if not len(starts):
        return np.zeros(0, dtype=U64)
    lens = ends - starts
    padded = np.concatenate([buf, np.zeros(SHORT, dtype=np.uint8)])
    heads = np.lib.stride_tricks.sliding_window_view(padded, SHORT)[starts]
    heads[np.arange(SHORT) >= lens[:, None]] = 0
    halves, keys = heads.view("<u8"), random_u64(3, 11 + seed)
    with np.errstate(over="ignore"):
        out = mix64((mix64(halves[:, 0] + keys[0]) ^ halves[:, 1]) + keys[1])
        out = mix64(out + lens.astype(U64) * U64(0x9E3779B97F4A7C15) + keys[2])
    long = np.flatnonzero(lens > SHORT)
    if len(long):
        key = int(keys[0])
        out[long] = [xxhash.xxh64_intdigest(buf[a:b], key) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def fingerprint_of(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum, to see whether an iteration changed anything."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("x")).first()
    return int(row["n"]), int(row["x"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of `edges` (src, dst: non-null longs).

    Alternating large-star and small-star rounds (Kiveris et al., "Connected components in MapReduce and
    beyond"). All state is in tables; minima are partially aggregated before the shuffle, and joins are
    plain equi-joins, whose hot keys adaptive execution splits. Each round is written to the shared folder.
    """
    a, b = F.col("src"), F.col("dst")
    now = Table(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = fingerprint_of(now.df)
    while mark[0]:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = Table(large)
        small_low = large.df.groupBy("u").agg(F.min("v").alias("v"))
        rest = large.df.join(small_low.withColumnRenamed("v", "m"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = Table(small_low.unionByName(rest).distinct())
        large.drop()
        mark, before = fingerprint_of(after.df), mark
        now.drop()
        now = after
        if mark == before:
            break
    roots = now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
