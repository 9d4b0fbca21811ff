"""Substring dedup: exact repeated word windows, found behind a count-min prefilter.

Pass 1: every task sketches the window hashes of its rows; the partition sketches are merged by cell
range. Counts saturate at two, all that is asked of them. Pass 2: only windows that every row of the
merged sketch puts at two or more are grouped exactly; a count-min sketch never underestimates, so no
repeated window is lost. Within a task all occurrences but the earliest are settled on the spot, hence a
window reaches the shuffle at most once a task however often it occurs. Pass 3 cuts the words.

Scale: the sketch is the only thing sent to all tasks, and `max_sketch_bytes` bounds it. Beyond that
size the sketch passes more windows (never fewer), so results stay the same and the exact pass grows.
"""

from __future__ import annotations

import hashlib
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, U64, materialize, mix64, partitions, short_batches, slices, tidy, utf8, word_hashes, words_of

#: Rows of the sketch; cells of a range, the unit in which sketches are merged.
DEPTH, RANGE_BITS = 2, 20
#: Windows gathered in a task before it hands them on.
FLUSH = 1 << 22
_A = U64(0x9E3779B97F4A7C15 | 1)
#: Rows of a batch that a task hands on.
HANDED = 1 << 17
#: A span of windows is one long: its start, and below in so many bits its length (longer ones are cut up).
SPAN = 24
#: Marks, in the second hash, spans that were settled inside a task.
SETTLED = -1


def _windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` word hashes: runs of doubling length, scattered at each joint like the nodes of a tree."""
    out, at = None, 0
    power, length, left = hashes, 1, width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                here = power[at:]
                out = here if out is None else mix64(out[: len(here)] * _A + here)
                at += length
            left >>= 1
            if left:
                power = mix64(power[: len(power) - length] * _A + power[length:])
                length *= 2
    return out


def window_hashes(texts: list[bytes | None], width: int, both: bool = True):
    """(row, start word, 64-bit hash, 31-bit hash) of every window of `width` words inside one row.

    The two hashes start from word hashes of different keys, so what collides in one does not in the other:
    95 independent bits. `both`: else the second hash is left out (None).
    """
    buf, starts, ends, firsts = words_of(texts)
    counts = np.diff(firsts)
    if len(starts) < width:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int32))
    inside = np.arange(len(starts)) - np.repeat(firsts[:-1], counts)
    whole = (inside + width <= np.repeat(counts, counts))[: len(starts) - width + 1]
    keep = np.flatnonzero(whole)
    rows = np.repeat(np.arange(len(texts)), counts)[keep]
    one = _windows(word_hashes(buf, starts, ends), width)[keep]
    two = (_windows(word_hashes(buf, starts, ends, 1), width)[keep] >> U64(33)).astype(np.int32) if both else None
    return rows, inside[keep], one, two


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((mix64(hashes + U64(row) * _A) if row else hashes) >> U64(64 - bits)).astype(np.uint32)


def encode_gaps(sorted_cells: np.ndarray) -> bytes:
    """Distinct ascending cells as one-byte gaps; 255 carries on."""
    gaps = np.diff(sorted_cells.astype(np.int64), prepend=-1)
    more = gaps // 255
    out = np.full(int((more + 1).sum()), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps % 255
    return out.tobytes()


def decode_gaps(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, dtype=np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255] - 1


def _sketch(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Partition sketches: per sketch row and cell range, the cells seen (and seen twice) by a task."""
    span = min(RANGE_BITS, bits)

    def emit(kept: list[list[np.ndarray]]):
        for row in range(DEPTH):
            sorted_cells = np.concatenate(kept[row])
            kept[row].clear()
            sorted_cells.sort()
            new = np.ones(len(sorted_cells), dtype=bool)
            new[1:] = sorted_cells[1:] != sorted_cells[:-1]
            seen = sorted_cells[new]
            twice = np.unique(sorted_cells[~new])
            ranges = np.unique(seen >> np.uint32(span))
            cut = lambda x: np.split(x & np.uint32((1 << span) - 1), np.searchsorted(x >> np.uint32(span), ranges[1:]))
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(ranges), pa.int32()), pa.array(ranges.astype(np.int32)), pa.array(map(encode_gaps, cut(seen)), pa.binary()), pa.array(map(encode_gaps, cut(twice)), pa.binary())], names=["row", "range", "seen", "twice"])

    def run(batches):
        kept, n = [[] for _ in range(DEPTH)], 0
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(texts, 2 << 20):
                hashes = window_hashes(utf8(texts.slice(lo, hi - lo)), width, False)[2]
                for row in range(DEPTH):
                    kept[row].append(cells(hashes, row, bits))
                n += len(hashes)
                if n >= FLUSH:
                    yield from emit(kept)
                    n = 0
        if n:
            yield from emit(kept)

    return docs.select("text").mapInArrow(tidy(run), "row int, range int, seen binary, twice binary")


def _merge(sketches: DataFrame, bits: int) -> DataFrame:
    """(row, range, cells): bitmap of the cells whose merged count is two or more."""
    size = 1 << min(RANGE_BITS, bits)

    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros(size, dtype=bool)
        many = np.zeros(size, dtype=bool)
        for seen, twice in zip(table.column("seen").to_pylist(), table.column("twice").to_pylist(), strict=True):
            at = decode_gaps(seen)
            many[at[counts[at]]] = True
            counts[at] = True
            many[decode_gaps(twice)] = True
        bitmap = np.packbits(many, bitorder="little").tobytes()
        return pa.table({"row": table.column("row").slice(0, 1), "range": table.column("range").slice(0, 1), "cells": pa.array([bitmap], pa.binary())})

    return sketches.groupBy("row", "range").applyInArrow(run, "row int, range int, cells binary")


def _gather(merged: DataFrame, bits: int) -> np.ndarray:
    """The merged sketch on the driver: DEPTH bitmaps of 2**bits cells, bounded by max_sketch_bytes."""
    span = min(RANGE_BITS, bits)
    out = np.zeros((DEPTH, max(1, (1 << bits) // 8)), dtype=np.uint8)
    width = max(1, (1 << span) // 8)
    for r in merged.toLocalIterator():
        out[r["row"], r["range"] * width : (r["range"] + 1) * width] = np.frombuffer(r["cells"], dtype=np.uint8)
    return out


def _repeated(hashes: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes that every row of the sketch has at two or more."""
    at = np.arange(len(hashes))
    for row in range(DEPTH):
        c = cells(hashes[at], row, bits)
        at = at[(sketch[row][c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1 == 1]
    return at


def _candidates(docs: DataFrame, width: int, bits: int, shared) -> DataFrame:
    """One row per possibly repeated window and task, and the spans already settled inside tasks."""

    def emit(kept: list):
        ids, pos, one, two = (np.concatenate(x) for x in zip(*kept, strict=True))
        kept.clear()
        order = np.lexsort((pos, ids, two, one))
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        low = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = np.sort(order[(ids[order] != ids[low]) | (pos[order] != pos[low])])
        first = np.sort(order[new])  # in the order of the documents, which packs well
        for at in (first[k : k + HANDED] for k in range(0, len(first), HANDED)):
            yield pa.RecordBatch.from_arrays([pa.array(one[at].view(np.int64)), pa.array(two[at]), pa.array(ids[at]), pa.array((pos[at] << SPAN) | 1)], names=names)
        ids, pos = ids[later], pos[later]
        order = np.lexsort((pos, ids))
        ids, pos = ids[order], pos[order]
        if len(ids):
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (ids[1:] != ids[:-1]) | (pos[1:] > pos[:-1] + 1) | (pos[1:] & ((1 << SPAN - 1) - 1) == 0)
            last = np.append(np.flatnonzero(new)[1:], len(ids)) - 1
            ids, begin, stop = ids[new], pos[new], pos[last] + 1
            key = mix64(ids.view(U64) * _A + begin.astype(U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(ids), SETTLED, np.int32)), pa.array(ids), pa.array((begin << SPAN) | (stop - begin))], names=names)

    names = ["h1", "h2", "doc_id", "span"]

    def run(batches):
        sketch = shared.value
        kept, n = [], 0
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = batch.column(1)
            for lo, hi in slices(texts, 2 << 20):
                rows, pos, one, two = window_hashes(utf8(texts.slice(lo, hi - lo)), width)
                at = _repeated(one, sketch, bits)
                kept.append((ids[lo + rows[at]], pos[at], one[at], two[at]))
                n += len(at)
                if n >= FLUSH // 2:
                    yield from emit(kept)
                    n = 0
        if n:
            yield from emit(kept)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "h1 long, h2 int, doc_id long, span long")


def repeated_spans(source: DataFrame, width: int = 20, max_sketch_bytes: int = 1 << 26) -> DataFrame:
    """(doc_id, spans): per document the ranges of windows whose words also start earlier, as start << SPAN | length.

    source: doc_id (long, one row each, or equal texts; NULL_ID stands for null) and text.
    """
    spark = source.sparkSession
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cap = int(log2(max_sketch_bytes * 8 // DEPTH))
    bits = min(cap, max(16, ceil(log2(size / 3 + 1))))
    sketch = _gather(_merge(_sketch(source, width, bits), bits), bits)
    shared = spark.sparkContext.broadcast(sketch)
    found = _candidates(source, width, bits, shared)
    order = Window.partitionBy("h1", "h2").orderBy("doc_id", "span")
    ranked = found.withColumn("first_doc", F.first("doc_id").over(order)).withColumn("first_span", F.first("span").over(order))
    later = ranked.where((F.col("h2") == SETTLED) | (F.col("doc_id") != F.col("first_doc")) | (F.col("span") != F.col("first_span")))
    return later.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))


def covered(n: int, starts, stops, width: int) -> np.ndarray:
    """Which of n words lie in a window of `width` words that starts in one of the ranges."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.minimum(starts, n), 1)
    np.add.at(edge, np.minimum(np.asarray(stops) - 1 + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def _numbered(source: DataFrame) -> DataFrame:
    """Adds key, a long that follows (id, hash of the text) and is the same for rows that are equal in both.

    Where no two texts share an id, the id itself is the key. Else the documents are numbered, at the price
    of one shuffle of the texts.
    """
    th = F.xxhash64("text")
    shared = source.groupBy("doc_id").agg(F.min(th).alias("low"), F.max(th).alias("high")).where("low <> high")
    if shared.isEmpty():
        return source.withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID)))
    order = source.select("doc_id", th.alias("th")).distinct().repartitionByRange(partitions(source.sparkSession), "doc_id", "th").sortWithinPartitions("doc_id", "th")
    numbers = materialize(order.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.monotonically_increasing_id().alias("key")))
    return source.join(numbers, F.col("doc_id").eqNullSafe(F.col("d")) & (th == F.col("h"))).select("doc_id", "text", "key")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, max_sketch_bytes: int = 1 << 26) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (remaining words joined by a space), kept_sha256.

    A word goes if a window of `width` words that covers it has the same words as one that starts earlier
    (smaller id, or same document and earlier start), judged on the input. Null and blank texts have no
    words; texts shorter than the window lose none. Null ids come first. Rows with equal id and equal text
    count as one document and get equal results; rows that share an id (or have none) but not the text are
    documents of their own, in the order of their texts' hashes. Other columns are ignored. An empty table
    gives an empty result.
    """
    short_batches(docs.sparkSession)
    source = _numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    keyed = source.select(F.col("key").alias("doc_id"), "text")
    found = repeated_spans(keyed, width, max_sketch_bytes).withColumnRenamed("doc_id", "known")
    joined = source.join(found, F.col("key") == F.col("known"), "left").select("doc_id", "text", "spans")

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(utf8(part.column(1)), part.column(2), strict=True):
            words = (text or b"").split()
            n = len(words)
            if spans.is_valid and n:
                at = spans.values.to_numpy(zero_copy_only=False)
                gone = covered(n, at >> SPAN, (at >> SPAN) + (at & ((1 << SPAN) - 1)), width)
                words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            kept = b" ".join(words)
            out.append((n, n - len(words), kept, hashlib.sha256(kept).hexdigest()))
        n, gone, kept, digest = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                yield cut(batch.slice(lo, hi - lo))

    return joined.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
