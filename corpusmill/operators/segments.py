"""Arrow passes over words as arrays of token numbers: joining pairs, counting pairs, cutting out segments.

In a pass the words of a batch are one array in which `GAP` parts them, so that no pair spans two words. Counts are
summed in the task before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = -1
#: Rows that a task holds before it sums them.
HELD = 1 << 19

Join = tuple[int, int, int]  # left, right, what they make


def _laid(flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The words one after the other, each with a gap behind it."""
    out = np.full(len(flat) + len(lens), GAP, dtype=np.int32)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(lens)), lens)] = flat
    return out


def _codes(left: np.ndarray, right: np.ndarray) -> set[int]:
    inside = (left != GAP) & (right != GAP)
    return set(np.unique((left[inside].astype(np.int64) << 32) | right[inside]).tolist())


def _joined(laid: np.ndarray, joins: list[Join]) -> np.ndarray:
    """All occurrences of each pair joined from left to right, pair by pair; pairs that do not occur cost a look into a set."""
    if not joins:
        return laid
    there = _codes(laid[:-1], laid[1:])
    for left, right, made in joins:
        if (left << 32) | right not in there:
            continue
        at = np.flatnonzero((laid[:-1] == left) & (laid[1:] == right))
        if left == right and len(at):  # of a run that overlaps, every other place
            new = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - at[new][np.cumsum(new) - 1]) % 2 == 0]
        if len(at):
            laid[at] = made
            keep = np.ones(len(laid), dtype=bool)
            keep[at + 1] = False
            laid = laid[keep]
            at = at - np.arange(len(at))
            before, after = laid[np.maximum(at - 1, 0)], laid[at + 1]  # a gap ends the last word
            there |= _codes(np.where(at > 0, before, GAP), laid[at]) | _codes(laid[at], after)
    return laid


def _read(batch: pa.RecordBatch, joins: list[Join]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with gaps, weights) of a batch of (symbols binary, n)."""
    raw = batch.column(0).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    flat = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.int32)
    return _joined(_laid(flat, np.diff(offsets) // 4), joins), batch.column(1).to_numpy()


def _binary(flat: np.ndarray, lens: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lens * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat, dtype=np.int32))])


def _summed(batches, names: list[str]):
    """Sums the second column by the first as long as the task's rows fit."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows > HELD:
            one = pa.Table.from_batches(held).group_by(names[0]).aggregate([(names[1], "sum")]).rename_columns(names).combine_chunks()
            held, rows = one.to_batches(), len(one)
            if rows > HELD // 2:
                yield from held
                held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).group_by(names[0]).aggregate([(names[1], "sum")]).rename_columns(names).to_batches(max_chunksize=HELD // 4)


def from_words(words: DataFrame) -> DataFrame:
    """(symbols, n) of (word, n): a word's bytes as four-byte numbers. Words of one byte have nothing to merge and go."""

    def run(batches):
        for batch in batches:
            raw = batch.column(0).cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
            flat = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
            yield pa.RecordBatch.from_arrays([_binary(flat, np.diff(offsets)), batch.column(1)], names=["symbols", "n"])

    rows = words.where(F.octet_length("word") > 1).select(F.col("word").cast("binary").alias("word"), F.col("n").cast("long").alias("n"))
    return rows.mapInArrow(run, "symbols binary, n long")


def joined(state: DataFrame, joins: list[Join]) -> DataFrame:
    """The words with those pairs joined; words of one symbol go."""

    def run(batches):
        for batch in batches:
            laid, weight = _read(batch, joins)
            lens = np.diff(np.concatenate([[-1], np.flatnonzero(laid == GAP)])) - 1
            long = lens > 1
            flat = laid[laid != GAP][np.repeat(long, lens)]
            yield pa.RecordBatch.from_arrays([_binary(flat, lens[long]), pa.array(weight[long])], names=["symbols", "n"])

    return state.mapInArrow(run, "symbols binary, n long")


def pair_counts(state: DataFrame, joins: list[Join]) -> DataFrame:
    """(pair, freq): adjacent symbols, the left one in the upper half of `pair`, weighted by n; overlaps count."""

    def pairs(batches):
        for batch in batches:
            laid, weight = _read(batch, joins)
            at = np.flatnonzero((laid[:-1] != GAP) & (laid[1:] != GAP))
            code = (laid[at].astype(np.int64) << 32) | laid[at + 1]
            kinds, which = np.unique(code, return_inverse=True)
            sums = np.zeros(len(kinds), dtype=np.int64)
            np.add.at(sums, which, weight[np.cumsum(laid == GAP)[at]])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(sums)], names=["pair", "n"])

    counted = state.mapInArrow(lambda batches: _summed(pairs(batches), ["pair", "n"]), "pair long, n long")
    return counted.groupBy("pair").agg(F.sum("n").alias("freq"))


def segments(state: DataFrame, joins: list[Join], chosen: np.ndarray) -> DataFrame:
    """(symbols, n): the longest runs of each word all of whose pairs are among `chosen` (sorted), with their weights."""

    def cut(batches):
        for batch in batches:
            laid, weight = _read(batch, joins)
            code = (laid[:-1].astype(np.int64) << 32) | (laid[1:].astype(np.int64) & 0xFFFFFFFF)
            near = np.minimum(np.searchsorted(chosen, code), len(chosen) - 1)
            link = np.concatenate([[False], chosen[near] == code, [False]])  # link[i + 1]: symbols i and i + 1 hang together
            begin, end = np.flatnonzero(link[1:] & ~link[:-1]), np.flatnonzero(link[:-1] & ~link[1:])
            flat = laid[link[1:] | link[:-1]]
            yield pa.RecordBatch.from_arrays([_binary(flat, end - begin + 1), pa.array(weight[np.cumsum(laid == GAP)[begin]])], names=["symbols", "n"])

    found = state.mapInArrow(lambda batches: _summed(cut(batches), ["symbols", "n"]), "symbols binary, n long")
    return found.groupBy("symbols").agg(F.sum("n").alias("n"))
