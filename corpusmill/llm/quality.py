"""Quality classifier: naive Bayes support vectors (Wang and Manning).

Features are indicators of n-grams: words, and one to three consecutive word shapes (letter case, digits
and punctuation with runs folded; a word like the one before it has a shape of its own). Indicators are
scaled by the classes' log-count ratio, the vector is brought to unit length, and a linear hinge-loss
model is fitted by dual coordinate descent. Platt scaling turns margins into probabilities.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Table, mix64, release, slices, tidy, utf8, word_hashes, words_of
from .language import platt

BITS = 18
_SHAPE = np.full(256, ord("a"), dtype=np.uint8)
for _b in range(0x21, 0x7F):
    _SHAPE[_b] = ord("A") if chr(_b).isupper() else ord("a") if chr(_b).islower() else ord("0") if chr(_b).isdigit() else _b
_AGAIN = U64(0x5851F42D4C957F2D)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), distinct and sorted by row."""
    buf, starts, ends, firsts = words_of(texts)
    n = len(starts)
    rows = np.repeat(np.arange(len(texts)), np.diff(firsts))
    if not n:
        return rows, np.zeros(0, dtype=np.int64)
    lower = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    words = word_hashes(lower, starts, ends)
    shape = _SHAPE[buf]
    keep = np.ones(len(buf), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    place = np.cumsum(keep)
    shapes = word_hashes(shape[keep], place[starts] - 1, place[ends - 1])
    again = np.zeros(n, dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    shapes = np.where(again, _AGAIN, shapes)
    two = shapes[1:] * U64(3) + shapes[:-1] * U64(5)
    three = two[1:] + shapes[:-2] * U64(7)
    top = lambda h, salt: (mix64(h ^ U64(salt)) >> U64(64 - BITS)).astype(np.int64)
    whole2, whole3 = rows[1:] == rows[:-1], rows[2:] == rows[:-2]
    found = [(rows, top(words, 1)), (rows, top(shapes, 2)), (rows[1:][whole2], top(two, 3)[whole2]), (rows[2:][whole3], top(three, 4)[whole3])]
    both = np.unique(np.concatenate([(r << BITS) | f for r, f in found]))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray  # of scaled indicators: ratio times hinge-loss weight
    squares: np.ndarray  # squared ratios, for the vector's length
    bias: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0

    def margins(self, texts: list[bytes | None]) -> np.ndarray:
        rows, found = features(texts)
        dot = np.bincount(rows, weights=self.weights[found], minlength=len(texts))
        size = np.sqrt(np.bincount(rows, weights=self.squares[found], minlength=len(texts)))
        return dot / np.maximum(size, 1e-9) + self.bias

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.intercept, -30, 30)))


def log_count_ratio(docs: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << BITS), alpha)
    for d, label in zip(docs, labels.tolist(), strict=True):
        counts[label, d] += 1  # features of a document are distinct
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(docs: list[np.ndarray], ratio: np.ndarray, signs: np.ndarray, costs: np.ndarray, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM (Hsieh et al.) over documents as features; a document's values are
    the features' ratios, scaled to unit length and made anew each time, which keeps the sample small in memory."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(docs))
    rng = np.random.default_rng(seed)
    sizes = np.array([np.linalg.norm(ratio[d]) for d in docs])
    norms = (sizes > 1e-9) + 1.0
    scale = 1 / np.maximum(sizes, 1e-9)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(docs)):
            at = docs[i]
            value = ratio[at] * scale[i]
            gradient = signs[i] * (float(w[at] @ value) + bias) - 1.0
            after = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            step = (after - alpha[i]) * signs[i]
            if step:
                alpha[i] = after
                w[at] += step * value
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def fit(docs: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> Model:
    """Fits on four of five rows, calibrates on the fifth."""
    if not len(docs):
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS))
    test = np.arange(len(docs)) % 5 == 4
    mine = [d for d, t in zip(docs, test, strict=True) if not t]
    y = labels[~test]
    ratio = log_count_ratio(mine, y)
    share = np.array([max((y == 0).mean(), 1e-9), max((y == 1).mean(), 1e-9)])
    w, bias = dual_coordinate_descent(mine, ratio, np.where(y == 1, 1.0, -1.0), cost * 0.5 / share[y])
    model = Model(w * ratio, ratio**2, bias)
    left = [d for d, t in zip(docs, test, strict=True) if t] or mine
    truth = labels[test] if test.any() else y
    margins = [float(w[d] @ ratio[d]) / max(float(np.linalg.norm(ratio[d])), 1e-9) + bias for d in left]
    model.slope, model.intercept = platt(np.array(margins), truth == 1)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 20_000, sample_bytes: int = 1 << 27, seed: int = 7) -> Model:
    """Fits on about `sample_docs` labelled documents, drawn from all by a hash of the id.

    The sample's size bounds what is broadcast (ids); the driver gets `sample_bytes` of features (4 bytes each)
    at most: whole documents in the order of their hashes until the bound, which very long or repeated
    documents alone can reach. Null ids and labels are left out; of repeated labels the largest counts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("key")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    total = known.count()
    chance = min(1.0, sample_docs / max(total, 1))
    drawn = known.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int(chance * (1 << 30)))
    source = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = source.join(F.broadcast(drawn), "key").select("key", "label", "text")

    def extract(batches):
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in slices(texts, 1 << 20):
                where, found = features(utf8(texts.slice(lo, hi - lo)))
                cut = np.searchsorted(where, np.arange(1, hi - lo))
                blobs = [x.astype(np.int32).tobytes() for x in np.split(found, cut)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(blobs, pa.binary())], names=["key", "label", "found"])

    made = Table(rows.mapInArrow(tidy(extract), "key long, label int, found binary").withColumn("place", F.xxhash64("key", F.lit(seed + 1))))
    sizes = made.df.select("place", F.octet_length("found").alias("size")).toArrow()  # a few bytes a drawn document
    order = np.argsort(place := sizes.column("place").to_numpy(), kind="stable")
    upto = np.cumsum(sizes.column("size").to_numpy()[order])
    last = int(np.searchsorted(upto, sample_bytes, side="right"))
    held = (made.df if last == len(order) else made.df.where(F.col("place") < int(place[order[last]]))).toArrow()
    made.drop()
    blobs = held.column("found").combine_chunks()
    blobs = blobs.combine_chunks() if isinstance(blobs, pa.ChunkedArray) else blobs
    found = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in blobs]  # views of the one copy
    keys = mix64(held.column("key").to_numpy().astype(np.int64).view(U64))
    order = sorted(range(len(found)), key=lambda i: (keys[i], len(found[i]), zlib.crc32(found[i])))
    labels = held.column("label").to_numpy().astype(np.int64)[order]
    model = fit([found[i] for i in order], labels)
    del held, blobs, found
    release()
    return model


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with score (0 to 1, likelihood of label 1) and predicted (score >= 0.5) added.

    Null and empty texts have no features and get the score of the bias. Whole texts count. Columns named
    score or predicted are replaced; all others pass through; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([x for lo, hi in slices(texts, 1 << 20) for x in shared.value.score(utf8(texts.slice(lo, hi - lo)))], pa.float64())

    return docs.withColumn("score", score(F.col(text_col).cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
