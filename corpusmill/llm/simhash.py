"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a common variant within ceil(r/2) flipped bits of
each. So every fingerprint emits its whole ball of half the radius, the shuffle brings equal variants
together, and all fingerprints in a variant's bucket are linked to its smallest one (they are within r
of each other by the triangle inequality; the distance is verified nevertheless).

Two things keep that affordable, and neither loses a link:

* A screen goes first. If two 64-bit words differ in at most 4 bits, then leaving out that third of the
  word where they differ most leaves at most 2 differing bits in the other two thirds. Ball hashing
  with half of *that* radius on each pair of thirds (3 x 44 keys of about 43 bits) shows every
  fingerprint that can have a partner; the others have none and skip the large ball.
* Variants are dealt out by a linear (parity) hash, so bucket(x ^ mask) = bucket(x) ^ bucket(mask).
  Only fingerprints travel, once to each bucket that holds variants of theirs; the bucket's task makes
  the variants itself.

A distance of 4 bits means a shingle similarity of about 0.96. With `similarity` set, the balls' pairs are
candidates only: `similar` adds those of less similar texts, and decides each by its whole sets of shingles.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import U64, connected_components, materialize, partitions, random_u64, settle, slices, tidy, utf8

BITS = 64
_PARITY = random_u64(24, 29)


def simhash(text: bytes | None, words: int = 4) -> int:
    """64-bit SimHash over word shingles; bit set where over half of the XXH64 (seed 42) values set it."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    n = max(1, len(tokens) - words + 1)
    lo = [0, *ends[: n - 1].tolist()]
    hi = (ends[len(tokens) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(lo[at : at + (1 << 15)], hi[at : at + (1 << 15)], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null or blank text: 0. Rows keep their number."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            fps = np.array([simhash(t, words) for lo, hi in slices(texts) for t in utf8(texts.slice(lo, hi - lo))], dtype=U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "doc_id long, fp long")


def ball(bits: list[int], radius: int) -> np.ndarray:
    """All masks over the given bit places with at most `radius` bits set."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(bits, k)], dtype=U64)


def _syndrome(x: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    for j in range(bits):
        out |= (np.bitwise_count(x & _PARITY[j]).astype(np.int64) & 1) << j
    return out


class View:
    """One way to key fingerprints: the kept bits, the masks flipped on them, and where variants are dealt."""

    def __init__(self, keep: list[int], radius: int, n: int, per_bucket: int = 1 << 21, least: int = 6):
        self.keep = U64(sum(1 << b for b in keep))
        self.masks = ball(keep, radius)
        self.bits = min(24, max(least, ceil(log2(max(1, n * len(self.masks) / per_bucket)))))
        syndromes = _syndrome(self.masks, self.bits)
        order = np.argsort(syndromes, kind="stable")
        self.masks, syndromes = self.masks[order], syndromes[order]
        self.syndromes, self.first, self.count = np.unique(syndromes, return_index=True, return_counts=True)

    def deal(self, fps: np.ndarray):
        """(bucket, fingerprints) for every bucket that holds a variant of one of them."""
        targets = (_syndrome(fps & self.keep, self.bits)[:, None] ^ self.syndromes[None, :]).ravel()
        order = np.argsort(targets, kind="stable")
        targets, who = targets[order], np.repeat(fps, len(self.syndromes))[order]
        buckets, first = np.unique(targets, return_index=True)
        for bucket, part in zip(buckets.tolist(), np.split(who, first[1:]), strict=True):
            yield bucket, part

    def meet(self, bucket: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, group start) sorted by variant: groups of two or more that share a variant in this bucket."""
        at = np.searchsorted(self.syndromes, want := _syndrome(fps & self.keep, self.bits) ^ bucket)
        at = np.minimum(at, len(self.syndromes) - 1)
        hit = self.syndromes[at] == want
        fps, at = fps[hit], at[hit]
        lens = self.count[at]
        begin = np.cumsum(lens) - lens
        which = np.arange(int(lens.sum())) - np.repeat(begin - self.first[at], lens)
        variants = np.repeat(fps & self.keep, lens) ^ self.masks[which]
        order = np.argsort(variants)
        variants, who = variants[order], np.repeat(fps, lens)[order]
        new = np.ones(len(variants), dtype=bool)
        new[1:] = variants[1:] != variants[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(variants)))
        shared = np.repeat(sizes > 1, sizes)
        sizes = sizes[sizes > 1]
        return who[shared], np.cumsum(sizes) - sizes


def _deal(fps: DataFrame, views: list[View]) -> DataFrame:
    """fps (fp long, distinct) -> one row per view, bucket and batch with the fingerprints sent there."""

    def run(batches):
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            for k, view in enumerate(views):
                step = max(1, (1 << 21) // len(view.syndromes))
                for lo in range(0, len(whole), step):
                    rows = list(view.deal(whole[lo : lo + step]))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int32()), pa.array([b for b, _ in rows], pa.int64()), pa.array([p.tobytes() for _, p in rows], pa.binary())], names=["view", "bucket", "fps"])

    return fps.select("fp").mapInArrow(tidy(run), "view int, bucket long, fps binary")


def _met(table: pa.Table, views: list[View]) -> tuple[np.ndarray, np.ndarray]:
    fps = np.frombuffer(b"".join(table.column("fps").to_pylist()), dtype=U64)
    return views[table.column("view")[0].as_py()].meet(table.column("bucket")[0].as_py(), fps)


def screened(fps: DataFrame, n: int, radius: int) -> DataFrame:
    """The fingerprints that may have a partner within `radius` (no false negatives)."""
    thirds = [list(range(BITS))[i * BITS // 3 : (i + 1) * BITS // 3] for i in range(3)]
    left = radius - ceil(radius / 3)  # differing bits in the two thirds that differ least
    views = [View(thirds[a] + thirds[b], ceil(left / 2), n) for a, b in combinations(range(3), 2)]

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"fp": np.unique(_met(table, views)[0]).view(np.int64)})

    return _deal(fps, views).groupBy("view", "bucket").applyInArrow(run, "fp long").distinct()


def ball_links(fps: DataFrame, n: int, radius: int) -> DataFrame:
    """(src, dst) links that connect exactly the fingerprints within `radius` of each other.

    Each variant's bucket holds at most as many fingerprints as a ball has points, and gives a star
    (each fingerprint to the smallest), never all pairs.
    """
    views = [View(list(range(BITS)), ceil(radius / 2), n)]

    def run(table: pa.Table) -> pa.Table:
        who, starts = _met(table, views)
        if not len(who):
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
        low = np.repeat(np.minimum.reduceat(who, starts), np.diff(np.append(starts, len(who))))
        good = (who != low) & (np.bitwise_count(who ^ low) <= radius)
        pairs = np.unique(np.stack([who[good], low[good]], axis=1), axis=0)
        return pa.table({"src": pairs[:, 0].copy().view(np.int64), "dst": pairs[:, 1].copy().view(np.int64)})

    return _deal(fps, views).groupBy("view", "bucket").applyInArrow(run, "src long, dst long")


def fingerprint_links(fps: DataFrame, radius: int = 4, screen: bool = True) -> DataFrame:
    """Links (src, dst) that connect exactly the fingerprints of `fps` (fp: long, distinct) within `radius` of each other.

    With an odd radius the half ball rounds up, so a bucket's star may miss exact verification; use an
    even radius (4 by default).
    """
    if radius % 2:
        raise ValueError("radius must be even")
    spark = fps.sparkSession
    some, n = fps, fps.count()
    if screen:
        some = materialize(screened(fps.repartition(partitions(spark), "fp"), n, radius))
        n = some.count()
    return ball_links(some.repartition(partitions(spark), "fp"), n, radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, screen: bool = True, similarity: float | None = None) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links, itself included).

    Fingerprints link at `radius` or fewer differing bits. With `similarity`, texts link if their sets of
    shingles have that Jaccard similarity or more, which is decided exactly; candidates are the texts whose
    fingerprints are within the radius, and those that share one of 36 bands of 7 min-wise hashes (two
    texts of similarity 0.8 do with probability 0.9998).

    Texts are lower-cased in A-Z only and cut at ASCII white space; shingles of `words` words, a shorter
    text is one shingle. Null, empty and blank texts have fingerprint 0 (and the empty set) and link like
    any other. Equal texts share a fingerprint, so groups of copies of any size cost one fingerprint. Rows
    with null ids are kept; they name no component unless all of its ids are null. Rows that share an id
    are documents of their own. Other columns are ignored. An empty table gives an empty result. With
    `similarity`, group (a name of the component even if ids repeat) and text_hash are added.
    """
    if similarity is None:
        name, more, prints = "fp", [], materialize(fingerprints(docs, id_col, text_col, words))
        own = materialize(prints.select("fp").distinct())
        links = fingerprint_links(own, radius, screen)
    else:
        name, more, prints = "tid", [F.col("root").alias("group"), F.col("th").alias("text_hash")], materialize(similar.prints(docs, simhash, id_col, text_col, words))
        own = similar.distinct_sets(prints)
        links = similar.links(own, docs, fingerprint_links(materialize(own.select("fp").distinct()), radius, screen), similarity, text_col, words)
    settle(docs.sparkSession)
    groups = connected_components(links)
    firsts = prints.groupBy(name).agg(F.min("doc_id").alias("low"))
    known = materialize(firsts.join(groups, firsts[name] == groups.node, "left").select(name, "low", F.coalesce("component", name).alias("root")))
    names = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.join(names, "root").select(name, "root", "component_id")
    return prints.join(named, name).select("doc_id", "fp", "component_id", *more)


def representatives(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without all but one of each group that `near_duplicates` with `similarity` has `found`.

    The row of the smallest id stays, of those that share it the one of the smallest hash of its text, and
    one of equal rows; null ids come last. All columns pass through but names that start with near_.
    """
    place = F.struct(F.col("doc_id").isNull().alias("near_none"), F.col("doc_id").alias("near_id"), F.col("text_hash").alias("near_text"))
    first = found.groupBy("group").agg(F.min(place).alias("first")).select("first.*").drop("near_none")
    keyed = docs.withColumn("near_doc", F.col(id_col).cast("long")).withColumn("near_hash", F.xxhash64(F.col(text_col).cast("string")))
    kept = keyed.join(first, F.col("near_doc").eqNullSafe(F.col("near_id")) & F.col("near_hash").eqNullSafe(F.col("near_text")), "left_semi")
    return kept.dropDuplicates(["near_doc", "near_hash"]).select(*docs.columns)
