"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe, verification.

Each table rotates the vector three times by random signs and a fast Hadamard transform, and hashes it to
the nearest signed axis. A vector goes to its own bucket and, as a probe, to the next nearest ones. Within
a bucket every pair is verified by cosine in double precision. Equal vectors are folded into one first.

Nothing is emitted per pair: a bucket yields, for each vector, its number of links and one edge towards
its local component, so large groups of near copies stay linear in what is moved. Buckets of more than
`block_rows` vectors are cut into blocks, and pairs of blocks are spread over tasks.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, mix64

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _signs(table: int, hash_: int, turn: int, width: int) -> np.ndarray:
    seed = np.uint64((table * 64 + hash_) * 8 + turn + 1)
    with np.errstate(over="ignore"):
        return np.where(mix64((np.arange(width, dtype=np.uint64) + seed * np.uint64(1 << 20)) * _ODD) & np.uint64(1), 1.0, -1.0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two wide)."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def codes(units: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket codes; the first is the vector's own, the rest its nearest misses."""
    n, dims = units.shape
    width = 1 << max(1, (dims - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dims] = units
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        own, options = np.zeros(n, dtype=np.int64), []
        for k in range(hashes):
            x = padded
            for turn in range(3):
                x = hadamard(x * _signs(t, k, turn, width))
            both = np.concatenate([x, -x], axis=1)
            near = np.argsort(-both, axis=1, kind="stable")[:, : probes + 1]
            value = np.take_along_axis(both, near, axis=1)
            scale = (2 * width) ** k
            own += near[:, 0] * scale
            options += [((value[:, 0] - value[:, p]), (near[:, p] - near[:, 0]) * scale) for p in range(1, probes + 1)]
        out[:, t, 0] = own
        if probes:
            gaps = np.stack([g for g, _ in options], axis=1)
            least = np.argsort(gaps, axis=1, kind="stable")[:, :probes]
            out[:, t, 1:] = own[:, None] + np.take_along_axis(np.stack([d for _, d in options], axis=1), least, axis=1)
    return out


def plan(n: int, dims: int, threshold: float, probes: int, recall: float, load: int = 64) -> tuple[int, int]:
    """(hashes, tables): buckets of about `load` vectors, and enough tables that a pair at the very
    threshold is found with probability `recall` (estimated on 4,000 simulated pairs, fixed seed)."""
    width = 2 << max(1, (dims - 1).bit_length())
    hashes = max(1, round(log(max(1.0, n / load)) / log(width)))
    rng = np.random.default_rng(5)
    a = rng.standard_normal((4000, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, dims))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    ca, cb = codes(a, 1, hashes, probes)[:, 0], codes(threshold * a + np.sqrt(1 - threshold**2) * b, 1, hashes, probes)[:, 0]
    p = float(_meet(ca[:, None, :], cb[:, None, :])[:, 0].mean())
    return hashes, max(2, ceil(log(1 - recall) / log(1 - min(max(p, 1e-6), 0.999))))


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of codes share a bucket, table by table: (..., tables, codes) -> (..., tables)."""
    return ((a[..., :1] == b).any(axis=-1)) | ((b[..., :1] == a).any(axis=-1))


def _local_roots(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    labels = ids.copy()
    while True:
        after = np.minimum(labels, np.where(links, labels[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (after == labels).all():
            return labels
        labels = after


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, probes: int = 2, recall: float = 0.999, block_rows: int = 1024) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine is at least `threshold`. Null and
    zero vectors, and those with null or non-finite components, link with nothing, nor do rows with null
    ids or vectors of different lengths. Equal vectors (repeated rows too) link with each other and count
    one by one; rows that share an id are vectors of their own. The hashing finds nearly all links (`recall` of those at the very threshold, more above
    it); all that it finds are verified. Other columns are ignored; an empty table gives an empty result.
    """
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    store = "<f4" if kind == "float" else "<f8"
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("float" if kind == "float" else "double")).alias("v"), F.col(label_col).cast("string").alias("label"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    classes = materialize(rows.where(usable).groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    shape = classes.groupBy("label", F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max("dims")).first()
    most, dims = shape[0] or 0, shape[1] or 1
    hashes, tables = plan(most, dims, threshold, probes, recall)
    small = np.min_scalar_type((2 << max(1, (dims - 1).bit_length())) ** hashes).newbyteorder("<")  # holds every code

    def encode(batches):
        for batch in batches:
            for row_group in range(0, batch.num_rows, 2048):
                part = batch.slice(row_group, 2048)
                lists = part.column(1)
                values, lens = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
                wide = np.zeros((len(lens), dims))
                wide[np.repeat(np.arange(len(lens)), lens), np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)] = values
                scaled = wide / np.abs(wide).max(axis=1, keepdims=True)
                found = codes(scaled / np.linalg.norm(scaled, axis=1, keepdims=True), tables, hashes, probes)
                blobs = np.split(values.astype(store), np.cumsum(lens)[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.tobytes() for b in blobs], pa.binary()), part.column(2), part.column(3), pa.array([c.astype(small).tobytes() for c in found], pa.binary()), pa.array(found.reshape(len(lens), -1).tolist(), pa.list_(pa.int64()))], names=["rep", "blob", "label", "copies", "codes", "buckets"])

    coded = materialize(classes.select("rep", "v", "label", "copies").mapInArrow(encode, "rep long, blob binary, label string, copies long, codes binary, buckets array<long>"))
    sent = coded.select("rep", "label", F.octet_length("blob").alias("size"), F.posexplode("buckets").alias("place", "bucket"))
    sent = sent.select("rep", "label", "size", F.floor(F.col("place") / (1 + probes)).cast("int").alias("tbl"), (F.col("place") % (1 + probes) == 0).alias("own"), "bucket")
    keys = ["label", "size", "tbl", "bucket"]
    loads = sent.groupBy(*keys).agg(F.count(F.lit(1)).alias("load"), F.max("own").alias("any")).where((F.col("load") > 1) & F.col("any"))
    blocks = F.ceil(F.col("load") / block_rows).cast("int")
    placed = sent.join(loads, keys).withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*keys, F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "own", "rep")
    full = placed.join(coded.select("rep", "blob", "copies", "codes"), "rep")

    def verify(table: pa.Table) -> pa.Table:
        rep, own = table.column("rep").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        block = table.column("b").to_numpy()
        t, across = table.column("tbl")[0].as_py(), table.column("x")[0].as_py() != table.column("y")[0].as_py()
        x = np.frombuffer(b"".join(table.column("blob").to_pylist()), dtype=store).reshape(len(rep), -1).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        near &= (rep[:, None] != rep[None, :]) & (own[:, None] | own[None, :])
        if across:  # pairs within a block are met where the block meets itself
            near &= block[:, None] != block[None, :]
        a, b = np.nonzero(near)
        if not len(a):
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        roots = _local_roots(near, rep)
        code = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype=small).reshape(len(rep), tables, 1 + probes)
        new = np.ones(len(a), dtype=bool)
        for lo in range(0, len(a), 1 << 14):  # count a pair in the first table where it meets, and there once
            i, j = a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)]
            fresh = ~_meet(code[i, :t], code[j, :t]).any(axis=1) if t else np.ones(len(i), dtype=bool)
            same = code[i, t, 0] == code[j, t, 0]
            ij, ji = (code[i, t, :1] == code[j, t]).any(axis=1), (code[j, t, :1] == code[i, t]).any(axis=1)
            here = np.where(own[i] & own[j], same, ~same & np.where(ij & ji, np.where(own[i], rep[i] < rep[j], rep[j] < rep[i]), True))
            new[lo : lo + (1 << 14)] = fresh & here
        links = np.bincount(a, weights=np.where(new, table.column("copies").to_numpy()[b], 0), minlength=len(rep)).astype(np.int64)
        some = np.flatnonzero((links > 0) | (roots != rep))
        return pa.table({"rep": rep[some], "links": links[some], "root": roots[some]})

    found = materialize(full.groupBy(*keys, "x", "y").applyInArrow(verify, "rep long, links long, root long").groupBy("rep", "root").agg(F.sum("links").alias("links")))
    groups = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    placed = classes.select("rep", "low").join(groups, F.col("rep") == F.col("node"), "left").select("rep", "low", F.coalesce("component", "rep").alias("root"))
    names = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(names, "root").join(counts, "rep", "left").select("rep", "component_id", F.coalesce("links", F.lit(0)).alias("others"))
    known = classes.join(named, "rep").select("label", "v", (F.col("others") + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where(usable).join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
