"""Exact top-k inner products by ball-tree branch and bound, one tree per shard.

Candidates are dealt into shards by hash; each shard becomes a ball tree in one task. Query blocks meet
the shards over an equi-join on the block number. A first pass over one shard gives each query a k-th
score; every task starts from it and descends its trees from the root: at each node a query goes to the
child of the higher inner-product upper bound q.c + |q| r first, and a subtree whose bound is below the
query's current k-th score is cut. That score is handed on from node to node and from tree to tree. The
bound is never under the true score, so the result is exact.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

NONE = np.iinfo(np.int64).max
TREE = "shard long, dims int, kind string, ids binary, vectors binary, centers binary, radii binary, nodes binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, q): floor(scale * component) as longs; rows with null ids, null vectors or bad components are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("q"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, lens = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(lens), dims), dtype=np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)] = values
    return out


def _packed(values: np.ndarray) -> tuple[str, bytes]:
    """(type, bytes) of integers in the fewest bytes each that hold them."""
    kind = np.result_type(np.min_scalar_type(values.min(initial=0)), np.min_scalar_type(values.max(initial=0)), np.int8)
    kind = np.dtype(kind if kind.kind == "i" else np.int64).newbyteorder("<")
    return kind.str, values.astype(kind).tobytes()


def build_tree(points: np.ndarray, leaf: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of points, centers, radii, nodes): nodes are (parent, start, stop, is leaf) in preorder."""
    order = np.arange(len(points))
    x = points.astype(np.float64)
    centers, radii, nodes = [], [], []
    stack = [(0, len(points), -1)]
    while stack:
        lo, hi, parent = stack.pop()
        part = x[order[lo:hi]]
        center = part.mean(axis=0)
        far = np.linalg.norm(part - center, axis=1)
        me = len(nodes)
        small = hi - lo <= leaf or not far.max() > 0
        centers.append(center)
        radii.append(far.max() * (1 + 1e-9) + 1e-6)
        nodes.append((parent, lo, hi, small))
        if not small:
            a = part[far.argmax()]
            b = part[np.linalg.norm(part - a, axis=1).argmax()]
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(part @ (b - a), mid)]
            stack += [(lo, lo + mid, me), (lo + mid, hi, me)]
    return order, np.array(centers), np.array(radii), np.array(nodes, dtype=np.int64)


def _products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles where they hold them, Python integers (saturated) beyond."""
    largest = lambda m: int(np.abs(m.astype(np.float64)).max(initial=0)) + 1
    if largest(queries) * largest(points) * max(1, points.shape[1]) < 1 << 53:
        return (queries.astype(np.float64) @ points.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ points.astype(object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each query, ties to the smaller id, and the score to beat."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.k, self.own, self.floor = k, ids, floor.astype(np.float64)
        self.scores = np.full((len(ids), k), -np.inf)
        self.ids = np.full((len(ids), k), NONE, dtype=np.int64)
        self.exact = np.zeros((len(ids), k), dtype=np.int64)

    def kth(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.maximum(self.floor[rows], self.scores[rows, -1])

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids[None, :] != self.own[rows][:, None]
        worth = ((scores >= self.kth(rows)[:, None]) & other).any(axis=1)
        rows, scores, other = rows[worth], scores[worth], other[worth]
        if not len(rows):
            return
        all_ids = np.concatenate([self.ids[rows], np.where(other, ids[None, :], NONE)], axis=1)
        exact = np.concatenate([self.exact[rows], scores], axis=1)
        ranked = np.concatenate([self.scores[rows], np.where(other, scores, -np.inf)], axis=1)
        top = np.lexsort((all_ids, -exact, all_ids == NONE), axis=1)[:, : self.k]
        take = lambda m: np.take_along_axis(m, top, axis=1)
        self.ids[rows], self.exact[rows], self.scores[rows] = take(all_ids), take(exact), take(ranked)


def search_tree(tree: dict, queries: np.ndarray, best: Best) -> None:
    """Branch and bound of a block of queries over one tree."""
    ids, points, nodes, centers, radii = (tree[k] for k in ("ids", "vectors", "nodes", "centers", "radii"))
    q = queries.astype(np.float64)
    norms, spread = np.linalg.norm(q, axis=1), np.linalg.norm(centers, axis=1)
    children: dict[int, list[int]] = {}
    for n, parent in enumerate(nodes[:, 0].tolist()):
        children.setdefault(parent, []).append(n)

    def bound(rows: np.ndarray, node: int) -> np.ndarray:
        high = q[rows] @ centers[node] + norms[rows] * radii[node]
        return high + 1e-9 * (np.abs(high) + norms[rows] * spread[node]) + 1e-6  # more than rounding can take

    def visit(node: int, rows: np.ndarray) -> None:
        _, lo, hi, leaf = nodes[node]
        if leaf:
            best.add(rows, ids[lo:hi], _products(queries[rows], points[lo:hi]))
            return
        pair = children[node]
        high = np.stack([bound(rows, child) for child in pair])
        ahead = high[0] >= high[1]
        for mine, order in ((ahead, (0, 1)), (~ahead, (1, 0))):
            for k in order:
                open_ = rows[mine][high[k][mine] >= best.kth(rows[mine])]
                if len(open_):
                    visit(pair[k], open_)

    rows = np.flatnonzero(bound(np.arange(len(q)), 0) >= best.kth())
    if len(rows):
        visit(0, rows)


def _tree_of(row: dict) -> dict:
    ids, dims = np.frombuffer(row["ids"], np.int64), row["dims"]
    return {"ids": ids, "vectors": np.frombuffer(row["vectors"], np.dtype(row["kind"])).astype(np.int64).reshape(len(ids), dims), "centers": np.frombuffer(row["centers"], np.float64).reshape(-1, dims), "radii": np.frombuffer(row["radii"], np.float64), "nodes": np.frombuffer(row["nodes"], np.int64).reshape(-1, 4)}


def trees(candidates: DataFrame, dims: int, shards: int, leaf: int = 128) -> DataFrame:
    """One ball tree per shard of (vec_id, q)."""

    def run(table: pa.Table) -> pa.Table:
        ids, points = table.column("vec_id").to_numpy(), _matrix(table.column("q"), dims)
        order, centers, radii, nodes = build_tree(points, leaf)
        kind, vectors = _packed(points[order])
        blob = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table({"shard": table.column("shard").slice(0, 1), "dims": pa.array([dims], pa.int32()), "kind": pa.array([kind]), "ids": blob(ids[order]), "vectors": pa.array([vectors], pa.binary()), "centers": blob(centers), "radii": blob(radii), "nodes": blob(nodes)})

    return candidates.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).groupBy("shard").applyInArrow(run, TREE)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, shard_rows: int = 4096, block_rows: int = 1024, trees_a_task: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the highest inner product with each query.

    Both inputs are (vec_id long, q array<long>), as from `quantised`. A candidate with the query's own id
    is left out; ties go to the smaller id; fewer than k candidates give all of them. Shorter vectors
    count as padded with zeros; products beyond 64 bits saturate. Repeated query rows are answered once;
    repeated candidate rows are candidates each, and may fill a query's list. Other columns are ignored.
    Empty inputs give an empty result.
    """
    spark = candidates.sparkSession
    candidates, queries = materialize(candidates.select("vec_id", "q")), materialize(queries.select("vec_id", "q").distinct())
    n, dims = candidates.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    m, width = queries.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    if not n or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(dims, width, 1)
    shards, blocks = ceil(n / shard_rows), ceil(m / block_rows)

    def pack(table: pa.Table) -> pa.Table:
        blob = lambda a: pa.array([a.tobytes()], pa.binary())
        kind, packed = _packed(_matrix(table.column("q"), dims))
        return pa.table({"block": table.column("block").slice(0, 1), "query_ids": blob(table.column("vec_id").to_numpy()), "query_kind": pa.array([kind]), "queries": pa.array([packed], pa.binary())})

    def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(row["query_ids"], np.int64)
        return ids, np.frombuffer(row["queries"], np.dtype(row["query_kind"])).astype(np.int64).reshape(len(ids), dims)

    def pilot(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, q = unpack(row)
                best = Best(ids, k, np.full(len(ids), -np.inf))
                search_tree(_tree_of(row), q, best)
                yield pa.RecordBatch.from_pylist([{c: row[c] for c in ("block", "query_ids", "query_kind", "queries")} | {"floor": best.kth().tobytes()}], schema=pa.schema([("block", pa.int64()), ("query_ids", pa.binary()), ("query_kind", pa.string()), ("queries", pa.binary()), ("floor", pa.binary())]))

    def search(table: pa.Table) -> pa.Table:
        best = q = None
        for batch in table.to_batches(max_chunksize=1):
            row = batch.to_pylist()[0]
            if best is None:
                ids, q = unpack(row)
                best = Best(ids, k, np.frombuffer(row["floor"], np.float64))
            search_tree(_tree_of(row), q, best)
        found = best.ids != NONE
        return pa.table({"query_id": np.repeat(best.own, found.sum(axis=1)), "vec_id": best.ids[found], "score": best.exact[found]})

    forest = materialize(trees(candidates, dims, shards))
    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block").applyInArrow(pack, "block long, query_ids binary, query_kind string, queries binary")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    first = forest.where(F.col("shard") == forest.agg(F.min("shard")).first()[0]).withColumn("block", every)
    floors = packed.join(first, "block").mapInArrow(pilot, "block long, query_ids binary, query_kind string, queries binary, floor binary")
    meet = forest.withColumn("block", every).join(floors, "block").withColumn("part", F.floor(F.col("shard") / trees_a_task))
    found = meet.groupBy("block", "part").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
