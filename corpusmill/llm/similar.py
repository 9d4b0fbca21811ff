"""Links between texts whose sets of word shingles are similar, decided exactly.

A text stands for all texts with the same set of shingles. Its sketch is the lowest bits of HASHES min-wise
hashes; BANDS groups of ROWS of these hashes are the keys of the buckets in which it meets others. Two
rounds look at all pairs of a bucket that are in different components, and propose only what the sketches
do not rule out (four standard errors below the similarity):

1. of each text in each bucket, the partner with the most similar sketch, beside given candidates; these
   links connect nearly all that belongs together, at a row a text and bucket at most;
2. all pairs that are then still in different components. Nothing is left out after that.

Both rounds' pairs are decided by the Jaccard similarity of the whole sets. The number of jobs is fixed.
A large family of texts just below the similarity costs the square of its size in comparisons of sketches,
which are spread over tasks by pairs of blocks.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, connected_components, materialize, mix64, partitions, random_u64, settle, slices, tidy, utf8, word_hashes, words_of

HASHES, BANDS, ROWS = 512, 36, 7
#: Texts of a block: a larger bucket's blocks are compared two at a time.
BLOCK = 2048
#: Bytes of shingle sets that a task verifying pairs holds from either side, about.
SET_BYTES = 4 << 20
#: A set's shingles whose min-wise hashes are made at once.
TILE = 128
_FACTORS = random_u64(HASHES, 31).astype(np.uint32) | np.uint32(1)
_SHIFTS = random_u64(HASHES, 37).astype(np.uint32)


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles, sorted; a shorter text is one shingle, none without words."""
    buf, starts, ends, _ = words_of([(text or b"").lower()])
    n = len(starts)
    if not n:
        return np.zeros(0, dtype=U64)
    ids = word_hashes(buf, starts, ends)
    count, size = max(1, n - words + 1), min(n, words)
    with np.errstate(over="ignore"):
        shingles = np.zeros(count, dtype=U64)
        for j in range(size):
            shingles = mix64(shingles * U64(0x9E3779B97F4A7C15) + ids[j : j + count])
    return np.unique(shingles)


def sketch(text: bytes | None, words: int = 5) -> tuple[bytes, np.ndarray, int]:
    """(lowest bits of HASHES min-wise hashes of the set of shingles, BANDS keys, a hash of the set). No words: empty, empty, 0."""
    whole = shingle_set(text, words)
    if not len(whole):
        return b"", np.zeros(0, dtype=np.int64), 0
    with np.errstate(over="ignore"):
        shingles = np.unique((whole >> U64(32)).astype(np.uint32))
        least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(shingles), TILE):
            part = shingles[at : at + TILE, None] * _FACTORS
            part += _SHIFTS
            part ^= part >> np.uint32(15)
            np.minimum(least, part.min(axis=0), out=least)
        keys = random_u64(BANDS, 41)
        for j in range(ROWS):
            keys = mix64(keys * U64(0x9E3779B97F4A7C15) + least[j * BANDS : (j + 1) * BANDS].astype(U64))
    return np.packbits((least & np.uint32(1)).astype(np.uint8)).tobytes(), keys.view(np.int64), xxhash.xxh64_intdigest(whole.tobytes()) - (1 << 63)


def _texts(docs: DataFrame, text_col: str, *more) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(*more, text.alias("text"), F.xxhash64(text).alias("th"))


def prints(docs: DataFrame, fingerprint, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, th, fp, tid, bits, keys) in one pass over the texts; th is a hash of the text, tid one of its set of shingles."""

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1), 1 << 20):
                part = batch.slice(lo, hi - lo)
                texts = utf8(part.column(1))
                fps = np.array([fingerprint(t, words) for t in texts], dtype=U64).view(np.int64)
                made = [sketch(t, words) for t in texts]
                columns = [part.column(0), part.column(2), pa.array(fps), pa.array([t for *_, t in made], pa.int64()), pa.array([b for b, _, _ in made], pa.binary()), pa.array([k for _, k, _ in made], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "fp", "tid", "bits", "keys"])

    source = _texts(docs, text_col, F.col(id_col).cast("long").alias("doc_id"))
    return source.mapInArrow(tidy(run), "doc_id long, th long, fp long, tid long, bits binary, keys array<long>")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """One row per set of shingles of `prints`, but for the empty one."""
    return materialize(rows.where("length(bits) > 0").groupBy("tid").agg(*[F.min(c).alias(c) for c in ("th", "fp", "bits", "keys")]))


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, words: int) -> DataFrame:
    """(tid, shingles) of the texts `wanted` (th, tid): their whole sets."""

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1), 1 << 20):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, words).tobytes() for t in utf8(part.column(1))], pa.binary())], names=["tid", "shingles"])

    once = _texts(docs, text_col).join(wanted, "th", "left_semi").groupBy("th").agg(F.min("text").alias("text"))  # copies go before the shuffle
    return once.join(wanted, "th").select("tid", "text").mapInArrow(tidy(run), "tid long, shingles binary")


def _whole_cells(batches, names: list[str]):
    """The rows of sorted batches as tables that part no cell (first column)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch.select(names)])
        table = table if held is None else pa.concat_tables([held, table])
        cell = table.column(0).to_numpy()
        cut = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0
        held = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if held is not None:
        yield held


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "cell").sortWithinPartitions("cell")


def least_agreement(similarity: float) -> float:
    """Bits in which two sketches must agree to be a candidate pair: four standard errors below what `similarity` gives."""
    share = (1 + similarity) / 2
    return HASHES * share - 4 * (HASHES * share * (1 - share)) ** 0.5


def _open(placed: DataFrame) -> DataFrame:
    """The rows (key, tid, component) of buckets with two components or more, and their bucket's size."""
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("key").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("components")).where("components > 1")
    return placed.join(sizes.select("key", "size"), "key")


def _proposed(rows: DataFrame, own: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Pairs (src, dst, a, b) of texts of a bucket in different components a and b, which the sketches do not rule out.

    `nearest`: of each text and bucket (block), only the pair with the most similar sketches.
    """
    least = least_agreement(similarity)
    names = ["cell", "block", "diagonal", "tid", "component", "bits"]

    def found(tid, component, i, j):
        swap = tid[i] > tid[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        pairs = np.unique(np.stack([tid[i], tid[j], component[i], component[j]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs.T], names=["src", "dst", "a", "b"])

    def run(batches):
        for table in _whole_cells(batches, names):
            cell, block, diagonal, tid, component = (table.column(k).to_numpy() for k in names[:5])
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=U64).reshape(-1, HASHES // 64)
            best, partner, kept = np.zeros(len(cell), dtype=np.int64), np.zeros(len(cell), dtype=np.int64), []
            at, step = np.arange(len(cell)), 1
            while len(at := at[at + step < len(cell)]) and len(at := at[cell[at] == cell[at + step]]):
                i = at[(component[at] != component[at + step]) & (diagonal[at] | (block[at] != block[at + step]))]
                agreed = HASHES - np.bitwise_count(bits[i] ^ bits[i + step]).sum(axis=1, dtype=np.int64)
                i, agreed = i[agreed >= least], agreed[agreed >= least]
                if nearest:
                    for one, two in ((i, i + step), (i + step, i)):
                        more = agreed > best[one]
                        best[one[more]], partner[one[more]] = agreed[more], two[more]
                elif len(i):
                    kept.append((i, i + step))
                step += 1
            if nearest:
                one = np.flatnonzero(best)
                kept = [(one, partner[one])] if len(one) else []
            for lo in range(0, len(kept), 256):
                yield found(tid, component, *(np.concatenate(x) for x in zip(*kept[lo : lo + 256], strict=True)))

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("tid", "key"), F.col("blocks")).cast("int"))
    dealt = dealt.join(own.select("tid", "bits"), "tid").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("key", F.least("block", "to"), F.greatest("block", "to"))
    cells = dealt.select(cell.alias("cell"), "block", (F.col("block") == F.col("to")).alias("diagonal"), "tid", "component", "bits")
    return _by_cell(cells).mapInArrow(tidy(run), "src long, dst long, a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst) that connect the components a and b of the pairs (src, dst, a, b) whose whole sets are similar enough.

    Texts are dealt to groups of about SET_BYTES, and the pairs between two groups are a cell: a text's set
    travels once to each cell that asks for it, however many pairs it is in. A task skips pairs that its
    links connect already.
    """
    asking = pairs.select(F.col("src").alias("tid")).union(pairs.select("dst")).distinct()
    held = asking.join(sets, "tid").agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    groups = max(ceil(held / SET_BYTES), ceil((2 * partitions(pairs.sparkSession)) ** 0.5))
    names = ["cell", "src", "dst", "a", "b", "shingles"]

    def run(batches):
        above = {}

        def find(x):
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        for table in _whole_cells(batches, names):
            cell, src, dst, a, b, shingles = (table.column(k).to_pylist() for k in names)
            whole = {(c, x): np.frombuffer(s, dtype=U64) for c, x, s in zip(cell, src, shingles, strict=True) if s is not None}
            out = []
            for c, x, y, p, q in zip(cell, src, dst, a, b, strict=True):
                if y is None or (p := find(p)) == (q := find(q)):
                    continue
                one, two = whole[c, x], whole[c, y]
                if min(len(one), len(two)) / max(len(one), len(two)) >= similarity:
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if both / (len(one) + len(two) - both) >= similarity:
                        above[max(p, q)] = min(p, q)
                        out.append((p, q))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["src", "dst"])

    group = lambda c: F.pmod(F.xxhash64(c, F.lit(47)), F.lit(groups))
    asked = pairs.withColumn("cell", group("src") * groups + group("dst"))
    need = asked.select("cell", F.col("src").alias("tid")).unionByName(asked.select("cell", F.col("dst").alias("tid"))).distinct().join(sets, "tid")
    none = F.lit(None)
    rows = asked.select("cell", "src", "dst", "a", "b", none.cast("binary").alias("shingles"))
    rows = rows.unionByName(need.select("cell", F.col("tid").alias("src"), *[none.cast("long").alias(c) for c in ("dst", "a", "b")], "shingles"))
    return _by_cell(rows).mapInArrow(tidy(run), "src long, dst long").distinct()


def links(own: DataFrame, docs: DataFrame, near: DataFrame, similarity: float, text_col: str = "text", words: int = 5) -> DataFrame:
    """Links (src, dst) between the tids of `own` (rows of `distinct_sets`) that connect all texts of the given similarity.

    near: pairs (src, dst) of fingerprints that are candidates as well. docs: the texts.
    """
    firsts = own.groupBy("fp").agg(F.min("tid").alias("low"))
    one, two = (firsts.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low")) for c in ("src", "dst"))
    stars = near.join(one, "src").join(two, "dst").select(F.col("src_low").alias("src"), F.col("dst_low").alias("dst"))
    stars = stars.unionByName(own.join(firsts, "fp").select(F.col("tid").alias("src"), F.col("low").alias("dst"))).where("src <> dst")
    stars = stars.select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b"))
    placed = own.select("tid", F.explode("keys").alias("key"), F.col("tid").alias("component"))
    rows = materialize(_open(placed))
    settle(own.sparkSession)
    pairs = materialize(_proposed(rows, own, similarity, True).unionByName(stars).distinct())
    wanted = rows.select("tid").union(pairs.select("src")).union(pairs.select("dst")).distinct()
    sets = materialize(_sets(docs, own.join(wanted, "tid", "left_semi").select("th", "tid"), text_col, words))
    settle(own.sparkSession)
    first = materialize(_verified(pairs, sets, similarity))
    groups = materialize(connected_components(first))
    settle(own.sparkSession)
    moved = rows.drop("component", "size").join(groups, F.col("tid") == F.col("node"), "left").select("key", "tid", F.coalesce("component", "tid").alias("component"))
    rest = materialize(_proposed(_open(moved), own, similarity, False))
    return first.unionByName(materialize(_verified(rest, sets, similarity)))
