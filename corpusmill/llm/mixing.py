"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets are shared by weight and stop at `most` times the source's size (water filling). Blocks of
`block_words` words are then awarded to sources by highest quotients target / (2 seats + 1), a source's
blocks to groups of shards in the same way, and a group's blocks to its shards in a task. A shard's
documents lie in seeded order; its blocks are laid over them and taken from the front, whole passes first.
The number of shards grows with the source; the driver holds a row per source and group of GROUP shards.
"""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table
from .lines import words_in

#: Shards of a group.
GROUP = 1024
#: Tables of sources and quotas are broadcast up to so many rows (a few MB), and joined by shuffle beyond.
BROADCAST_ROWS = 100_000
#: Columns that the result adds.
ADDED = ("size", "source_size", "target", "taken")


def water_fill(total: float, weights: list[float], caps: list[float]) -> list[float]:
    """Shares of `total` by weight, none above its cap; what a cap cuts off is shared again by weight."""
    out, active, left = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0], float(total)
    while active:
        unit = left / sum(weights[i] for i in active)
        over = [i for i in active if unit * weights[i] > caps[i]]
        for i in over or active:
            out[i] = float(caps[i]) if over else unit * weights[i]
        left -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)] if over else []
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1); ties go to the earlier entry.

    A divisor gives a start that is within half a seat per entry; single seats are then moved by quotient.
    """
    votes = np.asarray(votes, dtype=np.float64)
    got = np.zeros(len(votes), dtype=np.int64)
    if not len(votes) or votes.sum() <= 0 or seats <= 0:
        return got
    got = np.floor(votes * (seats / votes.sum()) + 0.5).astype(np.int64)
    spare = seats - int(got.sum())
    if spare > 0:
        heap = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes.tolist(), got.tolist(), strict=True))]
        heapq.heapify(heap)
        for _ in range(spare):
            i = heap[0][1]
            got[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * int(got[i]) + 1), i))
    elif spare < 0:
        heap = [(v / (2 * g - 1), -i) for i, (v, g) in enumerate(zip(votes.tolist(), got.tolist(), strict=True)) if g]
        heapq.heapify(heap)
        for _ in range(-spare):
            i = -heap[0][1]
            got[i] -= 1
            if got[i]:
                heapq.heapreplace(heap, (votes[i] / (2 * int(got[i]) - 1), -i))
            else:
                heapq.heappop(heap)
    return got


def cycle_weights(sources: list[str | None], cycle: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights 1, 2, 3, repeating, over the sources in code point order, null last."""
    order = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(order)}


def _apportioned(held: DataFrame, groups: DataFrame, block_words: int, most: int) -> DataFrame:
    """(mix_source, mix_shard, mix_held, mix_quota): each group's seats dealt to its shards."""

    def run(table: pa.Table) -> pa.Table:
        words = table.column("words").to_numpy()
        order = np.argsort(table.column("mix_shard").to_numpy(), kind="stable")
        quota = np.zeros(len(words), dtype=np.int64)
        quota[order] = sainte_lague(words[order], table.column("seats")[0].as_py()) * block_words
        return pa.table({"mix_source": table.column("mix_source"), "mix_shard": table.column("mix_shard"), "mix_held": words, "mix_quota": np.minimum(quota, most * words)})

    return held.join(groups, ["mix_source", "mix_group"]).groupBy("mix_source", "mix_group").applyInArrow(run, "mix_source string, mix_shard long, mix_held long, mix_quota long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, most: int = 3, block_words: int = 100, shard_rows: int = 2_000, seed: int = 17) -> DataFrame:
    """The documents with size (words), source_size, target (the source's) and taken (words the mix takes).

    `weights` maps sources to weights (others: 0); by default they cycle 1, 2, 3. No document gives more
    than `most` times its words. Null and blank texts have size 0 and give nothing; the null source is a
    source; null ids and repeated rows are ordinary rows. Equal input gives equal output, whatever its
    partitioning. Columns named size, source_size, target or taken are replaced by the result's; others
    pass through, but for names that start with mix_. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ADDED]
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    named = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("mix_source", F.coalesce(F.concat(F.lit("="), source), F.lit("-")))
    sized = named.withColumn("mix_size", words_in(text)).withColumn("mix_place", F.xxhash64(F.col(id_col), text, F.lit(seed))).withColumn("mix_order", F.xxhash64(F.col(id_col), text, F.lit(seed + 1)))
    shards = {r["mix_source"]: max(1, ceil(r["n"] / shard_rows)) for r in named.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per source
    names = sorted(shards, key=lambda s: (s == "-", s))
    small = lambda n: F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
    per_source = small(len(names))(spark.createDataFrame(list(shards.items()), "mix_source string, mix_shards long"))
    placed = sized.join(per_source, "mix_source").withColumn("mix_shard", F.pmod("mix_place", "mix_shards"))
    held = Table(placed.groupBy("mix_source", "mix_shard").agg(F.sum("mix_size").alias("words")).withColumn("mix_group", F.expr(f"mix_shard div {GROUP}")))
    totals: dict[str, list[tuple[int, int]]] = {s: [] for s in names}
    for r in held.df.groupBy("mix_source", "mix_group").agg(F.sum("words").alias("words")).orderBy("mix_source", "mix_group").collect():  # a row per group of shards
        totals[r["mix_source"]].append((r["mix_group"], r["words"]))
    plain = {s: None if s == "-" else s[1:] for s in names}
    by = weights if weights is not None else cycle_weights(list(plain.values()))
    sizes = {s: sum(w for _, w in totals[s]) for s in names}
    targets = dict(zip(names, water_fill(sum(sizes.values()), [float(by.get(plain[s], 0)) for s in names], [float(most * sizes[s]) for s in names]), strict=True))
    seats = dict(zip(names, sainte_lague(np.array([targets[s] for s in names]), round(sum(targets.values()) / block_words)).tolist(), strict=True))
    dealt = [(s, g, n) for s in names for (g, _), n in zip(totals[s], sainte_lague(np.array([w for _, w in totals[s]]), seats[s]).tolist(), strict=True)]
    groups = small(len(dealt))(spark.createDataFrame(dealt, "mix_source string, mix_group long, seats long"))
    about = small(len(names))(spark.createDataFrame([(s, sizes[s], targets[s]) for s in names], "mix_source string, source_size long, target double"))
    quotas = small(sum(shards.values()))(Table(_apportioned(held.df, groups, block_words, most)).df)
    held.drop()
    order = Window.partitionBy("mix_source", "mix_shard").orderBy("mix_order", F.col(id_col), "mix_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("mix_end", F.sum("mix_size").over(order)).join(quotas, ["mix_source", "mix_shard"]).join(about, "mix_source")
    passes = F.when(F.col("mix_held") > 0, F.expr("mix_quota div mix_held")).otherwise(F.lit(0))
    rest = F.col("mix_quota") - passes * F.col("mix_held") - (F.col("mix_end") - F.col("mix_size"))
    taken = passes * F.col("mix_size") + F.greatest(F.lit(0), F.least(rest, F.col("mix_size")))
    return placed.select(*kept, F.col("mix_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def mixed_rows(mixed: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """Carries a mix out: each document as often as it is taken whole, and once cut after the words left over, with the white space between them."""
    whole, rest = F.expr("taken div greatest(size, 1)"), F.expr("taken % greatest(size, 1)")
    copies = F.explode(F.sequence(F.lit(1), (whole + (rest > 0).cast("long")).cast("int")))
    # words with the white space after them; white space at the start is a piece of its own
    pieces = F.split(F.col(text_col), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])", -1)
    led = F.col(text_col).rlike("^[\\x20\\x09-\\x0D]").cast("int")
    head = F.regexp_replace(F.array_join(F.slice(pieces, 1, F.col("mix_rest").cast("int") + led), ""), "[\\x20\\x09-\\x0D]+$", "")
    rows = mixed.where("taken > 0").withColumn("mix_whole", whole).withColumn("mix_rest", rest).withColumn("mix_copy", copies)
    rows = rows.withColumn(text_col, F.when(F.col("mix_copy") <= F.col("mix_whole"), F.col(text_col)).otherwise(head))
    if length_col:
        rows = rows.withColumn(length_col, F.length(text_col).cast("long"))
    return rows.drop("size", "source_size", "target", "taken", "mix_whole", "mix_rest", "mix_copy")
