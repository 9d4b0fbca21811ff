"""Corpus assembly: byte quotas, held-out split, seeded order, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import ordering

#: Bytes that part two documents of a corpus file.
SEPARATOR = 2


def mebibytes(mb: float) -> int:
    return int(mb * 1024 * 1024)


def cleaned(docs: DataFrame, text_col: str = "text", min_chars: int = 50) -> DataFrame:
    """Null and empty texts go, the rest is cleaned (column `clean`), and short ones go."""
    kept = docs.where(F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    return kept.withColumn("clean", T.clean_text(F.col(text_col))).where(F.length("clean") >= min_chars)


def byte_quota(docs: DataFrame, quota_bytes: int | Column, order: str = "doc_id") -> DataFrame:
    """(source, order, n_bytes, bytes_before, stored_before) of each source's documents up to the one that reaches
    the quota, which still counts. stored_before: the same sum with `SEPARATOR` bytes more a document.

    Only source, order and size travel; a source's running sum is cut into parts (`ordering.running`).
    """
    sized = docs.select("source", order, T.byte_length(F.col("clean")).alias("n_bytes")).withColumn("one", F.lit(SEPARATOR))
    found = ordering.running(sized, "source", order, {"bytes_before": "n_bytes", "separators": "one"})
    kept = found.where(F.col("bytes_before") < quota_bytes)
    return kept.select("source", order, "n_bytes", "bytes_before", (F.col("bytes_before") + F.col("separators")).alias("stored_before"))


def split_held_out(docs: DataFrame, train_bytes: int | Column, eval_bytes: int | Column, order: str = "doc_id") -> DataFrame:
    """Rows of `byte_quota` (or documents) with split: per source first `eval` until its share is reached, then
    `train` until its own; the rest goes. A column as share gives each source its own."""
    rows = docs if "stored_before" in docs.columns else byte_quota(docs, F.lit(1 << 62), order)
    sized = rows.withColumn("stored", F.col("n_bytes") + SEPARATOR).withColumn("is_eval", F.col("stored_before") < eval_bytes)
    reached = sized.where("is_eval").groupBy(F.col("source").alias("of")).agg(F.max(F.col("stored_before") + F.col("stored")).alias("reached"))
    sized = sized.join(reached, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    split = F.when(F.col("is_eval"), "eval").when(F.col("stored_before") - F.col("reached") < train_bytes, "train")
    return sized.withColumn("split", split).where(F.col("split").isNotNull()).drop("is_eval", "of", "reached")


def manifest(splits: DataFrame) -> DataFrame:
    """Documents and stored bytes by source and split."""
    return splits.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("stored").cast("long").alias("n_bytes"))


def seeded_key(id_col: str = "doc_id", seed: int = 42):
    """A sort key that shuffles rows alike on every run and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def global_shuffle(splits: DataFrame, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """Adds place (long): the train documents in seeded order first, then the eval documents in theirs."""
    return ordering.numbered(splits, (F.col("split") == "eval").asc(), seeded_key(id_col, seed).asc(), F.col(id_col).asc())


def char_prefix(docs: DataFrame, chars: int, text_col: str = "text", order: str = "doc_id") -> DataFrame:
    """The first `chars` characters of the documents in order; the one on the border is cut.

    Sizes are summed over parts of equal row counts first, then inside each, so no task sees all rows.
    """
    sizes = docs.select(F.lit(0).alias("all__"), order, F.length(text_col).cast("long").alias("size__"))
    placed = ordering.running(sizes, "all__", order, {"at__": "size__"}).where(F.col("at__") < chars).select(F.col(order).alias("key__"), "at__")
    found = docs.select(order, text_col).join(placed, F.col(order) == F.col("key__"))
    return found.select(order, F.substring(F.col(text_col), F.lit(1), (chars - F.col("at__")).cast("int")).alias(text_col))


def check_mix(sources: DataFrame, total_mb: float, tolerance: float = 0.5) -> DataFrame:
    """One row: enabled sources, their sum, and whether targets are positive and add up to the total."""
    on = F.col("enabled")
    agg = sources.agg(F.count_if(on).alias("n_enabled"), F.coalesce(F.sum(F.when(on, F.col("target_mb"))), F.lit(0.0)).alias("sum_mb"), F.coalesce(F.min("target_mb") > 0, F.lit(True)).alias("all_positive"))
    return agg.withColumn("is_valid", F.col("all_positive") & (F.abs(F.col("sum_mb") - total_mb) <= tolerance))


def mix_shares(sources: DataFrame, total_mb: float, eval_mb: float) -> DataFrame:
    """(source, text_column, train_bytes, eval_bytes) of the enabled sources: each is held out in proportion to its target."""
    mb = F.lit(float(1 << 20))
    share = (F.col("target_mb") / F.lit(float(total_mb)) * F.lit(float(eval_mb)) * mb).cast("long")
    return sources.where("enabled").select("source", "text_column", (F.col("target_mb") * mb).cast("long").alias("train_bytes"), share.alias("eval_bytes"))


def split_by_shares(docs: DataFrame, shares: DataFrame, order: str = "doc_id") -> DataFrame:
    """`split_held_out` with each source's own shares; documents of other sources go. Reading stops once both shares
    are full without separators, as a download with that quota would."""
    rows = byte_quota(docs, F.lit(1 << 62), order).join(shares, "source").where(F.col("bytes_before") < F.col("train_bytes") + F.col("eval_bytes"))
    return split_held_out(rows, F.col("train_bytes"), F.col("eval_bytes"), order)
