"""Metrics of a tokenizer on texts, Zipf ranks, token lengths, language-model figures, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from . import ordering


def domain_report(rows: DataFrame, by: list[str], vocab_size: int, overall: str | None = None) -> DataFrame:
    """All metrics per domain, from rows of `codec.measure`. overall: name (in the first of `by`) of a row over all.

    The measured rows are written once and read twice: for the sums, and for the distinct ids, which are
    deduplicated as rows (domain, id), so that no buffer holds a domain's ids.
    """
    rows = materialize(rows)
    n = lambda c: F.sum(c).cast("long").alias(c)
    sums = [n("n_bytes"), n("n_words"), n("n_tokens"), n("n_unk"), F.every("is_lossless").alias("all_lossless"), F.count(F.lit(1)).alias("n_docs")]
    per = rows.groupBy(*by).agg(*sums).withColumn("n_used", F.lit(0).cast("long"))
    ids = rows.select(*by, F.explode("used").alias("id")).distinct()
    use = ids.groupBy(*by).agg(F.count(F.lit(1)).alias("n_used"))
    if overall is not None:
        name = [F.lit(overall if k == 0 else None).cast("string").alias(c) for k, c in enumerate(by)]
        total = rows.agg(*sums).select(*name, "n_bytes", "n_words", "n_tokens", "n_unk", "all_lossless", "n_docs", F.lit(0).cast("long").alias("n_used"))
        per, use = per.unionByName(total), use.unionByName(ids.select("id").distinct().agg(F.count(F.lit(1)).alias("n_used")).select(*name, "n_used"))
    empty = [F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_words", "n_tokens", "n_unk", "n_docs")]
    both = per.unionByName(use.select(*by, *empty, F.lit(None).cast("boolean").alias("all_lossless"), "n_used"))
    found = both.groupBy(*by).agg(*[n(c) for c in ("n_bytes", "n_words", "n_tokens", "n_unk", "n_docs", "n_used")], F.every("all_lossless").alias("all_lossless"))
    return with_rates(found, vocab_size)


def with_rates(found: DataFrame, vocab_size: int) -> DataFrame:
    c = F.col
    return found.withColumn("compression_ratio", T.ratio(c("n_bytes"), c("n_tokens"))).withColumn("fertility", T.ratio(c("n_tokens"), c("n_words"))).withColumn("unk_percent", T.ratio(c("n_unk"), c("n_tokens"), 4, 100.0)).withColumn("used_percent", F.round(c("n_used") / vocab_size * 100.0, 2))


def zipf(counts: DataFrame, n_col: str = "n", key: str = "word") -> DataFrame:
    """Ranks of positive counts and what Zipf's law says from the first. Rows are range-sorted by count and key and
    numbered in their partitions, so ties of any number are spread."""
    ranked = ordering.numbered(counts.where(F.col(n_col) > 0).select(key, n_col), F.col(n_col).desc(), F.col(key).asc())
    top = ranked.agg(F.max(n_col).alias("top"))  # one row
    rank = F.col("place") + 1
    return ranked.crossJoin(F.broadcast(top)).select(key, n_col, rank.alias("zipf_rank"), F.round(F.col("top") / rank, 4).alias("theoretical"))


def token_lengths(vocab: DataFrame, top: int = 40) -> DataFrame:
    """Histogram of token lengths in characters, longer ones in the last bin."""
    return vocab.groupBy(F.least(F.length("token"), F.lit(top)).cast("int").alias("length")).agg(F.count(F.lit(1)).alias("n_tokens"))


def length_figures(vocab: DataFrame) -> DataFrame:
    """One row: number of tokens, mean, median and greatest length in characters."""
    n = F.length("token")
    return vocab.agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.avg(n), 4).alias("mean_length"), F.median(n).alias("median_length"), F.max(n).alias("max_length"))


def mean_loss(losses: DataFrame, by: list[str], loss: str = "loss") -> DataFrame:
    """Mean of the evaluation losses per group; losses that are no finite numbers do not count."""
    good = F.col(loss).isNotNull() & ~F.isnan(F.col(loss)) & (F.abs(F.col(loss)) < float("inf"))
    return losses.where(good).groupBy(*by).agg(F.avg(loss).alias("mean_loss"), F.count(F.lit(1)).alias("n_losses"))


def with_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs with the figures of their language model where there are any (null else)."""
    return runs.join(results, "run_id", "left")


def lm_figures(loss: Column, bytes_per_token: Column) -> list[Column]:
    per_byte = loss / bytes_per_token
    return [F.round(per_byte, 4).alias("loss_per_byte"), F.round(per_byte / F.log(F.lit(2.0)), 4).alias("bits_per_byte"), F.round(F.exp(loss), 4).alias("perplexity")]


def leaderboard(runs: DataFrame, order: str = "seq") -> DataFrame:
    """The latest entry of each run, best compression first (position)."""
    latest = runs.withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc(order)))).where("k = 1").drop("k")
    return latest.withColumn("position", F.row_number().over(Window.orderBy(F.desc("overall_cr"), "run_id")).cast("int"))  # one row per run


def pareto(runs: DataFrame, results: DataFrame, min_vocab: int = 1000) -> DataFrame:
    """Runs with both metrics and language-model results."""
    return runs.join(results, "run_id").where(F.col("vocab_size") >= min_vocab)


def best_run(board: DataFrame) -> DataFrame:
    return board.orderBy(F.desc("overall_cr"), "run_id").limit(1)
