"""Batches of token ids: truncation, padding, masks, windows, language-model blocks. Native column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truncate(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def round_up(n: Column, multiple: int | None) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int") if multiple else n.cast("int")


def pad(ids: Column, length: Column, pad_id: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), length - F.size(ids)).cast("int")))


def attention_mask(ids: Column, length: Column) -> Column:
    return pad(F.transform(ids, lambda _: F.lit(1)), length, 0)


def encode_batch(encoded: DataFrame, pad_id: int | None, padding: bool | str = True, max_length: int | None = None, truncation: bool = False, multiple: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds input_ids and attention_mask. Padding is to max_length ('max_length', or if given) or to the longest
    of the batch (`by`, else all rows), rounded up to the multiple."""
    if padding and pad_id is None:
        raise ValueError("padding needs a pad token id")
    ids = truncate(F.col("ids"), max_length) if truncation and max_length else F.col("ids")
    rows = encoded.withColumn("input_ids", ids)
    if not padding:
        return rows.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
    if max_length and padding != "longest":
        length = F.greatest(F.lit(max_length), F.size("input_ids"))
    elif by:
        length = F.max(F.size("input_ids")).over(Window.partitionBy(*by))
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.coalesce(F.max(F.size("input_ids")), F.lit(0)).alias("longest"))))  # one row
        length = F.col("longest")
    length = round_up(length, multiple)
    return rows.select("*", attention_mask(F.col("input_ids"), length).alias("attention_mask")).withColumn("input_ids", pad(F.col("input_ids"), length, pad_id)).drop("longest")


def windows(ids: Column, max_length: int, stride: int) -> Column:
    """Windows of max_length, `stride` ids shared by neighbours; the last is the first that reaches the end."""
    step = max(max_length - stride, 1)
    last = (F.ceil((F.size(ids) - max_length) / step) * step).cast("int")
    return F.when(F.size(ids) > max_length, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), lambda a: F.slice(ids, a + 1, max_length))).otherwise(F.array(ids))


def lm_blocks(ids: Column, block: int) -> Column:
    """(x, y) pairs: blocks of ids, and the same shifted by one."""
    n = F.floor((F.size(ids) - 1) / block)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), ((n - 1) * block).cast("int"), F.lit(block)), lambda a: F.struct(F.slice(ids, a + 1, block).alias("x"), F.slice(ids, a + 2, block).alias("y"))))


def split_ids(ids: Column, ratio: float = 0.9) -> tuple[Column, Column]:
    """(training ids, validation ids): the sequence cut at `ratio` of its length."""
    at = F.floor(F.size(ids) * ratio).cast("int")
    return F.slice(ids, F.lit(1), at), F.slice(ids, at + 1, F.size(ids))
