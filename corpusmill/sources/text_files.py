"""Corpus text files: documents parted by blank lines, and their digests."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordering
from ..session import materialize


def read_source(spark: SparkSession, path: str, text_column: str = "text", fmt: str = "parquet", source: str | None = None, **options) -> DataFrame:
    """A source as (source, text): any Spark format, one text column; nulls, other types and empty texts go."""
    rows = spark.read.format(fmt).options(**options).load(path)
    if text_column not in rows.columns or rows.schema[text_column].dataType.simpleString() != "string":
        raise ValueError(f"no string column {text_column} in {path}")
    return rows.select(F.lit(source).alias("source"), F.col(text_column).alias("text")).where("text is not null and text <> ''")


def write_corpus(splits: DataFrame, path: str, text_col: str = "clean", order: str = "key") -> None:
    """One folder per split; each document followed by a blank line. Rows are range-sorted, so reading the files
    in name order gives the order back."""
    rows = splits.select("split", order, F.col(text_col).alias("value"))
    ordered = rows.repartitionByRange("split", order).sortWithinPartitions("split", order)
    ordered.select("split", "value").write.partitionBy("split").option("lineSep", "\n\n").mode("overwrite").text(path)


def write_source(docs: DataFrame, path: str, text_col: str = "clean", order: str = "doc_id") -> int:
    """One source as text files, each document followed by a blank line; returns the bytes stored."""
    ordered = docs.select(order, F.col(text_col).alias("value")).repartitionByRange(order).sortWithinPartitions(order)
    ordered.select("value").write.option("lineSep", "\n\n").mode("overwrite").text(path)
    return stored_bytes(docs, text_col).first()["n_bytes"] or 0


def read_corpus(spark: SparkSession, path: str, max_lines: int | None = None, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(line_no, line) of a corpus file or folder: invalid UTF-8 replaced, optionally the first lines by position.

    Files count in the order of their paths, lines in that of the file. Lines are not moved: each block of a file
    is read in order by one task, so a line's number is what the blocks before hold, and its place in its own.
    """
    raw = spark.read.text(path)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = raw.select(*where, F.make_valid_utf8(F.col("value")).alias("line"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    ahead = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block of a file
    blocks = materialize(blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead")))
    small = F.broadcast(blocks) if blocks.count() <= broadcast_rows else blocks
    numbered = rows.join(small, ["file", "block"]).select((F.col("ahead") + F.col("at") - F.col("first")).alias("line_no"), "line")
    return numbered.where(F.col("line_no") < max_lines) if max_lines is not None else numbered


def corpus_digest(docs: DataFrame, order: str, text_col: str = "clean", separator: str = "\n\n") -> DataFrame:
    """SHA-256 and length of the corpus file that the documents make in this order.

    The digest runs over one sequence, so rows stream through a single task; nothing is held. For large
    corpora `block_digests` and `tree_digest` say as much and run in parallel.
    """

    def run(batches):
        sha, n, docs_ = hashlib.sha256(), 0, 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                raw = (t + separator).encode()
                sha.update(raw)
                n += len(raw)
                docs_ += 1
        yield pa.RecordBatch.from_pydict({"sha256": [sha.hexdigest()], "n_bytes": [n], "n_docs": [docs_]})

    rows = docs.select(order, F.col(text_col).alias("value")).repartitionByRange(1, order).sortWithinPartitions(order)
    return rows.select("value").mapInArrow(run, "sha256 string, n_bytes long, n_docs long")


def block_digests(docs: DataFrame, order: str, text_col: str = "clean", separator: str = "\n\n", block_docs: int = 1000) -> DataFrame:
    """(block, sha256, n_bytes, n_docs): SHA-256 of every `block_docs` documents in this order, whatever the partitioning.

    A text is digested on its own first, so that no text travels; a block's digest is that of its texts' digests.
    """
    narrow = docs.select(order, F.sha2(F.concat(F.col(text_col), F.lit(separator)), 256).alias("sha"), (F.octet_length(text_col) + len(separator.encode())).cast("long").alias("size"))
    placed = ordering.numbered(narrow, F.col(order).asc()).withColumn("block", F.expr(f"place div {block_docs}"))
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sha"))), lambda x: x["sha"]), "")
    return placed.groupBy("block").agg(F.sha2(own, 256).alias("sha256"), F.sum("size").alias("n_bytes"), F.count(F.lit(1)).alias("n_docs"))


def tree_digest(blocks: DataFrame) -> DataFrame:
    """One row: the digest over the digests of `block_digests` (64 letters each), bytes and documents."""
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "sha256"))), lambda x: x["sha256"]), "")
    return blocks.agg(F.sha2(own, 256).alias("sha256"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_docs").alias("n_docs"))


def stored_bytes(docs: DataFrame, text_col: str = "clean", separator: int = 2, by: list[str] | None = None) -> DataFrame:
    return docs.groupBy(*(by or [])).agg(F.sum(T.byte_length(F.col(text_col)) + separator).cast("long").alias("n_bytes"))
