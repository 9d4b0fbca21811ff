"""From raw documents to a mixed, tokenised corpus: five stages, each written as Parquet and read again.

All stages but the last return the columns of `documents`. `run` applies them in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, lines, mixing, quality, simhash
from corpusmill.llm.common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1; it learns from two thirds of the labels.

    Null and empty texts get the score of a text without n-grams. Repeated rows fare alike. Long texts are
    scored whole. Further columns go. An empty table gives an empty result.
    """
    docs = docs.select(COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return quality.classify(docs, quality.train(docs, labels)).where("predicted = 1").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; so do documents that lose every line with words.

    Null, empty and wordless texts have no line to lose and stay. Rows of one id but other texts are told
    apart, rows of equal id and text fare alike; null ids come first. Further columns go. An empty table
    gives an empty result.
    """
    left = lines.without_repeated_lines(docs.select(COLUMNS), min_words=1).where((F.col("n_removed") == 0) | (lines.words_in(F.col("text")) > 0))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays. Five-word shingles, a similarity of 0.8, decided on the whole texts.

    The smallest id stays, of rows that share it the smallest hash of the text, and one of equal rows; null
    ids come last. Null, empty and wordless texts are one group. Further columns go. An empty table gives an
    empty result.
    """
    docs = docs.select(COLUMNS)
    return simhash.representatives(docs, simhash.near_duplicates(docs, words=5, radius=4, similarity=0.8))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one cut by a shard's last block is cut to its words.

    Texts without words give nothing. The null source is a source; null ids and repeated rows are ordinary
    rows. Further columns go. An empty table gives an empty result.
    """
    return mixing.mixed_rows(mixing.mix(docs.select(COLUMNS)), length_col="n_chars").select(COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of their decoding. Null texts count as empty; rows keep their number."""
    return bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


#: (name, stage): each takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe", tokenise),
]

#: No SQL can fit the classifier or encode by BPE; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is a table in the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}_{name}")
        docs = spark.read.parquet(path)
    return docs
