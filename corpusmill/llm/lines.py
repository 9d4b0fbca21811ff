"""Line dedup on a suffix array of line ids, built by distributed prefix doubling. Native: no Python on executors.

Lines that hold no word are passed over. The others get an id, their class among equal lines. Round j
ranks suffixes by their first 2^j lines: classes of equal prefixes are aggregated (hot classes shrink to
one row a task before the shuffle), range-sorted and numbered, so ranks follow suffix order; the next
round pairs the rank at a line with the rank 2^j lines on. A suffix whose prefix occurs once is settled
and leaves, as every longer prefix of it occurs once as well.

A longest-common-prefix interval of depth m is the set of suffixes with the same first m lines; for
2^j <= m < 2^(j+1) it is named by two ranks of round j, at the line and m - 2^j lines on. A repeated run
with at least `min_words` words is the union of such intervals: of the shortest runs from each of its
lines onwards, and up to each of its lines, that reach `min_words` words. As a line has a word at least,
no more than log2(min_words) rounds are needed, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, SEPARATORS, Table, materialize, partitions

#: A document's key: the id, and a hash of the text for rows that share an id.
DOC = ["line_dedup_id", "line_dedup_text"]


def words_in(text):
    """Number of words (runs of other characters than space and U+0009..U+000D); null: 0."""
    edge = F.substring(text, 1, 1).rlike(SEPARATORS).cast("int") + F.substring(text, -1, 1).rlike(SEPARATORS).cast("int")
    return F.coalesce(F.when(text == "", 0).otherwise(F.size(F.split(text, SEPARATORS, -1)) - edge), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.withColumn(DOC[0], F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn(DOC[1], F.xxhash64(text))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """One row per line with words: place k among all lines, i among these; ahead and back: lines of the
    shortest run from it, and up to it, with min_words words (null if the document has no such run)."""
    line = F.col("line")
    rows = _keyed(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col).select(*DOC, F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("k", "line"))
    rows = rows.select(*DOC, "k", words_in(line).alias("w"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")).where("w > 0")
    rows = rows.repartition(partitions(docs.sparkSession), *DOC).dropDuplicates([*DOC, "k"])
    here = Window.partitionBy(*DOC)
    by_line = here.orderBy("k")
    rows = rows.withColumn("i", F.row_number().over(by_line)).withColumn("upto", F.sum("w").over(by_line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("w"))
    on = here.orderBy("before").rangeBetween(0, min_words - 1)
    off = here.orderBy("upto").rangeBetween(1 - min_words, 0)
    ahead = F.when(F.max("upto").over(on) - F.col("before") >= min_words, F.count(F.lit(1)).over(on))
    back = F.when(F.col("upto") - F.min("before").over(off) >= min_words, F.count(F.lit(1)).over(off))
    return rows.select(*DOC, "k", "i", "h1", "h2", ahead.cast("int").alias("ahead"), back.cast("int").alias("back"))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds r, the rank of the row's class of equal keys in their order; rows of classes of one are left out."""
    classes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    order = classes.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return rows.join(materialize(order.withColumn("r", F.monotonically_increasing_id())), keys)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """(*DOC, gone): per document that loses lines, their places among all its lines, in no order."""
    lines = materialize(_lines(docs, id_col, text_col, min_words))
    suffixes = Table(_ranked(lines, ["h1", "h2"]).select(*DOC, "i", "r", "ahead", "back"))
    start = suffixes.df.where("ahead is not null").select(*DOC, F.col("i").alias("at"), F.col("ahead").alias("m"))
    end = suffixes.df.where("back is not null").select(*DOC, (F.col("i") - F.col("back") + 1).alias("at"), F.col("back").alias("m"))
    runs = materialize(start.unionByName(end).distinct())
    longest = runs.agg(F.max("m")).first()[0] or 0
    later, span = None, 1
    suffixes = suffixes.df.select(*DOC, "i", "r")
    while span <= longest:
        near = suffixes.select(*DOC, F.col("i").alias("at"), F.col("r").alias("a"))
        far = suffixes.select(*DOC, F.col("i").alias("to"), F.col("r").alias("b"))
        mine = runs.where((F.col("m") >= span) & (F.col("m") < 2 * span)).join(near, [*DOC, "at"]).withColumn("to", F.col("at") + F.col("m") - span)
        mine = mine.join(far, [*DOC, "to"]).select(*DOC, "at", "m", "a", "b")
        place = F.struct(*DOC, "at")
        mine = materialize(mine)
        firsts = mine.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        firsts = materialize(firsts)  # not dealt like `mine`, so that adaptive execution can split a hot run's rows in the join
        found = materialize(mine.join(firsts, ["m", "a", "b"]).where(place > F.col("first")).select(*DOC, "at", "m"))
        later = found if later is None else later.unionByName(found)
        if 2 * span <= longest:
            pairs = near.withColumnRenamed("at", "i").join(far.withColumn("i", F.col("to") - span).drop("to"), [*DOC, "i"])
            suffixes = materialize(_ranked(pairs, ["a", "b"]).select(*DOC, "i", "r"))
        span *= 2
    if later is None:
        return lines.where("false").groupBy(*DOC).agg(F.collect_list("k").alias("line_dedup_gone"))
    gone = later.select(*DOC, F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("i")).distinct()
    return lines.select(*DOC, "i", "k").join(gone, [*DOC, "i"]).groupBy(*DOC).agg(F.collect_list("k").alias("line_dedup_gone"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """The documents with later copies of repeated line runs deleted, and n_lines, n_removed added.

    A run is one or more consecutive lines with words (lines without any neither match nor part a run, and
    stay). If it has at least `min_words` words and the same lines also start earlier (smaller id, or same
    document, further up), its lines go. Lines are parted by U+000A and compared exactly. Null texts stay
    null with 0 lines; null ids come first. Rows of equal id and text count as one document and fare
    alike; rows of equal id but other text are told apart. Further columns pass through, but for those that
    the result adds (n_lines, n_removed) and names that start with line_dedup_. An empty table gives an
    empty result.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words)
    rows = _keyed(docs, id_col, text_col).join(gone, DOC, "left")
    every = F.split(F.col(text_col).cast("string"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("line_dedup_gone"))
    kept = F.array_join(F.transform(left, lambda k: F.get(every, k)), "\n")
    text = F.when(F.col("line_dedup_gone").isNull(), F.col(text_col)).otherwise(kept)
    count = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(every)).cast("long")
    removed = F.when(F.col("line_dedup_gone").isNull(), 0).otherwise(F.size("line_dedup_gone")).cast("long")
    return rows.select(*[text.alias(text_col) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")], count.alias("n_lines"), removed.alias("n_removed"))
