import random

import regex
from pyspark.sql import functions as F

from corpusmill.functions import text as T

CASES = ["", " ", "I'm 12345 %%% ok\n\n\n\nx", "naïve Ünïcode ſ's", "  lead\ttrail \r\n\r", "a\x00b\x07c", "日本語 🙂 é", "x\x1c\x1fy", "  z", "tab\t\tx  y", "12ab34"]


def column(spark, expression, texts=CASES):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_clean_matches_python(spark):
    def clean(t):
        t = regex.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t).replace("\r\n", "\n").replace("\r", "\n")
        return regex.sub(r"\n{3,}", "\n\n", t).strip()

    assert column(spark, T.clean_text(F.col("text"))) == [clean(t) for t in CASES]


def test_chunks_match_python_and_join_to_the_text(spark):
    rng = random.Random(3)
    texts = CASES + ["".join(rng.choice("aB1 .\n\t'sé日!") for _ in range(30)) for _ in range(50)]
    for mode, pattern in (("clustered", T.CLUSTERED), ("single", T.SINGLE)):
        found = column(spark, T.pre_tokenize(F.col("text"), mode), texts)
        assert found == [regex.findall(pattern, t) for t in texts]
        assert ["".join(x) for x in found] == texts


def test_byte_letters_round_trip(spark):
    letters = T.byte_alphabet()
    assert len(set(letters)) == 256
    assert column(spark, T.to_byte_letters(F.col("text"))) == ["".join(letters[b] for b in t.encode()) for t in CASES]
    assert column(spark, T.from_byte_letters(T.to_byte_letters(F.col("text")))) == CASES


def test_lengths_and_labels(spark):
    assert column(spark, T.word_count(F.col("text"))) == [len(t.split()) for t in CASES]
    assert column(spark, T.byte_length(F.col("text"))) == [len(t.encode()) for t in CASES]
    one = spark.range(1).select(T.format_bytes(F.lit(1536)), T.vocab_label(F.lit(32000)), T.run_name(F.lit(" My Run/1 "))).first()
    assert tuple(one) == ("1.50 KB", "32k", "my_run_1")


def test_first_difference(spark):
    df = spark.createDataFrame([("abc", "abc"), ("abc", "abd"), ("ab", "abc"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(T.first_difference(F.col("a"), F.col("b"))).collect()] == [None, 2, 2, 0]
