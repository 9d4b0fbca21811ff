"""Robustness: noisy texts, BPE dropout, and a suite of hard strings."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..streaming.decoder import TextDecoder
from . import codec
from .codec import Model

#: Look-alike digits and neighbours on the keyboard. They must match, so that a text's noise is the same for the same seed.
LEET = {"e": "3", "a": "4", "o": "0", "i": "1", "s": "5", "t": "7"}
NEIGHBOURS = {"a": "s", "s": "d", "e": "r", "r": "t", "t": "y", "o": "p", "n": "m"}
#: Texts of so many characters or fewer lose none.
KEPT_WHOLE = 10


def perturb(text: str, rate: float, seed: int | str = 42) -> str:
    """Noise at about `rate` of the characters that are no white space: a swap with the next character, a look-alike
    digit, a drop or a neighbouring key; nothing where the drawn kind does not apply."""
    draw = random.Random(seed)
    old, out, at = text, [], 0
    while rate > 0 and at < len(old):
        here, width = old[at], 1
        if not here.isspace() and draw.random() < rate:
            kind = draw.choice(["swap", "leet", "drop", "typo"])
            if kind == "swap" and not (old[at + 1 : at + 2] or " ").isspace():
                here, width = old[at + 1] + here, 2
            elif kind == "drop":
                here = here if len(old) <= KEPT_WHOLE else ""
            elif kind in ("leet", "typo"):
                here = (LEET if kind == "leet" else NEIGHBOURS).get(here.lower(), here)
        out.append(here)
        at += width
    return "".join(out) if rate > 0 else text


def noisy(docs: DataFrame, rate: float, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with noisy texts; the noise depends on seed and id alone."""

    @F.pandas_udf("string")
    def run(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else perturb(t, rate, f"{seed}-{i}") for i, t in zip(ids, texts, strict=True)])

    return docs.withColumn(text_col, run(F.col(id_col), F.col(text_col)))


def noise_matrix(docs: DataFrame, model: Model, noise: list[float], dropout: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(noise, dropout, mean_tokens, compression_ratio, fertility) for each pair of rates."""
    rows = None
    for rate in noise:
        texts = noisy(docs, rate, id_col=id_col, text_col=text_col)
        sizes = texts.select(id_col, T.byte_length(F.col(text_col)).alias("b"), T.word_count(F.col(text_col)).alias("w"))
        for p in dropout:
            ids = codec.encode_dropout(texts, model, p, id_col=id_col, text_col=text_col).select(id_col, F.size("ids").alias("t"))
            one = sizes.join(ids, id_col).agg(F.avg("t").alias("mean_tokens"), T.ratio(F.sum("b"), F.sum("t")).alias("compression_ratio"), T.ratio(F.sum("t"), F.sum("w")).alias("fertility"))
            one = one.select(F.lit(rate).alias("noise"), F.lit(p).alias("dropout"), "mean_tokens", "compression_ratio", "fertility")
            rows = one if rows is None else rows.unionByName(one)
    return rows


def hard_strings() -> list[tuple[str, str, str]]:
    """(category, name, text): own strings in seven groups of 10, 10, 7, 8, 10, 5 and 5."""
    unicode_ = ["naïve café", "Zürich ß ẞ", "Ελληνικά", "кириллица", "日本語テキスト", "한국어", "العربية", "हिन्दी", "e\u0301 combining", "👩‍👩‍👧‍👦 family"]
    code = ["def f(x):\n    return x", "for(;;){}", "a->b::c", "SELECT * FROM t;", "<div class='x'/>", "\tif (x != y) {", "λ x. x", "#include <a.h>", "x <<= 2 ** 8", "print(f\"{a!r:>10}\")"]
    numbers = ["1234567890", "3.14159e-10", "0xDEADBEEF", "1,000,000", "2024-02-29T12:00", "½ ¾ ²", "٠١٢٣"]
    links = ["https://a.example/b?c=d&e=f#g", "mailto:x@y.example", "C:\\temp\\file.txt", "/usr/local/bin", "::1", "127.0.0.1:80", "@user #tag", "a.b.c-d_e"]
    spaces = ["", " ", "\n\n\n", "\t \t", " " * 10_000, "\r\n", "a\rb", "\u00a0\u2003", "trailing   ", "\x1c\x1f"]
    controls = ["\x00", "a\x00b", "\x7f\x80", "\ufeffbom", "\u200b\u2060"]
    long_ = ["0" * 10_000, "ab" * 5_000, "A" * 3_000, "?!" * 1_000, "<|endoftext|>" * 10]
    groups = {"unicode": unicode_, "code": code, "numbers": numbers, "links": links, "spaces": spaces, "controls": controls, "long": long_}
    return [(g, f"{g}-{i}", t) for g, texts in groups.items() for i, t in enumerate(texts)]


def domain_slices() -> list[tuple[str, str]]:
    """(domain, text): own samples of the seven slices."""
    return [
        ("prose", "The harbour was quiet before dawn, and the fishermen spoke in low voices. Nobody hurried; the tide would not turn for another hour."),
        ("technical", "A write-ahead log records every change before the page is flushed, so recovery replays committed transactions and undoes the others."),
        ("scientific", "The decay follows N(t) = N0 * exp(-t/tau), with tau = 8.2 +/- 0.3 ms; residuals show no trend (p > 0.4, n = 212)."),
        ("code", "def mean(xs: list[float]) -> float:\n    if not xs:\n        raise ValueError(\"empty\")\n    return sum(xs) / len(xs)\n"),
        ("numbers", "1,024 2048 3.14159 6.02e23 -273.15 0xFF 1/3 42% 2031-12-05 07:45:10 +44 20 7946 0018"),
        ("urls", "https://docs.example.org/guide/start?lang=en&v=2#setup ftp://files.example.net/a/b.tar.gz mailto:team@example.com"),
        ("edge_cases", "  \t leading blanks\n\n\nna\u00efve caf\u00e9 \U0001f642\U0001f680 \u65e5\u672c\u8a9e a\u0301 \u200b <<>> ;;;; ~~"),
    ]


def slice_table(spark: SparkSession) -> DataFrame:
    """(domain, text) of the slices."""
    return spark.createDataFrame(domain_slices(), "domain string, text string")


def stress_suite(spark: SparkSession, model: Model) -> DataFrame:
    """Per case: bytes, tokens, and whether encoding is lossless, free of unknown tokens and equal when streamed."""
    cases = spark.createDataFrame([(i, *c) for i, c in enumerate(hard_strings())], "doc_id long, category string, name string, text string")
    encoded = codec.encode(cases, model, allowed="all")
    decoded = codec.decode(encoded, model).withColumnRenamed("text", "decoded")
    unk = model.ids.get("<|unk|>", -1)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def streamed(ids: pd.Series) -> pd.Series:
        out = []
        for row in ids:
            d = TextDecoder(shared.value)
            out.append("".join([*(d.feed(int(i)) for i in row), d.flush()]))
        return pd.Series(out)

    joined = cases.join(encoded.withColumn("streamed", streamed("ids")), "doc_id").join(decoded, "doc_id")
    return joined.select("category", "name", T.byte_length(F.col("text")).alias("n_bytes"), F.size("ids").cast("long").alias("n_tokens"), (F.col("text") == F.col("decoded")).alias("is_lossless"), (~F.array_contains("ids", unk)).alias("no_unknown"), (F.col("streamed") == F.col("text")).alias("stream_matches"))


def stress_summary(cases: DataFrame) -> DataFrame:
    """One row: cases, passes, mean bytes per token, names that failed."""
    good = F.col("is_lossless") & F.col("no_unknown") & F.col("stream_matches")
    return cases.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(good).alias("n_passed"), F.round(F.avg(F.when(F.col("n_tokens") > 0, F.col("n_bytes") / F.col("n_tokens"))), 4).alias("mean_ratio"), F.array_sort(F.collect_list(F.when(~good, F.col("name")))).alias("failures"))
