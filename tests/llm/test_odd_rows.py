"""Null and repeated ids, repeated rows, long texts, ties and clashing further columns, for the operators that test_operators leaves out."""

import json

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, chat, embedding, language, quality, simhash, topk

EXTRA = ["1 AS score", "2 AS predicted", "3 AS lang_pred", "4 AS rejected", "5 AS rep", "6 AS v", "7 AS fp", "8 AS node", "9 AS component", "10 AS n_tokens", "11 AS ids", "12 AS key", "13 AS links"]


def same(plain, more):
    assert sorted(map(str, plain.collect())) == sorted(map(str, more.collect()))
    return plain.collect()


def test_language_ties_repeats_and_columns(spark):
    """Two languages of the same texts tie: the first in code point order wins. Equal rows fare alike."""
    texts = ["ab cd", "ab cd", "ef gh ab"]
    learn = spark.createDataFrame([(i, t, k) for i, t in enumerate(texts * 5) for k in ("zz", "aa")], "doc_id long, text string, lang string")
    model = language.train(learn)
    docs = spark.createDataFrame([(1, "ab cd"), (1, "ab cd"), (None, "ef"), (2, "ab " * 100_000), (3, "\U0001d49c\U0001d49d")], "doc_id long, text string")
    rows = same(language.identify(docs, model), language.identify(docs.selectExpr("*", *EXTRA), model))
    assert len(rows) == 5 and {r["lang_pred"] for r in rows} == {"aa"} and all(0 <= r["score"] <= 1 for r in rows)


def test_no_language_is_lost(spark):
    """A language of one text, and one of few very long texts, are counted whatever the draw."""
    rows = [("only text " + k, k) for k in ("l%d" % i for i in range(40))] + [(c * 30 + " x" * 3000, "long") for c in "qrs"]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"), sample_chars=50)
    assert len(model.languages) == 41


def test_embedding_repeated_and_null_ids(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.001], 1), (7, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (9, [0.0, 1.0], 1), (7, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in same(embedding.near_duplicates(df), embedding.near_duplicates(df.selectExpr("*", *EXTRA)))))
    assert got == [(0, 0, 0), (5, 3, 5), (5, 3, 5), (7, 3, 5), (7, 3, 5), (9, 0, 9)]


def test_topk_with_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] + [(0, [3.0, 3.0])], "vec_id long, embedding array<double>")
    q = topk.quantised(df, "vec_id", "embedding", 64.0)
    got = topk.top_k(q.where("vec_id = 20"), q, 20, shard_rows=50).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 0, *range(1, 19)] and got[0]["score"] == 64 * 64 * 9


def test_bpe_rows_and_columns(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "long words " * 20_000)], "doc_id long, text string")
    rows = same(bpe.round_trip(docs, path), bpe.round_trip(docs.selectExpr("*", *EXTRA[:9]), path))
    assert sorted(r["n_tokens"] for r in rows)[:3] == [0, 2, 2] and len(rows) == 4
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError, match="white space"):
        bpe.Vocabulary(spec)


def test_chat_rows_and_columns(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "assistant", "y" * 50_000), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = same(chat.digest(chat.format_conversations(df)), chat.digest(chat.format_conversations(df.selectExpr("*", "1 AS formatted", "2 AS n_turns", "3 AS key", "4 AS turns"))))
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in found} == {1: (3, 50_000), 2: (1, 0)}


def test_quality_rows_and_columns(spark):
    docs = spark.createDataFrame([(i, "good text here " * 5 if i % 2 else "BAD!! BAD!!") for i in range(60)] + [(1, "good text here " * 5), (None, "x"), (70, "w " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    wide = quality.classify(docs.selectExpr("*", *EXTRA), model)
    assert wide.columns.count("score") == 1 and wide.columns.count("predicted") == 1
    rows = same(quality.classify(docs, model), wide.select("doc_id", "text", "score", "predicted"))
    assert len(rows) == 63 and all(0 <= r["score"] <= 1 for r in rows) and sum(r["predicted"] == r["doc_id"] % 2 for r in rows if r["doc_id"] and r["doc_id"] < 60) >= 58
    few = quality.train(docs, labels, sample_bytes=200)
    assert np.isfinite(few.score([b"good text here"])).all()


def test_simhash_rows_and_columns(spark):
    docs = spark.createDataFrame([(4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (9, None), (3, " "), (8, "z " * 30_000)], "doc_id long, text string")
    rows = same(simhash.near_duplicates(docs), simhash.near_duplicates(docs.selectExpr("*", *EXTRA)))
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in rows) == [(0, 4), (3, 3), (4, 4), (4, 4), (8, 8), (9, 3)]
    assert docs.select(F.count("*")).first()[0] == len(rows)
