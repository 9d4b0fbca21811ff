"""Queries over odd rows, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from corpusmill import catalog
from corpusmill.operators import ordering
from corpusmill.streaming.decoder import quota_stream, run_in_batches

ODD = [(0, None, "en", "a"), (1, "", "en", "a"), (2, " ", "de", "a"), (3, "x" * 300, "de", "b"), (4, ". \r\n\x00y", None, None), (5, "the cat. the cat", "en", "b")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars")
    rows.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def _same(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, folder).select(want.columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["clean_documents", "valid_documents", "stored_sizes"])
def test_null_and_empty_texts_are_no_documents(spark, odd, name):
    _same(spark, odd, name)


def test_losslessness_learns_a_whole_vocabulary(spark, odd, monkeypatch):
    asked = []
    monkeypatch.setattr(catalog.V, "train", lambda words, size, **_: asked.append(size) or [("t", "h", 2)])
    _same(spark, odd, "losslessness")
    assert asked == [32_000]


def test_quota_stream_in_files_equals_a_loop(spark, tmp_path):
    """Several files a micro-batch, a source that fills its quota in each of them, null texts and a null source."""
    texts = [(("a", None, "b")[i % 3] if i % 7 else "a", i, None if i % 11 == 0 else "é" * (i % 5)) for i in range(300)]
    docs = spark.createDataFrame(texts, "source string, doc_id long, text string")
    halves = [docs.where("doc_id < 100").repartition(3), docs.where("doc_id >= 100").repartition(3)]
    out = run_in_batches(halves, str(tmp_path), lambda stream: quota_stream(stream, 150))
    want, total = [], {}
    for source, i, text in texts:
        if total.setdefault(source, 0) < 150:
            want.append((source, i, text))
            total[source] += len((text or "").encode())
    assert sorted(map(repr, map(tuple, spark.read.parquet(out).collect()))) == sorted(map(repr, want))
    assert len([f for f in (tmp_path / "in").iterdir() if f.suffix == ".parquet"]) == 6


def test_running_sums_make_their_rows_once(spark):
    """What the sums run over (a cleaning of all texts) is computed once, not again for the bounds of the ranges."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(1000).selectExpr("id % 3 AS g", "id", "1L AS one").mapInArrow(count, "g long, id long, one long")
    found = ordering.running(rows, "g", "id", {"before": "one"}).collect()
    assert made.value == 1000 and all(r["before"] == r["id"] // 3 for r in found)
