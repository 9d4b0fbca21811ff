import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

QUICK = ["seeded_shuffle", "config_split", "mix_shares", "corpus_writer", "text_scan", "block_digests", "specials_present", "decode_roundtrip", "token_inspection", "domain_slices", "vocab_sweep", "leaderboard_rebuild", "runs_with_results", "stress_suite", "streaming_decode", "special_token_guard", "clean_documents", "eval_train_split", "heldout_prefix", "pretok_single", "word_frequencies", "byte_symbols", "pair_frequencies", "encode_tokens", "sliding_windows", "domain_benchmark", "leaderboard"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    rows = lambda it: sorted(repr(tuple(r)) for r in it)
    assert rows(df.select(cols).collect()) == rows(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())


def test_smoke(spark):
    assert entry.entry(spark).limit(1).count() == 1
