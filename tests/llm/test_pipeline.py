"""Each stage against a brute-force version, on what the stage before kept."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as P
from corpusmill.llm import mixing, quality
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {"documents": docs}
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), SCHEMA)
        out[name] = docs
    return out


def rows_of(df):
    return [tuple(r) for r in df.select(P.COLUMNS).collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, str(r[1] or "")))


def repeated_lines_gone(rows):
    """Plain version of the line stage: a line with a word goes if the same line came before; then wordless documents go."""
    seen, out = set(), []
    for i, t, lang, source, n in by_id(rows):
        left, gone = [], 0
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\v\f\r") and line in seen:
                gone += 1
            else:
                left.append(line)
            if line.strip(" \t\n\v\f\r"):
                seen.add(line)
        text = "\n".join(left) if gone else t
        if not gone or text.strip(" \t\n\v\f\r"):
            out.append((i, text, lang, source, len(text) if gone else n))
    return out


def one_of_each_group(rows):
    """Plain version of the near-duplicate stage, for rows of distinct ids: exact similarity of 0.8 over all pairs."""
    rows = by_id(rows)
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if group[i] != group[j] and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) / len(a | b) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return [r for k, r in enumerate(rows) if group[k] == k]


def test_registered():
    assert "pipeline" in __spark_entry__.queries() and sum(n.startswith("op") for n in __spark_entry__.queries()) == 10


def test_quality_stage(spark, kept):
    """The stage keeps just what the classifier predicts to be good, and clean documents by their labels."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    fold = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    found = quality.classify(kept["documents"], quality.train(kept["documents"], fold))
    assert sorted(r["doc_id"] for r in found.where("predicted = 1").collect()) == sorted(r[0] for r in rows_of(kept["quality"]))
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    ids = {r[0] for r in rows_of(kept["quality"])}
    right = [(i in ids) == bool(q) for i, q in marks.items()]
    assert sum(right) >= 0.95 * len(right)


def test_line_stage(kept):
    assert by_id(rows_of(kept["line_dedup"])) == by_id(repeated_lines_gone(rows_of(kept["quality"])))


def test_near_duplicate_stage(kept):
    assert by_id(rows_of(kept["simhash_dedup"])) == one_of_each_group(rows_of(kept["line_dedup"]))


def test_mix_stage(kept):
    """Copies, cut beginnings and words taken are those of the mix, whose quotas tests/llm/test_operators checks."""
    before = {r["doc_id"]: r for r in mixing.mix(kept["simhash_dedup"]).collect()}
    after, words = Counter(), Counter()
    for i, text, *_ in rows_of(kept["source_mix"]):
        after[i] += 1
        words[i] += len(text.split())
        assert before[i]["text"].startswith(text)
    for i, r in before.items():
        assert words[i] == r["taken"] and after[i] == -(-r["taken"] // max(r["size"], 1))


def test_bpe_stage(spark, kept):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in P.tokenise(spark, kept["source_mix"], SMALL).collect())
    want = sorted((r[0], hashlib.sha256(",".join(map(str, library.encode(r[1], add_special_tokens=False).ids)).encode()).hexdigest()) for r in rows_of(kept["source_mix"]))
    assert got == want


ODD = [
    (None, "null id one two three", "en", "s", 21), (None, None, None, None, None), (7, "", "en", "s", 0), (7, "same id other text", "de", None, 18),
    (7, "same id other text", "de", None, 18), (8, " \n\t ", "en", "t", 4), (9, "word " * 3000, "en", "t", 15000), (10, "a\nb\na", "en", "s", 5), (11, "b\nc", "en", "s", 3),
]


@pytest.mark.parametrize("stage", range(5))
def test_stages_with_odd_rows(spark, stage):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing further columns, and no rows at all."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    wide = docs.selectExpr("*", "1 AS size", "2 AS target", "3 AS taken", "'x' AS key", "4 AS score", "5 AS predicted", "6 AS n_lines", "7 AS n_removed", "8 AS fp", "9 AS th", "10 AS d", "11 AS tid", "12 AS `group`", "13 AS n_tokens")
    run = P.STAGES[stage][1]
    plain, more = run(spark, docs, SMALL), run(spark, wide, SMALL)
    if stage < 4:
        assert plain.columns == more.columns == P.COLUMNS
    found = by_id([tuple(r)[:2] for r in plain.collect()])
    assert found == by_id([tuple(r)[:2] for r in more.collect()])
    if stage == 1:
        assert (10, "a\nb\na".rsplit("\n", 1)[0]) in found and (11, "c") in found
    if stage == 2:
        assert found.count((7, "same id other text")) == 1 and (8, " \n\t ") not in found and (7, "") in found
    if stage == 4:
        assert len(found) == len(ODD)
    assert run(spark, docs.limit(0), SMALL).count() == 0


def test_run(spark):
    out = P.run(spark, SMALL)
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


def test_line_stage_deletes_short_repeated_lines(spark):
    docs = spark.createDataFrame([(1, "alpha beta\ngamma", "en", "s", 16), (2, "alpha beta\ndelta", "en", "s", 16)], SCHEMA)
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.drop_repeated_lines(spark, docs, SMALL).collect()}
    assert kept == {1: ("alpha beta\ngamma", 16), 2: ("delta", 5)}
