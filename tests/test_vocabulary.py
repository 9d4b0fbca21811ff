import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import codec, vocabulary as V
from corpusmill.plans import pipelines
from corpusmill.sources import model_files

WORDS = {"the": 50, "this": 30, "that": 20, "when": 10}


def naive(counts, merges, least):
    words, out = {tuple(w): n for w, n in counts.items()}, []
    for _ in range(merges):
        pairs = Counter()
        for w, n in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < least:
            break
        out.append((*best, pairs[best]))
        after = Counter()
        for w, n in words.items():
            s, k = [], 0
            while k < len(w):
                hit = w[k : k + 2] == best
                s.append(w[k] + w[k + 1] if hit else w[k])
                k += 1 + hit
            after[tuple(s)] += n
        words = after
    return out


def test_first_merge_and_min_frequency(spark):
    words = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    merges = V.train(words, 265, 2, specials=[])
    assert merges[0] == ("t", "h", 100)
    assert V.merge_steps(words, 9) == merges
    assert V.train(spark.createDataFrame([("xyz", 1), ("abc", 2)], "word string, n long"), 300, 5) == []
    with pytest.raises(ValueError):
        V.train(words, 100)


def test_heap_equals_recount_on_random_words():
    rng = random.Random(7)
    for _ in range(20):
        counts = {tuple(rng.choice("ab") for _ in range(rng.randint(2, 9))): rng.randint(1, 5) for _ in range(12)}
        assert V.learn(counts, 15, 1) == naive(counts, 15, 1)


def test_steps_take_the_merges_of_a_recount(spark):
    """Several merges from one count of pairs are those that one recount after each merge gives."""
    rng = random.Random(17)
    for look in (2, 5, 2048):
        counts = {"".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))): rng.randint(1, 9) for _ in range(40)}
        words = spark.createDataFrame(list(counts.items()), "word string, n long").coalesce(2)
        want = naive({tuple(w): n for w, n in counts.items()}, 14, 2)
        assert V.merge_steps(words, 14, look=look) == want == V.train(words, 270, specials=[])
        assert V.train(words, 270, specials=[], driver_bytes=0) == want


def test_long_words_merge_like_short_ones():
    rng = random.Random(23)
    for _ in range(60):
        merges, parts = [], list("abc")
        for _ in range(12):  # in any order, also merges whose parts come later
            merges.append((rng.choice(parts), rng.choice(parts), 1))
            parts.append(merges[-1][0] + merges[-1][1])
        rng.shuffle(merges)
        model = codec.Model(merges)
        word = "".join(rng.choice("abc") for _ in range(rng.randint(2, 60)))
        plain = model.encode_word(word) if len(word) <= codec.SHORT else None
        heap = model._merge_long([model.first[b] for b in word.encode()])
        assert heap == model.encode_word(word, 1e-300, random.Random(1)) and plain in (None, heap)


def test_large_vocabulary_equals_the_library(spark, tmp_path):
    """1,200 merges learned from the small corpus: ids are the tokenizers library's, and a recount agrees on the first."""
    from tokenizers import Tokenizer

    from corpusmill.operators import metrics
    from tests.conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("text is not null").withColumn("clean", F.col("text"))
    words = V.word_counts(docs)
    big = codec.Model(V.train(words, 1461))
    letters = big.letters
    counts = {tuple(letters[b] for b in r["word"].encode()): r["n"] for r in words.collect() if len(r["word"].encode()) > 1}
    assert len(big.merges) == 1200 and big.merges[:25] == naive(counts, 25, 2)
    model_files.save_model(big, str(tmp_path / "m"))
    library = Tokenizer.from_file(str(tmp_path / "m" / "tokenizer.json"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in codec.encode(docs, big).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    rows = codec.measure(docs, big, ["lang"])
    assert rows.where("not is_lossless").isEmpty() and rows.agg({"n_tokens": "sum"}).first()[0] == sum(map(len, got.values()))
    report = {r["lang"]: r for r in metrics.domain_report(rows, ["lang"], len(big.ids), "all").collect()}
    assert report["all"]["n_used"] == len({x for ids in got.values() for x in ids}) and report["all"]["n_docs"] == len(texts)


@pytest.fixture(scope="module")
def model():
    text = "the cat sat on the mat that the other cat thought of 12 34"
    return codec.Model(V.learn({tuple("Ġ" + w): 3 for w in text.split()}, 30, 1))


def test_encode_decode(spark, model):
    texts = ["", None, "the cat", " the  mat\n\n", "naïve 🙂\x00", "<|pad|>the<|endoftext|>", "the cat"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, id string")
    encoded = codec.encode(docs, model, allowed="all")
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert ids[0] == ids[1] == [] and ids[5][0] == model.ids["<|pad|>"] and ids[2] == ids[6]
    back = {r["doc_id"]: r["text"] for r in codec.decode(encoded, model).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert all(model.decode(ids[i]) == (t or "") for i, t in enumerate(texts))
    bare = {r["doc_id"]: r["text"] for r in codec.decode(encoded, model, skip_special=True).collect()}
    assert bare[5] == "the"
    with pytest.raises(Exception, match="not allowed"):
        codec.encode(docs, model).collect()


def test_unknown_id_raises(spark, model):
    vocab = V.vocabulary_table(spark, model.merges)
    bad = spark.createDataFrame([(1, [99999])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="unknown token id"):
        codec.tokens_of(bad, vocab).collect()
    for i in (-2, -1, len(model.ids), 99999):
        with pytest.raises(Exception, match="unknown token id"):
            codec.decode(spark.createDataFrame([(1, [3, i])], "doc_id long, ids array<int>"), model).collect()
        with pytest.raises(ValueError, match="unknown token id"):
            model.decode([i])


def test_tokenize_and_broken_bytes(spark, model):
    docs = spark.createDataFrame([(1, "the cat"), (2, ""), (3, "é")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in codec.tokenize(docs, model).collect()}
    assert got == {1: model.bpe("the") + model.bpe(" cat"), 2: [], 3: model.bpe("é")}
    half = model.ids[model.letters[0xC3]]
    odd = spark.createDataFrame([(1, [half, model.ids["<|pad|>"], half])], "doc_id long, ids array<int>")
    assert codec.decode(odd, model).first()["text"] == "\ufffd<|pad|>\ufffd" == model.decode([half, model.ids["<|pad|>"], half])


def test_guard_raises_where_it_says(spark, model):
    docs = spark.createDataFrame([(1, "a<|pad|>"), (2, "a<|pad"), (3, "<|eos|>")], "doc_id long, text string")
    held = {r["doc_id"]: r["b"] for r in docs.select("doc_id", codec.holds_banned(F.col("text"), model.specials, {"<|eos|>"}).alias("b")).collect()}
    assert held == {1: True, 2: False, 3: False}
    for i, bad in held.items():
        one = codec.encode(docs.where(F.col("doc_id") == i), model, allowed={"<|eos|>"})
        if bad:
            with pytest.raises(Exception, match="not allowed"):
                one.collect()
        else:
            assert model.decode(one.first()["ids"]) == docs.where(F.col("doc_id") == i).first()["text"]


def test_dropout_is_seeded_and_lossless(spark, model):
    docs = spark.createDataFrame([(i, "the cat thought of the mat") for i in range(20)], "doc_id long, text string")
    one, two = (codec.encode_dropout(docs, model, 0.5).orderBy("doc_id").collect() for _ in range(2))
    assert one == two and len({tuple(r["ids"]) for r in one}) > 1
    assert all(model.decode(r["ids"]) == "the cat thought of the mat" for r in one)
    assert codec.encode_dropout(docs, model, 0.0).orderBy("doc_id").collect() == codec.encode(docs, model).orderBy("doc_id").collect()
    whole = [model.first[b] for b in b"the"]
    assert codec.encode_dropout(docs, model, 1.0).first()["ids"][:3] == whole


def test_model_files(tmp_path, model):
    from tokenizers import Tokenizer

    names = model_files.export_package(model, str(tmp_path), "demo", {"x": 1})
    assert {"vocab.json", "merges.txt", "tokenizer.json", "README.md"} <= set(names)
    again = model_files.load_model(str(tmp_path))
    assert again.ids == model.ids and again.merges == model.merges
    library = Tokenizer.from_file(str(tmp_path / "tokenizer.json"))
    assert library.encode(" the cat that", add_special_tokens=False).ids == [model.ids[t] for w in (" the", " cat", " that") for t in model.bpe(w)]


def test_folders_of_other_layouts(tmp_path, model, spark):
    """Ids of the folder's own vocabulary, special tokens without `all`, and bare folders of two files."""
    model_files.save_model(model, str(tmp_path / "a"))
    at = model_files.Folder(str(tmp_path / "b"), spark)
    order = {t: len(model.ids) + 4 - i for t, i in model.ids.items()}  # other ids, with a gap below
    at.dump("vocab.json", order)
    at.write("merges.txt", model_files.Folder(str(tmp_path / "a")).read("merges.txt"))
    at.dump("special_tokens_map.json", {"eos_token": "<|eos|>", "pad_token": {"content": "<|pad|>"}, "bos_token": "<|gone|>"})
    other = model_files.load_model(at.path, spark)
    assert other.ids == order and other.specials == ["<|eos|>", "<|pad|>"]
    assert [other.tokens[i] for i in other.encode_word(" the")] == model.bpe(" the") and other.decode(other.encode_word("naïve")) == "naïve"
    with pytest.raises(ValueError, match="unknown token id"):
        other.decode([0])
    assert pipelines.complete_artifacts(spark, at.path) == ["tokenizer.json", "tokenizer_config.json"] and pipelines.complete_artifacts(spark, at.path) == []
    assert model_files.load_model(at.path).ids == order
    with pytest.raises(FileNotFoundError):
        model_files.load_model(str(tmp_path / "none"))
    assert set(model_files.export_package(model, str(tmp_path / "dry"), "x", {}, dry_run=True)) == {*model_files.FILES, "README.md"} and not (tmp_path / "dry").exists()


def test_prefix_is_smaller_training():
    counts = {tuple(w): n for w, n in WORDS.items()}
    big = codec.Model(V.learn(counts, 6, 1))
    assert big.prefix(3).merges == V.learn(counts, 3, 1)


def test_counts_ignore_nothing(spark):
    docs = spark.createDataFrame([("a b",), ("a b",)], "clean string")
    assert {r["word"]: r["n"] for r in V.word_counts(docs).collect()} == {"a": 2, " b": 2, "\n\n": 2}
    assert V.pair_counts(V.with_symbols(V.word_counts(docs))).where(F.col("l") == "Ġ").first()["freq"] == 2


def test_segments_say_all(spark):
    """Rounds of few pairs give the merges of a recount: ties beyond the rows looked at, runs of one letter, tokens made twice."""
    rng = random.Random(31)
    for look, budget in ((2, 1), (16, 60), (2048, 1 << 20)):
        counts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 12))): rng.choice([1, 1, 2, 5]) for _ in range(30)} | {"aaaaaaa": 3, "b": 9}
        words = spark.createDataFrame(list(counts.items()), "word string, n long").coalesce(2)
        letters = codec.Model([]).letters
        want = naive({tuple(letters[b] for b in w.encode()): n for w, n in counts.items()}, 12, 2)
        assert V.merge_steps(words, 12, look=look, budget=budget) == want


def test_the_driver_gets_parts_of_words_only(spark, monkeypatch):
    """30,000 distinct words of 40 letters; what is learned from on the driver is a small part of them."""
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcdefgh") for _ in range(40)), 1) for _ in range(30_000)]
    words, sizes, learn = spark.createDataFrame(rows, "word string, n long"), [], V._learn
    monkeypatch.setattr(V, "_learn", lambda flat, *rest: sizes.append(len(flat)) or learn(flat, *rest))
    V.train(words, 256 + 2, specials=[])
    assert max(sizes) < 20_000


def test_rounds_grow_again_after_one_that_was_too_large(spark, monkeypatch):
    """The first pairs are in all words, later ones in short runs: 500 merges need ten passes; with slow growth they were 13."""
    rng = random.Random(41)
    parts = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(300)]
    counts = {"".join(rng.choices(parts, range(300, 0, -1), k=3)): rng.randint(1, 40) for _ in range(2000)}
    words, passes, cut = spark.createDataFrame(list(counts.items()), "word string, n long").coalesce(2), [], V.segments.segments
    monkeypatch.setattr(V.segments, "segments", lambda state, joins, chosen: passes.append(len(chosen)) or cut(state, joins, chosen))
    assert V.merge_steps(words, 500, budget=4000) == V.learn({tuple(w): n for w, n in counts.items()}, 500)
    assert len(passes) <= 11
