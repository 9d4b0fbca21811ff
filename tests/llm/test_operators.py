"""Each operator against a brute-force version, with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer

import xxhash

from corpusmill.llm import similar as similar_module
from corpusmill.llm import bpe, chat, common, embedding, language, lines, mixing, quality, simhash, substring, topk

DOCS = "doc_id long, text string, source string, fp long, size long, span string, key string"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "s" if i % 3 else None, 1, 2, "x", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def corpus_texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) + ("\n" if rng.random() < 0.1 else "") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [t + "\n" + passage + "\n" + u for t, u in zip(texts[:15], texts[15:30])]
    texts += [texts[3]] * 5 + [texts[4].replace("a", "b", 1), None, "", " \n ", "one", "ab " * 100, "\n\n\n", "x" * 50_000]
    return texts


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(k, k + 1) for k in range(2000, 2040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_simhash(spark, corpus_texts):
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs_of(spark, corpus_texts)).collect()}
    prints = [simhash.simhash(t.encode() if t else None) for t in corpus_texts]
    comp = list(range(len(prints)))
    for _ in prints:
        comp = [min(comp[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(prints))]
    assert got == {i: (prints[i], comp[i]) for i in range(len(prints))}
    plain = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, corpus_texts), screen=False).collect()}
    assert plain == {i: c for i, (_, c) in got.items()}
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_simhash_with_similarity(spark, corpus_texts):
    """All texts of 0.8 and more are together, and no others."""
    rng = random.Random(3)
    texts = list(corpus_texts)
    for t in [t for t in corpus_texts if t and len(t.split()) > 70][:8]:
        words = t.split(" ")
        for edits in (1, 1, 2, 3, 4, 9):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "zz%d" % rng.randrange(1000)
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})
    alike = [[len(a & b) / len(a | b) for b in sets] for a in sets]

    def groups(bound):
        comp = list(range(len(sets)))
        for _ in sets:
            comp = [min(comp[j] for j in range(len(sets)) if alike[i][j] >= bound) for i in range(len(sets))]
        return comp

    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, texts), words=5, similarity=0.8).collect()}
    want = groups(0.8)
    assert got == dict(enumerate(want)) and len(set(want)) < len(texts) - 20
    assert simhash.near_duplicates(docs_of(spark, []), words=5, similarity=0.8).count() == 0
    odd = docs_of(spark, ["a b c d e f", "a b c d e f", None, "", "a b c d e f"], [7, None, None, 3, 7])
    assert sorted(r["component_id"] for r in simhash.near_duplicates(odd, words=5, similarity=0.8).collect()) == [3, 3, 7, 7, 7]


def similar(texts, bound):
    """The smallest index of each text's group: linked by exact five-word shingle similarity."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    comp = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if comp[i] != comp[j] and len(a & sets[j]) / len(a | sets[j]) >= bound:
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    return comp


def test_simhash_similarity_is_exact_at_the_bound(spark):
    """Pairs of similarity 0.74 to 0.86, many at 0.8 exactly and just below: those of 0.8 and more link, no others."""
    rng = random.Random(12)
    texts = []
    for k in range(150):
        words = ["w%d_%d" % (k, i) for i in range(184)]  # 180 shingles; 20 other words at the end give 160 / 200
        other = 14 + k % 13
        texts += [" ".join(words), " ".join(words[:-other] + ["x%d_%d" % (k, rng.randrange(10**9)) for _ in range(other)])]
    want = similar(texts, 0.8)
    assert 20 < len(texts) - len(set(want)) < 130
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, texts), words=5, similarity=0.8).collect()}
    assert got == dict(enumerate(want))


def test_simhash_finds_pairs_in_hot_buckets(spark):
    """A family of one template, of similarity 0.75 to each other, with planted pairs above 0.8."""
    rng = random.Random(13)
    template = ["t%d" % i for i in range(600)]
    texts = []
    for k in range(330):
        fill = ["f%d_%d" % (k, i) for i in range(96)]
        texts.append(" ".join(template + fill))
        if k < 30:
            texts.append(" ".join(template + fill[:60] + ["g%d_%d" % (k, rng.randrange(10**9)) for _ in range(36)]))
    want = similar(texts, 0.8)
    assert len(texts) - len(set(want)) >= 30 and len(set(want)) > 100
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, texts), words=5, similarity=0.8).collect()}
    assert got == dict(enumerate(want))


def test_ball_hashing_finds_all_within_radius(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(200)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), k)) for p in prints[:100] for k in (2, 4, 5)]
    fps = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in set(prints)], "fp long")
    groups = common.connected_components(simhash.fingerprint_links(fps))
    roots = {p: p for p in prints} | {r["node"] % 2**64: r["component"] % 2**64 for r in groups.collect()}
    for a in set(prints):
        for b in set(prints):
            if (a ^ b).bit_count() <= 4:
                assert roots[a] == roots[b]


def thue_morse(n):
    """Two words of 2**n letters that polynomial hashes modulo a power of two do not tell apart."""
    one, two = "a", "b"
    for _ in range(n):
        one, two = one + two, two + one
    return one, two


def test_word_hashes_tell_hard_words_apart(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("ab\x00é") for _ in range(rng.randint(1, 20))) for _ in range(2000)] + [w for n in (3, 4, 5, 10, 12) for w in thue_morse(n)]
    words = sorted({w for w in words if w.split() == [w]})
    data = [w.encode() for w in words]
    hashes = common.word_hashes(*common.words_of(data)[:3])
    assert len(set(hashes.tolist())) == len(words)
    assert not set(hashes.tolist()) & set(common.word_hashes(*common.words_of(data)[:3], 1).tolist())
    again = common.word_hashes(*common.words_of([b" ".join(data)])[:3])
    assert (hashes == again).all()


@pytest.mark.parametrize("n", [10, 12])
def test_substring_and_similarity_with_hard_words(spark, n):
    one, two = thue_morse(n)
    rest = " ".join("w%d" % i for i in range(19))
    docs = docs_of(spark, [f"{one} {rest}", f"{two} {rest}"], [1, 2])
    got = {r["doc_id"]: r["n_removed"] for r in substring.without_repeats(docs).collect()}
    assert got == {1: 0, 2: 0}
    assert (similar_module.shingle_set(one.encode()) != similar_module.shingle_set(two.encode())).all()
    order = " ".join("ab"[bin(i).count("1") % 2] for i in range(20)), " ".join("ba"[bin(i).count("1") % 2] for i in range(20))
    assert [r["n_removed"] for r in substring.without_repeats(docs_of(spark, list(order))).collect()] == [0, 0]


def test_substring_rows_that_share_an_id(spark):
    """Rows of one id, or none, but other texts are documents of their own, in the order of their texts' hashes."""
    w = " ".join("w%d" % i for i in range(30))
    for key in (1, None):
        rows = substring.without_repeats(docs_of(spark, [w, "zz " + w], [key, key])).collect()
        assert sorted((r["n_words"], r["n_removed"]) for r in rows) in ([(30, 0), (31, 30)], [(30, 30), (31, 0)])
    rows = substring.without_repeats(docs_of(spark, [w, "other words", w + " end", w], [None, None, 4, 2])).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in rows) == [(0, 2, 0), (0, 30, 0), (2, 30, 30), (4, 31, 30)]
    copies = substring.without_repeats(docs_of(spark, [w, w, "zz " + w], [7, 7, 8])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in copies) == [(7, 0), (7, 0), (8, 30)]


def test_fingerprint_against_a_plain_version():
    rng = random.Random(11)
    words = ["The", "cat", "É", "日本", "sat", "a\u00a0b", "x" * 40]
    for _ in range(200):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "  "]) for _ in range(rng.randint(0, 30)))
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        tokens = [t for t in __import__("re").split(rb"[\x20\x09-\x0D]+", raw) if t]
        shingles = [b" ".join(tokens[i : i + 4]) for i in range(max(1, len(tokens) - 3))] if tokens else []
        votes = [sum(xxhash.xxh64_intdigest(x, seed=42) >> b & 1 for x in shingles) for b in range(64)]
        assert simhash.simhash(text.encode()) == sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_representatives(spark):
    """One row of each group stays: smallest id, then smallest hash of the text; null ids last; equal rows once."""
    t = " ".join("w%d" % i for i in range(60))
    near = t + " more"
    docs = docs_of(spark, [t, near, t, "other text", t, None, "", "lone"], [5, 3, 3, 5, None, None, 9, None])
    left = simhash.representatives(docs, simhash.near_duplicates(docs, words=5, similarity=0.8))
    got = sorted(((r["doc_id"] or -1), r["text"] or "") for r in left.collect())
    assert [g for g in got if g[1] not in (t, near)] == [(-1, "lone"), (5, "other text"), (9, "")]
    assert len(got) == 4 and [g[0] for g in got if g[1] in (t, near)] == [3]
    assert left.columns == docs.columns
    assert simhash.representatives(docs.limit(0), simhash.near_duplicates(docs.limit(0), words=5, similarity=0.8)).count() == 0


def test_substring(spark, corpus_texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.without_repeats(docs_of(spark, corpus_texts)).collect()}
    seen, want = set(), {}
    for i, t in enumerate(corpus_texts):
        words = (t or "").split()
        gone = set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            gone |= set(range(k, k + 20)) if w in seen else set()
            seen.add(w)
        want[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    assert got == want
    twice = substring.without_repeats(docs_of(spark, [corpus_texts[0] + " more"] * 2, [None, None])).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]  # rows of one id and text are one document
    assert substring.without_repeats(docs_of(spark, [])).count() == 0


def test_substring_takes_long_texts_in_short_batches(spark):
    own = spark.newSession()
    docs = own.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 1500) AS text")
    substring.without_repeats(docs)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) > 16 << 20 and max(r["n"] for r in sizes) < 5 << 20
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 9 << 20)  # the session's own limit stays
    substring.without_repeats(docs)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(9 << 20)


def test_lines(spark, corpus_texts):
    got = {r["doc_id"]: (r["n_removed"], r["text"], r["size"]) for r in lines.without_repeated_lines(docs_of(spark, corpus_texts)).collect()}
    seen, want = set(), {}
    for i, t in enumerate(corpus_texts):
        own = [(k, x, len(x.split())) for k, x in enumerate((t or "").split("\n")) if x.split()]
        gone, fresh = set(), []
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = tuple(x for _, x, _ in own[a:b])
                if sum(n for *_, n in own[a:b]) >= 20:
                    gone |= {k for k, *_ in own[a:b]} if run in seen else set()
                    seen.add(run)
        want[i] = (len(gone), t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), 2)
    assert got == want
    assert lines.without_repeated_lines(docs_of(spark, [])).count() == 0


def test_lines_with_shared_ids_and_clashing_columns(spark):
    """Null ids come first; rows of one id but other texts are told apart, equal rows fare alike; other columns stay."""
    rows = [(None, "x y\nz"), (3, "x y\nq"), (3, "x y\nr"), (3, "x y\nr"), (None, None)]
    docs = spark.createDataFrame([(i, t, 7, "th", "gone", 1, 2) for i, t in rows], "doc_id long, text string, d int, th string, gone string, n_lines int, k int")
    out = lines.without_repeated_lines(docs, min_words=1)
    assert sorted(out.columns) == sorted(["doc_id", "text", "d", "th", "gone", "k", "n_lines", "n_removed"])
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["n_lines"], r["n_removed"], r["d"], r["th"], r["gone"], r["k"]) for r in out.collect())
    assert [g[:4] for g in got] == [(0, "", 0, 0), (0, "x y\nz", 2, 0), (3, "q", 2, 1), (3, "r", 2, 1), (3, "r", 2, 1)] and all(g[4:] == (7, "th", "gone", 2) for g in got)


def test_lines_without_floor(spark):
    """From one word on, later copies of every repeated line go, whatever lies around them."""
    texts = ["one\ntwo\n\nthree", "two\nfour five\n", "x\nthree\n\nx\none", None, ""]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.without_repeated_lines(docs_of(spark, texts), min_words=1).collect()}
    assert got == {0: (texts[0], 0), 1: ("four five\n", 1), 2: ("x\n", 3), 3: (None, 0), 4: ("", 0)}


def test_mixing(spark, corpus_texts):
    docs = docs_of(spark, corpus_texts)
    rows = mixing.mix(docs, block_words=10).collect()
    again = mixing.mix(docs.repartition(7), block_words=10).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    for source in ("s", None):
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 10 and all(0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
    mixed = mixing.mixed_rows(mixing.mix(docs))
    assert mixed.select(lines.words_in(mixed["text"]).alias("n")).agg({"n": "sum"}).first()[0] == sum(r["taken"] for r in mixing.mix(docs).collect())
    assert mixing.mix(docs_of(spark, [])).count() == 0


def brute_taken(rows, targets, block, shard_rows, most):
    """taken of each row by plain loops: highest quotients block by block, seeded order, whole passes first."""
    def seats(votes, n):
        got = [0] * len(votes)
        for _ in range(n if sum(votes) else 0):
            got[max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
        return got

    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    out = {}
    for name, blocks in zip(names, seats([targets[s] for s in names], round(sum(targets.values()) / block)), strict=True):
        own = [r for r in rows if r["source"] == name]
        n = max(1, -(-len(own) // shard_rows))
        shards = [[r for r in own if r["place"] % n == k] for k in range(n)]
        held = [sum(r["size"] for r in x) for x in shards]
        for docs, words, got in zip(shards, held, seats(held, blocks), strict=True):
            left = min(got * block, most * words)
            whole = left // words if words else 0
            left -= whole * words
            for r in sorted(docs, key=lambda r: (r["order"], r["doc_id"], r["size"])):
                out[r["doc_id"]] = whole * r["size"] + max(0, min(left, r["size"]))
                left -= r["size"]
    return out


def test_mix_against_plain_loops(spark, corpus_texts):
    from pyspark.sql import functions as F

    docs = docs_of(spark, corpus_texts).drop("size")
    keyed = docs.select("doc_id", "source", lines.words_in(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(17)).alias("place"), F.xxhash64("doc_id", "text", F.lit(18)).alias("order"))
    for block, shard_rows in ((10, 7), (100, 2000), (3, 1)):
        rows = mixing.mix(docs, block_words=block, shard_rows=shard_rows).collect()
        got = {r["doc_id"]: r["taken"] for r in rows}
        assert got == brute_taken([r.asDict() for r in keyed.collect()], {r["source"]: r["target"] for r in rows}, block, shard_rows, 3)


def test_mix_with_clashing_and_null_columns(spark):
    rows = [(None, "a b c", "s", "x"), (None, "a b c", "s", "y"), (1, None, None, "z"), (1, "d e", None, "w"), (2, "", "t", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string").selectExpr("*", "1 AS size", "2 AS target", "3 AS source_size", "4 AS mixture")
    out = mixing.mix(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "source", "mixture", "size", "source_size", "target", "taken"]) and out.count() == 5
    assert sum(r["size"] for r in out.collect()) == 8 and all(0 <= r["taken"] <= 3 * r["size"] for r in out.collect())


def test_mixed_rows_keep_white_space(spark):
    """A document cut at the border is a beginning of its text, up to the end of a word."""
    texts = [" \n a\tb\n\nc  d\n", "e\nf", "g", "  ", "h  i"]
    taken = [3, 5, 2, 0, 1]
    rows = [(i, t, len(t.split()), 0, 0.0, n) for i, (t, n) in enumerate(zip(texts, taken))]
    mixed = spark.createDataFrame(rows, "doc_id long, text string, size long, source_size long, target double, taken long")
    got = sorted((r["doc_id"], r["text"]) for r in mixing.mixed_rows(mixed).collect())
    assert got == [(0, " \n a\tb\n\nc"), (1, "e"), (1, "e\nf"), (1, "e\nf"), (2, "g"), (2, "g"), (4, "h")]


def test_apportionment():
    rng = random.Random(2)
    for _ in range(50):
        votes, seats = [rng.randint(0, 50) for _ in range(6)], rng.randint(0, 40)
        want = [0] * 6
        for _ in range(seats if sum(votes) else 0):
            want[max(range(6), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(np.array(votes), seats).tolist() == want
    assert mixing.water_fill(100, [1, 1, 2], [10, 100, 100]) == [10, 30, 60]


def test_bpe_equals_the_library(spark, corpus_texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = ["a", "ing", " ", "\n", "'s", "é", "日本", "🙂", "12", "...", "<|endoftext|>", "\x00", " ", "====", "꟒", "the"]
    texts = corpus_texts + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    encoded = bpe.encode(docs_of(spark, texts), path)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, path).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want and back[i] == library.decode(want, skip_special_tokens=False)
    row = bpe.round_trip(docs_of(spark, ["the <|endoftext|>"]), path).first()
    assert row["ids_sha256"] == hashlib.sha256(b"1169,220,50256").hexdigest() and row["decoded_sha256"] == hashlib.sha256(b"the <|endoftext|>").hexdigest()
    assert bpe.round_trip(docs_of(spark, []), path).count() == 0


def test_bpe_words_are_those_of_the_pattern():
    codec = bpe.Codec(bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json")))
    rng, alphabet = random.Random(8), [*" '  \t\nstredvmlT01.-éñ日٣²\u3000\x1c\x85🙂", "'re", "'ll", "'s"]
    texts = ["", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(3000)), "a<|endoftext|> b", ""]
    words, ends = codec.words(texts)
    words = [w.decode() for w in words.to_pylist()]
    got = [words[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
    assert got == [*(regex.findall(bpe.PATTERN, t) for t in texts[:-2]), ["a", "<|endoftext|>", " b"], []]


def test_bpe_looks_only_at_tokens_that_end_at_a_place():
    rng = random.Random(9)
    for _ in range(50):
        ids = {t: i for i, t in enumerate({bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(30)})}
        ends, word, state = bpe.Endings(ids, len(ids)), bytes(rng.choices(b"abcd", k=40)), 0
        for k in range(1, len(word) + 1):
            state, found = ends.move(state, word[k - 1]), []
            token = ends.longest[state]
            while token >= 0:
                found.append(token)
                token = ends.shorter[token]
            assert found == [ids[word[i:k]] for i in range(k) if word[i:k] in ids]


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "a\\<|b"), (1, 1, "assistant", said), (1, 2, "user", None), (1, 3, "assistant", "x\n<\\|"), (None, 0, None, "y"), (2, 0, "ro\nle\\", "<|"), (2, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "x")
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digest(formatted).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_sha256"] == hashlib.sha256((said + "x\n<\\|").encode()).hexdigest()
    turns = "".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 1)
    assert got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and got[None]["n_turns"] == 1
    assert chat.parse(formatted.where("conv_id = 2").first()["formatted"]) == [("assistant", "tie"), ("ro\nle\\", "<|")]

    def rewriting(turns):
        return f"{len(turns)} turns:" + "".join(t for _, t in turns)

    assert chat.locate([("user", "a"), ("assistant", "b")], rewriting)[2] and not chat.locate([("user", "a")], chat.render)[2]
    assert chat.format_conversations(df.limit(0)).count() == 0


def vectors(spark, rng, n=300):
    base = rng.standard_normal((n, 16))
    base[50:120] = base[0] + 0.05 * rng.standard_normal((70, 16))
    base[120:140] = base[1]
    rows = [(i, [float(v) for v in x], i % 2) for i, x in enumerate(base)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, [], 0), (906, [float("inf")] + [1.0] * 15, 0)]
    return rows


def test_embedding(spark):
    rows = vectors(spark, np.random.default_rng(3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (16, 256):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding.near_duplicates(df, block_rows=block).collect()}
        unit = {i: np.array(v) / np.linalg.norm(v) for i, v, c in rows if i < 900}
        near = {i: {j for j in unit if j != i and j % 2 == i % 2 and unit[i] @ unit[j] >= 0.93} for i in unit}
        comp = {i: i for i in unit}
        for _ in range(5):
            comp = {i: min([comp[i], *(comp[j] for j in near[i])]) for i in unit}
        assert {i: got[i] for i in unit} == {i: (len(near[i]), comp[i], comp[i] == i) for i in unit}
        assert all(got[i] == (0, i, True) for i in range(900, 907))
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_topk(spark):
    rows = vectors(spark, np.random.default_rng(8), 500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = topk.quantised(df, "vec_id", "embedding", 64.0)
    got = {}
    for r in topk.top_k(q.where("vec_id % 20 = 0"), q, 20, shard_rows=60, block_rows=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i in (k for k in whole if k % 20 == 0):
        want = sorted(((j, dot(whole[i], whole[j])) for j in whole if j != i), key=lambda x: (-x[1], x[0]))[:20]
        assert got[i] == want
    assert topk.top_k(q.limit(0), q).count() == 0
    few = topk.top_k(q.where("vec_id = 0"), q.where("vec_id < 5").withColumn("score", q.vec_id).withColumn("rank", q.vec_id), 20).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(k + 1, j) for k, j in enumerate(sorted((1, 2, 3, 4), key=lambda j: (-dot(whole[0], whole[j]), j)))]


def test_tree_descent_cuts_subtrees():
    """Clustered points: a query's own cluster is found and most leaves are never looked at."""
    rng = np.random.default_rng(4)
    points = (rng.standard_normal((32, 8)) * 1000).repeat(64, axis=0).astype(np.int64) + rng.integers(-3, 4, (2048, 8))
    order, centers, radii, nodes = topk.build_tree(points, 32)
    tree = {"ids": order, "vectors": points[order], "centers": centers, "radii": radii, "nodes": nodes}
    queries = points[::100]
    best, looked = topk.Best(np.arange(0, 2048, 100), 5, np.full(len(queries), -np.inf)), []
    plain = best.add
    best.add = lambda rows, ids, scores: (looked.append(len(rows)), plain(rows, ids, scores))
    topk.search_tree(tree, queries, best)
    assert sum(looked) < len(queries) * int(nodes[:, 3].sum()) / 4
    for k, q in enumerate(queries):
        scores = points @ q
        want = sorted((j for j in range(2048) if j != k * 100), key=lambda j: (-scores[j], j))[:5]
        assert best.ids[k].tolist() == want


def test_language(spark):
    rng = random.Random(6)
    kinds = {"xx": ["ba", "bo", "li", "ta"], "yy": ["ing", "sch", "ung", "pf"]}
    text = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(k, 40), k) for i, k in enumerate(["xx", "yy"] * 60)] + [(900, None, "xx"), (901, "12 !?", "yy"), (902, "", None), (903, text("xx", 9000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = df.where("doc_id % 4 <> 0 or doc_id >= 900")
    got = {r["doc_id"]: r for r in language.identify(df, language.train(learn)).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 for i, _, k in rows[:120]) and got[903]["lang_pred"] == "xx"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert language.identify(df, language.train(df.limit(0))).where("lang_pred <> 'und'").count() == 0
    counts = {"xx": tuple(np.unique(language.grams([r[1] for r in rows[:120:2]])[0], return_counts=True))}
    model = language.kneser_ney(counts)
    heads = counts["xx"][0][:5] >> np.uint64(16)
    every = np.unique(counts["xx"][0] & np.uint64(0xFFFF))
    for h in heads:  # the probabilities that follow a context sum to one, with the unseen character
        total = np.exp2(model.log_probs((h << np.uint64(16)) | np.append(every, np.uint64(0xFFFE)))).sum()
        assert abs(total - 1) < 1e-3


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["Some", "plain", "words", "are", "here."]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW$$$", "|", "###"]) for _ in range(30))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(900, None), (None, 1)], "doc_id long, quality int")
    fold = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    model = quality.train(df, labels.where(labels.doc_id.isin(fold) | (labels.doc_id >= 900)))
    got = {r["doc_id"]: r for r in quality.classify(df, model).collect()}
    assert sum(got[i]["predicted"] == int(i % 4 > 0) for i in range(400)) >= 398
    assert 0 <= got[900]["score"] <= 1 and got[900]["score"] == got[901]["score"]
    assert quality.classify(df.limit(0), model).count() == 0
    assert quality.train(df.limit(0), labels.limit(0)).margins([b"x"])[0] == 0


def test_kneser_ney_against_dictionaries():
    """Interpolated Kneser-Ney of two languages by plain dictionaries: all probabilities agree, seen and unseen."""
    rng = random.Random(21)
    samples = {"xx": ["".join(rng.choice("aab ") for _ in range(40)) for _ in range(12)], "yy": ["".join(rng.choice("abccd ") for _ in range(40)) for _ in range(9)]}
    packed = {k: language.grams(t)[0] for k, t in samples.items()}
    model = language.kneser_ney({k: tuple(np.unique(p, return_counts=True)) for k, p in packed.items()})
    tup = lambda g: tuple((int(g) >> (16 * k)) & 0xFFFF for k in range(language.ORDER - 1, -1, -1))
    alphabet = {tup(g)[-1] for p in packed.values() for g in p}
    asked = sorted({*packed["xx"].tolist(), *packed["yy"].tolist(), *(rng.getrandbits(64) for _ in range(20)), *(int(g) ^ 1 for g in packed["xx"][:50])})
    got = model.log_probs(np.array(asked, dtype=np.uint64))
    for j, lang in enumerate(["xx", "yy"]):
        level = {language.ORDER: {}}
        for g in packed[lang]:
            level[language.ORDER][tup(g)] = level[language.ORDER].get(tup(g), 0) + 1
        for k in range(language.ORDER - 1, 0, -1):
            level[k] = {}
            for g in level[k + 1]:
                level[k][g[1:]] = level[k].get(g[1:], 0) + 1

        def prob(gram, k):
            if k == 0:
                return 1 / (len(alphabet) + 1)
            own, counts = gram[-k:], level[k]
            ones, twos = (sum(n == x for n in counts.values()) for x in (1, 2))
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            same = [n for g, n in counts.items() if g[:-1] == own[:-1]]
            if not same:
                return prob(gram, k - 1)
            return max(counts.get(own, 0) - (discount if own in counts else 0), 0) / sum(same) + discount * len(same) / sum(same) * prob(gram, k - 1)

        for i, g in enumerate(asked):
            assert abs(got[i, j] - np.log2(prob(tup(g), language.ORDER))) < 1e-3


def test_ratio_and_hinge_loss_against_plain_versions():
    """Log-count ratios by counting; dual coordinate descent reaches the objective that slow projected gradients reach."""
    rng = np.random.default_rng(9)
    labels = rng.integers(0, 2, 60)
    docs = [np.unique(np.concatenate([rng.integers(0, 40, 6), rng.integers(40, 60, 2) + 10 * y])).astype(np.int32) for y in labels.tolist()]
    ratio = quality.log_count_ratio(docs, labels)
    counts = {y: {} for y in (0, 1)}
    for d, y in zip(docs, labels.tolist(), strict=True):
        for f in d.tolist():
            counts[y][f] = counts[y].get(f, 0) + 1
    total = {y: sum(c.values()) + (1 << quality.BITS) for y, c in counts.items()}
    for f in range(80):
        assert abs(ratio[f] - np.log((counts[1].get(f, 0) + 1) / total[1] / ((counts[0].get(f, 0) + 1) / total[0]))) < 1e-9
    signs, costs = np.where(labels == 1, 1.0, -1.0), np.full(60, 0.7)
    x = np.zeros((60, 81))
    for i, d in enumerate(docs):
        x[i, d] = ratio[d] / np.linalg.norm(ratio[d])
    x[:, 80] = 1.0  # the bias
    loss = lambda v: 0.5 * v @ v + (costs * np.maximum(0, 1 - signs * (x @ v))).sum()
    w, bias = quality.dual_coordinate_descent(docs, ratio, signs, costs, epochs=400)
    alpha = np.zeros(60)
    gram = (signs[:, None] * x) @ (signs[:, None] * x).T
    for _ in range(20_000):
        alpha = np.clip(alpha - 0.01 * (gram @ alpha - 1), 0, costs)
    assert abs(loss(np.append(w[:80], bias)) - loss((alpha * signs) @ x)) < 1e-2 * loss((alpha * signs) @ x)
