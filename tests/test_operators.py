import pytest
from pyspark.sql import functions as F

from corpusmill.operators import batching, codec, corpus, external, metrics, ordering, robustness, vocabulary as V
from corpusmill.plans import config as configs, pipelines
from corpusmill.sources import text_files
from corpusmill.streaming.decoder import TextDecoder, decode_stream, quota_stream

MODEL = codec.Model(V.learn({tuple("Ġthe"): 5, tuple("Ġcat"): 3}, 5, 1))


def test_batches(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, list(range(11))), (3, [])], "k int, ids array<int>")
    got = {r["k"]: (r["input_ids"], r["attention_mask"]) for r in batching.encode_batch(rows, 9, multiple=8).collect()}
    assert got[1] == ([1, 2, 3] + [9] * 13, [1] * 3 + [0] * 13) and len(got[2][0]) == 16 and got[3][1] == [0] * 16
    with pytest.raises(ValueError):
        batching.encode_batch(rows, None)
    windows = {r["k"]: r["w"] for r in rows.select("k", batching.windows(F.col("ids"), 5, 2).alias("w")).collect()}
    assert windows[2] == [[0, 1, 2, 3, 4], [3, 4, 5, 6, 7], [6, 7, 8, 9, 10]] and windows[1] == [[1, 2, 3]]
    blocks = {r["k"]: r["b"] for r in rows.select("k", batching.lm_blocks(F.col("ids"), 4).alias("b")).collect()}
    assert [tuple(b) for b in blocks[2]] == [([0, 1, 2, 3], [1, 2, 3, 4]), ([4, 5, 6, 7], [5, 6, 7, 8])]


def test_quota_and_split(spark):
    docs = spark.createDataFrame([(i, "s", "x" * 8) for i in range(10)], "doc_id long, source string, clean string")
    assert corpus.byte_quota(docs, 20).count() == 3  # 0, 8 and 16 are below the quota
    split = {r["doc_id"]: r["split"] for r in corpus.split_held_out(docs, 25, 15).collect()}
    assert split == {0: "eval", 1: "eval", 2: "train", 3: "train", 4: "train"}
    assert {r["split"]: r["n_bytes"] for r in corpus.manifest(corpus.split_held_out(docs, 25, 15)).collect()} == {"eval": 20, "train": 30}


def test_running_sums_and_places(spark):
    """Against plain loops, with a group that holds most rows, null groups and ties in the count."""
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.randint(0, 9)) for i in rng.sample(range(10**9), 400)]
    df = spark.createDataFrame(rows, "source string, doc_id long, n long").repartition(5)
    got = {r["doc_id"]: r["before"] for r in ordering.running(df, "source", "doc_id", {"before": "n"}).collect()}
    sums = {}
    for s, i, n in sorted(rows, key=lambda r: r[1]):
        assert got[i] == sums.get(s, 0)
        sums[s] = sums.get(s, 0) + n
    places = {r["doc_id"]: r["place"] for r in ordering.numbered(df, F.col("n").desc(), F.col("doc_id").asc()).collect()}
    assert places == {i: k for k, (_, i, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}
    assert ordering.numbered(df.limit(0), F.col("n").asc()).count() == 0 and ordering.running(df.limit(0), "source", "doc_id", {"x": "n"}).count() == 0


def test_mix_by_configuration(spark, tmp_path):
    """Shares by target, held out first, as reading the documents one by one gives them."""
    config = {"corpus": {"name": "m", "total_target_mb": 0.004, "eval_target_mb": 0.001, "seed": 3}, "sources": {"a": {"target_mb": 0.003}, "b": {"target_mb": 0.001, "text_column": "body"}, "off": {"target_mb": 5.0, "enabled": False}}}
    for name in ("c.yaml", "c.json"):
        configs.write_config(spark, config, str(tmp_path / name))
        assert configs.read_config(spark, str(tmp_path / name)) == config
    configs.check_total(config, 1e-9)
    with pytest.raises(ValueError, match="add up"):
        configs.check_total({"corpus": {"total_target_mb": 9}, "sources": {"a": {"target_mb": 3}}})
    docs = spark.createDataFrame([(i, s, f"{i} " + "word " * (10 + i % 17)) for i in range(120) for s in ("a", "b", "off", "unnamed")], "doc_id long, source string, text string")
    got = {(r["source"], r["doc_id"]): r["split"] for r in pipelines.build_mix(docs, config).collect()}
    want = {}
    for s, target in (("a", 0.003), ("b", 0.001)):
        train, held, total, sizes = int(target * 2**20), int(target / 0.004 * 0.001 * 2**20), 0, {"eval": 0, "train": 0}
        for i in range(120):
            n = len((f"{i} " + "word " * (10 + i % 17)).strip())
            if n < 50:
                continue
            if total >= train + held:
                break
            total += n
            split = "eval" if sizes["eval"] < held else "train"
            if split == "train" and sizes["train"] >= train:
                break
            sizes[split] += n + 2
            want[s, i] = split
    assert got == want and {"eval", "train"} == set(want.values())
    found = pipelines.write_manifest(pipelines.build_mix(docs, config), str(tmp_path / "m.json"), config, {"train": "x"})
    assert set(found["sources"]) == {"a", "b"} and found["train_doc_count"] == sum(v == "train" for v in want.values()) and found["train_sha256"] == "x"
    for name in ("a", "b"):
        docs.where(F.col("source") == name).withColumnRenamed("text", config["sources"][name].get("text_column", "text")).drop("doc_id", "source").write.parquet(str(tmp_path / name))
    read = pipelines.read_mix(spark, config, lambda name, _: str(tmp_path / name))
    assert {r["source"]: r["count"] for r in read.groupBy("source").count().collect()} == {"a": 120, "b": 120}


def test_global_shuffle(spark):
    docs = spark.createDataFrame([(i, "eval" if i % 5 == 0 else "train") for i in range(50)], "doc_id long, split string")
    rows = corpus.global_shuffle(docs).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(50)) and [r["split"] for r in rows] == ["train"] * 40 + ["eval"] * 10
    assert [r["doc_id"] for r in rows[:40]] != sorted(r["doc_id"] for r in rows[:40]) and rows == corpus.global_shuffle(docs.repartition(7)).orderBy("place").collect()


def test_lines_and_digests(spark, tmp_path):
    """Lines count in the order of names and places, whatever the sizes of the files; broken bytes are replaced."""
    import hashlib

    folder = tmp_path / "t"
    folder.mkdir()
    parts = {"b": [b"b%d" % i for i in range(3000)], "a": [b"a", b"x\xffy"], "c": [b"", b"end"]}
    for name, lines in parts.items():
        (folder / f"{name}.txt").write_bytes(b"\n".join(lines) + b"\n")
    want = [x.decode("utf-8", "replace") for name in "abc" for x in parts[name]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = [(r["line_no"], r["line"]) for r in text_files.read_corpus(spark, str(folder)).orderBy("line_no").collect()]
        assert got == list(enumerate(want))
        assert [r["line"] for r in text_files.read_corpus(spark, str(folder), 4).orderBy("line_no").collect()] == want[:4]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(25)], "doc_id long, clean string").repartition(6)
    whole = text_files.corpus_digest(docs, "doc_id").first()
    assert whole["sha256"] == hashlib.sha256("".join(f"text {i}\n\n" for i in range(25)).encode()).hexdigest()
    own = [hashlib.sha256(f"text {i}\n\n".encode()).hexdigest() for i in range(25)]
    blocks = [hashlib.sha256("".join(own[k : k + 10]).encode()).hexdigest() for k in (0, 10, 20)]
    found = text_files.block_digests(docs, "doc_id", block_docs=10)
    assert [r["sha256"] for r in found.orderBy("block").collect()] == blocks
    tree = text_files.tree_digest(found).first()
    assert tuple(tree) == (hashlib.sha256("".join(blocks).encode()).hexdigest(), whole["n_bytes"], 25)
    assert text_files.write_source(docs, str(tmp_path / "s")) == whole["n_bytes"] == sum(f.stat().st_size for f in (tmp_path / "s").glob("part-*"))


def test_runs(spark, tmp_path):
    """Folders name the runs, language-model figures are optional, reference files come last, a later entry replaces an earlier one."""
    base = str(tmp_path)
    assert pipelines.start_run(spark, f"{base}/runs", " My Run/1 ", {"a": 1}, "20260101_120000") == "20260101_120000_my_run_1"
    assert configs.read_config(spark, f"{base}/runs/20260101_120000_my_run_1/config.json") == {"a": 1}
    for name, cr, bpc in (("r1", 2.0, 1.23456), ("r2", 3.0, None)):
        pipelines.save_run(spark, f"{base}/runs", name, {"vocab_size": 300, "overall": {"compression_ratio": cr}}, MODEL, None if bpc is None else {"val_bits_per_character": bpc})
    (tmp_path / "reference_gpt.json").write_text('{"model_name": "G", "vocab_size": 9, "overall": {"compression_ratio": 2.5}, "domains": {"prose": {"compression_ratio": 4.0}}}')
    board = pipelines.rebuild_leaderboard(spark, f"{base}/runs", base)
    rows = [(r["run_id"], r["model_name"], r["overall_cr"], r["val_bpc"]) for r in board.orderBy("position").collect()]
    assert rows == [("r2", "r2", 3.0, None), ("reference_gpt", "G", 2.5, None), ("r1", "r1", 2.0, 1.235)]
    assert "| 1 | r2 | 300 | - | 3.0 | - | - |" in pipelines.leaderboard_markdown(board)
    assert pipelines.resolve_run(board, "Best").first()["run_id"] == "r2" and pipelines.resolve_run(board, "GPT").first()["run_id"] == "reference_gpt"
    with pytest.raises(ValueError, match="could be any"):
        pipelines.resolve_run(board, "r")
    assert pipelines.resolve_run(board, "r1").first()["run_id"] == "r1"
    assert pipelines.rebuild_leaderboard(spark, f"{base}/nothing").count() == 0


def test_external_tokenizer_and_throughput(spark):
    import json

    from corpusmill.sources import model_files

    docs = spark.createDataFrame([(1, "the cat the cat", "x"), (2, None, "y"), (3, "naïve 🙂", "x")], "doc_id long, text string, lang string")
    spec = json.dumps(model_files.model_texts(MODEL)["tokenizer.json"])
    one = pipelines.evaluate(docs, MODEL, ["lang"]).orderBy("lang").collect()
    two = pipelines.evaluate(docs, external.from_tokenizer_text(spec, "own"), ["lang"]).orderBy("lang").collect()
    assert [r.asDict() for r in one] == [r.asDict() for r in two]
    found = pipelines.throughput(docs, MODEL, repeats=1)
    assert set(found) == {"encode_mb_s", "encode_tokens_s", "decode_mb_s", "decode_tokens_s"} and all(v > 0 for v in found.values())


def test_quota_stream_across_batches(spark, tmp_path):
    rows = [(s, i, "x" * 10) for i in range(9) for s in ("a", "b")] + [("b", 90, "y" * 50)]
    for k in range(3):
        spark.createDataFrame(rows[k * 6 : k * 6 + 6] if k < 2 else rows[12:], "source string, doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = quota_stream(stream, 45).writeStream.format("memory").queryName("quota").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert sorted((r["source"], r["doc_id"]) for r in spark.table("quota").collect()) == [(s, i) for s in ("a", "b") for i in range(5)]


def test_prefix_cuts_the_last_document(spark):
    docs = spark.createDataFrame([(i, "abcde") for i in range(5)], "doc_id long, text string")
    assert [r["text"] for r in corpus.char_prefix(docs, 12).orderBy("doc_id").collect()] == ["abcde", "abcde", "ab"]


def test_corpus_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "src", f"text {i} " + "word " * 20) for i in range(20)], "doc_id long, source string, text string")
    built = pipelines.build_corpus(docs, 1000, 300)
    text_files.write_corpus(built, str(tmp_path / "c"))
    found = pipelines.write_manifest(built, str(tmp_path / "m.json"))
    assert found["total_bytes"] == sum(f.stat().st_size for f in (tmp_path / "c").rglob("part-*"))
    lines = text_files.read_corpus(spark, str(tmp_path / "c" / "split=train"))
    assert lines.where("line <> ''").count() == built.where("split = 'train'").count()


def test_zipf_and_leaderboard(spark):
    counts = spark.createDataFrame([("a", 8), ("b", 4), ("c", 4), ("d", 0)], "word string, n long")
    assert [tuple(r) for r in metrics.zipf(counts).orderBy("zipf_rank").collect()] == [("a", 8, 1, 8.0), ("b", 4, 2, 4.0), ("c", 4, 3, 2.6667)]
    runs = spark.createDataFrame([("a", 0, 1.0, 300), ("a", 1, 3.0, 300), ("b", 0, 2.0, 300)], "run_id string, seq int, overall_cr double, vocab_size int")
    board = metrics.leaderboard(runs)
    assert [(r["run_id"], r["overall_cr"]) for r in board.orderBy("position").collect()] == [("a", 3.0), ("b", 2.0)]
    assert pipelines.resolve_run(board, "best").first()["run_id"] == "a" and "| 1 | a |" in pipelines.leaderboard_markdown(board)


def test_loss_figures(spark):
    row = spark.range(1).select(*metrics.lm_figures(F.lit(2.5), F.lit(4.0))).first()
    assert tuple(row) == (0.625, 0.9017, 12.1825)


def test_stress_suite(spark):
    row = robustness.stress_summary(robustness.stress_suite(spark, MODEL)).first()
    assert (row["n_cases"], row["n_passed"], row["failures"]) == (55, 55, [])


def test_noise_matrix_without_noise(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "on the mat")], "doc_id long, text string")
    rows = {(r["noise"], r["dropout"]): r for r in robustness.noise_matrix(docs, MODEL, [0.0, 0.3], [0.0, 0.5]).collect()}
    sizes = [len(r["ids"]) for r in codec.encode(docs, MODEL).collect()]
    assert len(rows) == 4 and rows[0.0, 0.0]["mean_tokens"] == sum(sizes) / 2 and rows[0.0, 0.5]["mean_tokens"] >= rows[0.0, 0.0]["mean_tokens"]
    assert rows[0.0, 0.0]["compression_ratio"] == round(21 / sum(sizes), 4)


def test_noise_rules():
    """Each kind alone: swaps keep the letters, look-alikes and neighbours follow their tables, short texts lose nothing."""
    text = "the quick brown fox jumps over the lazy dog again and again"
    seen = {robustness.perturb(text, 1.0, seed) for seed in range(40)}
    assert len(seen) == 40 and all(len(t) <= len(text) for t in seen) and any(len(t) < len(text) for t in seen)
    assert all(len(robustness.perturb("short one", 1.0, seed)) == 9 for seed in range(40))
    letters = set(text) | set(robustness.LEET.values()) | set(robustness.NEIGHBOURS.values())
    assert all(set(t) <= letters for t in seen) and robustness.perturb(" \n\t", 1.0) == " \n\t"


def test_noise_is_seeded():
    text = "some quite ordinary words " * 5
    assert robustness.perturb(text, 0.2) == robustness.perturb(text, 0.2) != text and robustness.perturb(text, 0) == text


def test_incremental_decoder():
    ids = [MODEL.ids[MODEL.letters[b]] for b in "aé🙂".encode()]
    d = TextDecoder(MODEL)
    assert [d.feed(i) for i in ids] == ["a", "", "é", "", "", "", "🙂"] and d.flush() == ""
    assert d.feed(10**6) == "" and d.feed(ids[1]) == "" and d.flush() == "�"


def test_stream_keeps_bytes_across_batches(spark, tmp_path):
    ids = [MODEL.ids[MODEL.letters[b]] for b in "é🙂".encode()]
    for k, part in enumerate((ids[:1], ids[1:4], ids[4:])):
        rows = [(7, 10 * k + i, t, k == 2 and i == len(part) - 1) for i, t in enumerate(part)]
        spark.createDataFrame(rows, "stream_id long, pos long, token_id int, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id long, pos long, token_id int, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = decode_stream(stream, MODEL).writeStream.format("memory").queryName("decoded").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert "".join(sorted(r["text"] for r in spark.table("decoded").collect())) == "é🙂"
