import json

import pytest

from corpusmill.__main__ import COMMANDS, main


def test_commands_from_corpus_to_leaderboard(spark, tmp_path):
    """The commands in the order in which a user runs them."""
    at = str(tmp_path)
    config = {"corpus": {"name": "m", "total_target_mb": 0.02, "eval_target_mb": 0.004}, "sources": {"a": {"target_mb": 0.01}, "b": {"target_mb": 0.01, "text_column": "body"}}}
    (tmp_path / "mix.json").write_text(json.dumps(config))
    for name, column in (("a", "text"), ("b", "body")):
        spark.createDataFrame([(f"{name} {i} the cat sat on the mat, and that was {i * 7} times enough for it",) for i in range(300)], f"{column} string").write.parquet(f"{at}/raw/{name}")
    found = main(["prepare-data", "--config", f"{at}/mix.json", "--raw-dir", f"{at}/raw", "--processed-dir", f"{at}/corpus"], spark)
    assert found["train_doc_count"] > 200 and found["eval_doc_count"] > 40 and len(found["train_sha256"]) == 64
    assert json.loads((tmp_path / "corpus" / "corpus_manifest.json").read_text()) == found
    train, held = f"{at}/corpus/split=train", f"{at}/corpus/split=eval"
    run = main(["train", "--corpus", train, "--eval-corpus", held, "--vocab-size", "300", "--runs-dir", f"{at}/runs", "--run-name", "My run"], spark)
    assert run["run_id"].endswith("_my_run") and run["merges"] == 300 - 256 - 5
    model = f"{at}/runs/{run['run_id']}"
    kept = json.loads((tmp_path / "runs" / run["run_id"] / "metrics.json").read_text())
    assert set(kept["domains"]) == {"prose", "technical", "scientific", "code", "numbers", "urls", "edge_cases", "held_out"} and kept["overall"]["all_lossless"]
    assert main(["evaluate", "--model", model, "--eval-corpus", held, "--output", f"{at}/m.json"], spark)["overall"] == kept["overall"]
    (tmp_path / "recipe.json").write_text(json.dumps({"name": "sweep", "vocab_sizes": [280, 270], "corpus": train, "eval_corpus": held}))
    assert len(main(["run-experiment", "--config", f"{at}/recipe.json", "--runs-dir", f"{at}/runs"], spark)["runs"]) == 2
    table = main(["compare-runs", "--runs-dir", f"{at}/runs"], spark)["table"]
    assert table.count("\n| ") == 3 and "| 1 | " + run["run_id"] in table
    lm = main(["run-lm-benchmark", "--model", model, "--corpus", held, "--loss", "2.5", "--block-size", "16", "--blocks-dir", f"{at}/blocks"], spark)
    assert lm["val_loss_per_byte"] == round(2.5 / lm["bytes_per_token"], 4) and spark.read.parquet(f"{at}/blocks/train").count() > 3 * spark.read.parquet(f"{at}/blocks/val").count() > 0
    assert main(["visualize", "--run", model, "--corpus", train, "--output-dir", f"{at}/plots"], spark)["tables"] == ["length_figures", "merge_frequencies", "token_lengths", "zipf"]
    assert main(["push-to-hub", "--model", model, "--repo-id", "me/x", "--dry-run"], spark)["completed"] == []
    assert "README.md" in main(["push-to-hub", "--model", model, "--repo-id", "me/x", "--package-dir", f"{at}/package"], spark)["files"]
    shown = main(["interactive", "--model", model, "--text", "the cat"], spark)
    assert bytes.fromhex("".join(t["byte_hex"] for t in shown["tokens"])).decode() == "the cat" and len(shown["tokens"]) == shown["n_tokens"]
    assert main(["test-real-world", "--model", model], spark)["n_passed"] == 55
    assert main(["benchmark-inference", "--model", model, "--corpus", held, "--repeats", "1"], spark)["encode_mb_s"] > 0
    assert len(COMMANDS) == 11
    with pytest.raises(SystemExit):
        main(["train-nothing"], spark)
