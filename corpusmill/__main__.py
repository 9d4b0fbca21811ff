"""The procedures from the command line: python -m corpusmill COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import batching, codec, metrics, robustness
from .operators import vocabulary as V
from .plans import config as configs
from .plans import pipelines
from .session import local_session, write_text
from .sources import model_files, text_files

COMMANDS: dict = {}


def _command(*options):
    """Registers a command; options: (name, settings of add_argument)."""

    def add(f):
        COMMANDS[f.__name__.replace("_", "-")] = (f, options)
        return f

    return add


_MODEL, _OUTPUT, _CORPUS = ("--model", {"required": True}), ("--output", {}), ("--corpus", {})


def _shown(value: dict, spark: SparkSession, output: str | None) -> dict:
    text = json.dumps(value, ensure_ascii=False, indent=2, default=str)
    if output:
        write_text(spark, output, text)
    print(text)
    return value


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return text_files.read_corpus(spark, path).select(F.lit("held_out").alias("domain"), F.concat("line", F.lit("\n")).alias("text"))


@_command(("--config", {"required": True}), ("--raw-dir", {"required": True}), ("--processed-dir", {"required": True}), ("--format", {"default": "parquet"}))
def prepare_data(spark, a):
    """Builds the corpus of a mix configuration from <raw-dir>/<source> and writes its files and manifest."""
    config = configs.read_config(spark, a.config)
    configs.check_total(config)
    docs = pipelines.read_mix(spark, config, lambda name, _: f"{a.raw_dir}/{name}", a.format)
    built = pipelines.build_mix(docs, config)
    text_files.write_corpus(built, a.processed_dir)
    digests = {s: text_files.tree_digest(text_files.block_digests(built.where(F.col("split") == s), "key")).first()["sha256"] for s in ("train", "eval")}
    return pipelines.write_manifest(built, f"{a.processed_dir}/corpus_manifest.json", config, digests)


@_command(_CORPUS, ("--config", {}), ("--runs-dir", {"default": "runs"}), ("--eval-corpus", {}), ("--vocab-size", {"type": int}), ("--min-frequency", {"type": int}), ("--digit-mode", {"choices": ["clustered", "single"], "default": "clustered"}), ("--max-lines", {"type": int}), ("--run-name", {"default": "run"}))
def train(spark, a):
    """Learns a vocabulary from corpus files, evaluates it and saves the run."""
    config = (configs.read_config(spark, a.config) if a.config else {}).get("tokenizer", {})
    model = pipelines.train_on_files(spark, a.corpus, a.vocab_size or config.get("vocab_size", 32_000), a.min_frequency or config.get("min_frequency", 2), a.digit_mode, a.max_lines)
    run_id = pipelines.start_run(spark, a.runs_dir, a.run_name, {"vocab_size": len(model.ids), "digit_mode": a.digit_mode, "corpus": a.corpus})
    pipelines.save_run(spark, a.runs_dir, run_id, _figures(spark, model, a.eval_corpus, run_id), model)
    return {"run_id": run_id, "merges": len(model.merges)}


def _figures(spark, model, eval_corpus, name) -> dict:
    slices = robustness.slice_table(spark)
    rows = slices.unionByName(_lines(spark, eval_corpus)) if eval_corpus else slices
    return pipelines.figures(model, pipelines.evaluate(rows, model, ["domain"], overall="overall"), name)


@_command(_MODEL, ("--eval-corpus", {}), _OUTPUT)
def evaluate(spark, a):
    """Metrics over the built-in slices and a held-out corpus."""
    return _shown(_figures(spark, model_files.load_model(a.model, spark), a.eval_corpus, a.model.rstrip("/").rsplit("/", 1)[-1]), spark, a.output)


@_command(_MODEL, _CORPUS, ("--loss", {"type": float}), ("--block-size", {"type": int, "default": 512}), ("--blocks-dir", {}), _OUTPUT)
def run_lm_benchmark(spark, a):
    """Blocks of token ids for a language model (train and validation), and the figures of a loss that one has reached."""
    model = model_files.load_model(a.model, spark)
    docs = text_files.read_corpus(spark, a.corpus).groupBy(F.expr("line_no div 1024").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    ids = codec.encode(docs, model, allowed="all")
    totals = ids.join(docs, "doc_id").agg(F.sum(F.size("ids")).alias("tokens"), F.sum(F.octet_length("text") + 1).alias("bytes")).first()
    if a.blocks_dir:
        for split, part in zip(("train", "val"), batching.split_ids(F.col("ids")), strict=True):
            ids.select(F.explode(batching.lm_blocks(part, a.block_size)).alias("b")).select("b.*").write.mode("overwrite").parquet(f"{a.blocks_dir}/{split}")
    found = {"tokens": totals["tokens"], "bytes": totals["bytes"], "bytes_per_token": totals["bytes"] / max(totals["tokens"], 1)}
    if a.loss is not None:
        row = spark.range(1).select(*metrics.lm_figures(F.lit(a.loss), F.lit(found["bytes_per_token"]))).first()
        found |= {"val_loss_per_token": a.loss, "val_loss_per_byte": row["loss_per_byte"], "val_bits_per_character": row["bits_per_byte"], "val_perplexity": row["perplexity"]}
    return _shown(found, spark, a.output)


@_command(("--run", {"required": True}), _CORPUS, ("--output-dir", {"required": True}))
def visualize(spark, a):
    """The tables behind the plots: token lengths, merge frequencies, and Zipf ranks of a corpus."""
    model = model_files.load_model(a.run, spark)
    vocab = spark.createDataFrame(list(model.ids.items()), "token string, id int")
    tables = {"token_lengths": metrics.token_lengths(vocab), "length_figures": metrics.length_figures(vocab), "merge_frequencies": V.merge_table(spark, model.merges)}
    if a.corpus:
        tables["zipf"] = metrics.zipf(V.word_counts(text_files.read_corpus(spark, a.corpus), "line", model.digit_mode, "\n"))
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{a.output_dir}/{name}")
    return {"tables": sorted(tables)}


@_command(("--config", {"required": True}), _CORPUS, ("--runs-dir", {"default": "runs"}), ("--max-lines", {"type": int}))
def run_experiment(spark, a):
    """A recipe: one training, and a run for each of its vocabulary sizes."""
    recipe = configs.read_config(spark, a.config)
    sizes = recipe.get("vocab_sizes") or [recipe.get("vocab_size", 32_000)]
    largest = pipelines.train_on_files(spark, a.corpus or recipe["corpus"], max(sizes), recipe.get("min_frequency", 2), recipe.get("digit_mode", "clustered"), a.max_lines)
    runs = []
    for size, model in zip(sorted(sizes), pipelines.sweep(largest, sizes), strict=True):
        run_id = pipelines.start_run(spark, a.runs_dir, f"{recipe.get('name', 'experiment')}_{size}", recipe)
        pipelines.save_run(spark, a.runs_dir, run_id, _figures(spark, model, recipe.get("eval_corpus"), run_id), model)
        runs.append(run_id)
    return {"runs": runs}


@_command(("--runs-dir", {"required": True}), ("--base-dir", {}), _OUTPUT)
def compare_runs(spark, a):
    """Rebuilds the leaderboard and prints it as Markdown."""
    text = pipelines.leaderboard_markdown(pipelines.rebuild_leaderboard(spark, a.runs_dir, a.base_dir))
    if a.output:
        write_text(spark, a.output, text)
    print(text)
    return {"table": text}


@_command(_MODEL, ("--repo-id", {"required": True}), ("--package-dir", {}), ("--dry-run", {"action": "store_true"}))
def push_to_hub(spark, a):
    """Stages the package of a model; nothing is uploaded."""
    missing = pipelines.complete_artifacts(spark, a.model)
    model = model_files.load_model(a.model, spark)
    if a.dry_run or not a.package_dir:
        return _shown({"repo_id": a.repo_id, "completed": missing, "files": model_files.staged(model, a.repo_id, {})}, spark, None)
    return _shown({"repo_id": a.repo_id, "completed": missing, "files": model_files.export_package(model, a.package_dir, a.repo_id, {}, spark)}, spark, None)


@_command(_MODEL, ("--text", {"required": True}), ("--dropout", {"type": float, "default": 0.0}))
def interactive(spark, a):
    """What a text's tokens are: place, id, display text, bytes (one text instead of a prompt)."""
    model = model_files.load_model(a.model, spark)
    docs = spark.createDataFrame([(1, a.text)], "doc_id long, text string")
    ids = codec.encode_dropout(docs, model, a.dropout) if a.dropout else codec.encode(docs, model, allowed="all")
    rows = codec.inspected(codec.tokens_of(ids, spark.createDataFrame(list(model.ids.items()), "token string, id int"))).orderBy("pos").collect()
    return _shown({"n_tokens": ids.select(F.size("ids")).first()[0], "tokens": [r.asDict() for r in rows]}, spark, None)


@_command(_MODEL, _OUTPUT)
def test_real_world(spark, a):
    """The suite of hard strings."""
    return _shown(robustness.stress_summary(robustness.stress_suite(spark, model_files.load_model(a.model, spark))).first().asDict(), spark, a.output)


@_command(_MODEL, ("--corpus", {"required": True}), ("--repeats", {"type": int, "default": 3}))
def benchmark_inference(spark, a):
    """MB and tokens encoded and decoded a second."""
    return _shown(pipelines.throughput(_lines(spark, a.corpus), model_files.load_model(a.model, spark), repeats=a.repeats), spark, None)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="corpusmill", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        one = sub.add_parser(name, help=f.__doc__)
        for option, settings in options:
            one.add_argument(option, **settings)
    a = parser.parse_args(argv)
    return COMMANDS[a.command][0](spark or local_session(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
