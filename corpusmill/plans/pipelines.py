"""Whole procedures: building a corpus, training and sweeping vocabularies, evaluating, tracking runs."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import codec, corpus, external, metrics
from ..operators import vocabulary as V
from ..operators.codec import Model
from ..session import file_names, materialize, read_text, write_text
from ..sources import model_files, text_files
from . import config as configs


def _placed(cleaned: DataFrame, split: DataFrame, seed: int) -> DataFrame:
    """The texts of the documents that a split keeps (source, doc_id, split, stored, clean, key)."""
    kept = split.select(F.col("source").alias("of"), F.col("doc_id").alias("id"), "split", "stored")
    found = cleaned.join(kept, F.col("source").eqNullSafe(F.col("of")) & (F.col("doc_id") == F.col("id"))).drop("of", "id")
    return found.withColumn("key", corpus.seeded_key(seed=seed))


def build_corpus(docs: DataFrame, train_bytes: int, eval_bytes: int, min_chars: int = 50, seed: int = 42) -> DataFrame:
    """Cleaned documents with split and shuffled key: each source gives its held-out share first. Quotas are summed
    over ids and sizes; the texts join what was chosen. Ids must be unique within a source."""
    found = corpus.cleaned(docs, min_chars=min_chars).select("doc_id", "source", "clean")
    quota = corpus.byte_quota(found, train_bytes + eval_bytes)
    return _placed(found, corpus.split_held_out(quota, train_bytes, eval_bytes), seed)


def build_mix(docs: DataFrame, config: dict, min_chars: int = 50) -> DataFrame:
    """The same by a mix configuration: enabled sources only, each with its target and its part of the held-out share."""
    about = config["corpus"]
    shares = corpus.mix_shares(configs.mix_sources(docs.sparkSession, config), about["total_target_mb"], about["eval_target_mb"])
    found = corpus.cleaned(docs, min_chars=min_chars).select("doc_id", "source", "clean")
    return _placed(found, corpus.split_by_shares(found, shares), int(about.get("seed", 42)))


def read_mix(spark: SparkSession, config: dict, locate, fmt: str = "parquet") -> DataFrame:
    """(source, doc_id, text) of all enabled sources, concatenated; locate(name, settings) gives a source's path."""
    rows = None
    for name, s in config["sources"].items():
        if s.get("enabled", True):
            one = text_files.read_source(spark, locate(name, s), s.get("text_column", "text"), fmt, name)
            one = one.withColumn("doc_id", F.monotonically_increasing_id())
            rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no source is enabled")
    return rows


def manifest_of(splits: DataFrame, config: dict | None = None, digests: dict[str, str] | None = None) -> dict:
    """What a built corpus holds: name, seed, documents and bytes by split and by source, digests if given."""
    rows = [r.asDict() for r in corpus.manifest(splits).orderBy("source", "split").collect()]  # two per source
    about, sources = (config or {}).get("corpus", {}), (config or {}).get("sources", {})
    found: dict = {"corpus_name": about.get("name"), "seed": about.get("seed", 42)}
    for split in ("train", "eval"):
        own = [r for r in rows if r["split"] == split]
        size = sum(r["n_bytes"] for r in own)
        found |= {f"{split}_size_bytes": size, f"{split}_size_readable": T.shown_bytes(size), f"{split}_doc_count": sum(r["n_docs"] for r in own), f"{split}_sha256": (digests or {}).get(split)}
    found["sources"] = {}
    for r in rows:
        one = found["sources"].setdefault(r["source"], {"dataset": (sources.get(r["source"]) or {}).get("hf_dataset"), "train_docs": 0, "train_bytes": 0, "eval_docs": 0, "eval_bytes": 0})
        one |= {f"{r['split']}_docs": r["n_docs"], f"{r['split']}_bytes": r["n_bytes"]}
    return found | {"total_bytes": found["train_size_bytes"] + found["eval_size_bytes"], "total_docs": found["train_doc_count"] + found["eval_doc_count"]}


def write_manifest(splits: DataFrame, path: str, config: dict | None = None, digests: dict[str, str] | None = None) -> dict:
    """Writes the corpus files' manifest as JSON."""
    found = manifest_of(splits, config, digests)
    write_text(splits.sparkSession, path, json.dumps(found, indent=2))
    return found


def train_model(docs: DataFrame, vocab_size: int, min_frequency: int = 2, text_col: str = "clean", specials: list[str] | None = None, digit_mode: str = "clustered") -> Model:
    return Model(V.train(V.word_counts(docs, text_col, digit_mode), vocab_size, min_frequency, specials), specials, None, digit_mode)


def train_on_files(spark: SparkSession, path: str, vocab_size: int, min_frequency: int = 2, digit_mode: str = "clustered", max_lines: int | None = None) -> Model:
    """A model of corpus text files, read line by line (optionally the first lines)."""
    words = V.word_counts(text_files.read_corpus(spark, path, max_lines), "line", digit_mode, "\n")
    return Model(V.train(words, vocab_size, min_frequency), None, None, digit_mode)


def figures(model: Model, report: DataFrame, name: str) -> dict:
    """What a run's metrics.json holds, from a report with an `overall` row (a row per domain)."""
    rows = [r.asDict() for r in report.collect()]
    keep = ("n_bytes", "n_words", "compression_ratio", "fertility", "unk_percent", "used_percent", "all_lossless")
    one = lambda r: {k: r[k] for k in keep} | {"total_tokens": r["n_tokens"]}
    overall = next((one(r) for r in rows if r["domain"] == "overall"), {})
    return {"model_name": name, "vocab_size": len(model.ids), "overall": overall, "domains": {r["domain"]: one(r) for r in rows if r["domain"] != "overall"}}


def sweep(model: Model, sizes: list[int]) -> list[Model]:
    """Smaller vocabularies are prefixes of the largest: train once, cut as often as needed."""
    return [model.prefix(max(0, size - 256 - len(model.specials))) for size in sorted(sizes)]


def evaluate(docs: DataFrame, model: Model | external.External, by: list[str], text_col: str = "text", overall: str | None = None) -> DataFrame:
    """All metrics by domain, of a model or of another library's tokenizer; one pass over the texts."""
    if isinstance(model, external.External):
        return metrics.domain_report(external.measure(docs, model, by, text_col), by, model.vocab_size, overall)
    return metrics.domain_report(codec.measure(docs, model, by, text_col, "all"), by, len(model.ids), overall)


def throughput(docs: DataFrame, model: Model, text_col: str = "text", repeats: int = 3) -> dict[str, float]:
    """MB and tokens encoded and decoded a second: one run to warm up, then the mean of `repeats`."""
    rows = materialize(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")))
    size = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 1e6
    encoded = materialize(codec.encode(rows, model, allowed="all"))
    tokens = encoded.agg(F.sum(F.size("ids"))).first()[0] or 0

    def seconds(df: DataFrame) -> float:
        took = []
        for _ in range(1 + repeats):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return sum(took[1:]) / repeats

    one, two = seconds(codec.encode(rows, model, allowed="all")), seconds(codec.decode(encoded, model))
    return {"encode_mb_s": size / one, "encode_tokens_s": tokens / one, "decode_mb_s": size / two, "decode_tokens_s": tokens / two}


# --- runs ----------------------------------------------------------------------------------------------------


def start_run(spark: SparkSession, folder: str, name: str, settings: dict | None = None, now: str | None = None) -> str:
    """The id of a new run, time stamp and name; its settings are kept in its folder."""
    stamp = now or time.strftime("%Y%m%d_%H%M%S")
    run_id = f"{stamp}_{name.strip().replace(' ', '_').replace('/', '_').lower()}"
    if settings:
        configs.write_config(spark, settings, f"{folder}/{run_id}/config.json")
    return run_id


def save_run(spark: SparkSession, folder: str, run_id: str, figures: dict, model: Model | None = None, results: dict | None = None) -> None:
    """A run's artifacts: metrics.json, lm_eval.json if there are results of a language model, the model if given."""
    write_text(spark, f"{folder}/{run_id}/metrics.json", json.dumps(figures))
    if results is not None:
        write_text(spark, f"{folder}/{run_id}/lm_eval.json", json.dumps(results))
    if model is not None:
        model_files.save_model(model, f"{folder}/{run_id}", spark=spark)


_RUN = "model_name string, vocab_size long, overall struct<total_tokens: long, compression_ratio: double, fertility: double>, domains map<string, struct<compression_ratio: double>>"
_LM = "val_loss_per_token double, val_bits_per_character double, val_perplexity double"


def read_runs(spark: SparkSession, folder: str, base: str | None = None) -> DataFrame:
    """(run_id, seq, model_name, vocab_size, total_tokens, overall_cr, fertility, val_bpc, val_loss, domains): a row per
    run folder with a metrics.json, named by the folder, its language-model figures if any; then the
    reference_*.json files in `base`, named by the file. seq is the order in which they enter the leaderboard."""

    def rows(glob: str, schema: str, name) -> DataFrame:
        return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("run_id", name)

    path = F.col("_metadata.file_path")
    own = [n for n in file_names(spark, folder) if "metrics.json" in file_names(spark, f"{folder}/{n}")]
    with_lm = any("lm_eval.json" in file_names(spark, f"{folder}/{n}") for n in own)
    in_folder = F.element_at(F.split(path, "/"), -2)
    runs = rows(f"{folder}/*/metrics.json", _RUN, in_folder) if own else spark.createDataFrame([], _RUN + ", run_id string")
    runs = runs.withColumn("kind", F.lit(0))
    if base and any(n.startswith("reference_") and n.endswith(".json") for n in file_names(spark, base)):
        runs = runs.unionByName(rows(f"{base}/reference_*.json", _RUN, F.regexp_extract(path, r"([^/]+)\.json$", 1)).withColumn("kind", F.lit(1)))
    results = rows(f"{folder}/*/lm_eval.json", _LM, in_folder) if with_lm else spark.createDataFrame([], _LM + ", run_id string")
    joined = metrics.with_results(runs, results)
    return joined.select("run_id", F.struct("kind", "run_id").alias("seq"), F.coalesce("model_name", "run_id").alias("model_name"), "vocab_size", "overall.total_tokens", F.col("overall.compression_ratio").alias("overall_cr"), "overall.fertility", F.round("val_bits_per_character", 3).alias("val_bpc"), F.round("val_loss_per_token", 3).alias("val_loss"), "domains")


def rebuild_leaderboard(spark: SparkSession, folder: str, base: str | None = None) -> DataFrame:
    """The leaderboard of all runs below a folder and of the reference files beside it."""
    return metrics.leaderboard(read_runs(spark, folder, base))


def leaderboard_markdown(board: DataFrame) -> str:
    """A table; what a run does not have is a dash."""
    columns = [c for c in ("run_id", "vocab_size", "total_tokens", "overall_cr", "fertility", "val_bpc") if c in board.columns]
    rows = board.orderBy("position").select("position", *columns).collect()  # a row per run
    lines = "\n".join("| " + " | ".join("-" if v is None else str(v) for v in r) + " |" for r in rows)
    return "| # | " + " | ".join(columns) + " |\n|" + "---|" * (len(columns) + 1) + f"\n{lines}\n"


def resolve_run(board: DataFrame, name: str) -> DataFrame:
    """The run `best`, or of that name, or the only one whose name holds it (any case); several raise an error."""
    if name.strip().lower() == "best":
        return metrics.best_run(board)
    exact = board.where(F.col("run_id") == name)
    if not exact.isEmpty():
        return exact
    found = board.where(F.lower("run_id").contains(name.lower()))
    several = [r["run_id"] for r in found.select("run_id").limit(5).collect()]
    if len(several) > 1:
        raise ValueError(f"{name} could be any of {several}")
    return found


def complete_artifacts(spark: SparkSession, folder: str) -> list[str]:
    """Writes what a model folder lacks of its files, from vocab.json and merges.txt; returns what was missing."""
    missing = [f for f in model_files.FILES if f not in file_names(spark, folder)]
    if missing:
        model_files.save_model(model_files.load_model(folder, spark=spark), folder, spark=spark)
    return missing


__all__ = ["build_corpus", "build_mix", "complete_artifacts", "evaluate", "figures", "leaderboard_markdown", "manifest_of", "read_mix", "read_runs", "read_text", "rebuild_leaderboard", "resolve_run", "save_run", "start_run", "sweep", "throughput", "train_model", "train_on_files", "write_manifest"]
