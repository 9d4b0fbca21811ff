"""Configurations as YAML or JSON (by file name), in any store that Spark reads, and what a mix configuration says."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..session import read_text, write_text


def _is_yaml(path: str) -> bool:
    return path.lower().endswith((".yaml", ".yml"))


def read_config(spark: SparkSession, path: str) -> dict:
    text = read_text(spark, path)
    if not _is_yaml(path):
        return json.loads(text)
    import yaml  # only YAML needs it

    return yaml.safe_load(text) or {}


def write_config(spark: SparkSession, value: dict, path: str) -> None:
    if _is_yaml(path):
        import yaml

        write_text(spark, path, yaml.safe_dump(value, sort_keys=False, allow_unicode=True))
    else:
        write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2))


def mix_sources(spark: SparkSession, config: dict) -> DataFrame:
    """(source, enabled, target_mb, text_column, dataset) of a mix configuration; sources are enabled and read `text` unless they say otherwise."""
    rows = []
    for name, s in (config.get("sources") or {}).items():
        if float(s["target_mb"]) <= 0:
            raise ValueError(f"the target of {name} must be positive")
        rows.append((name, bool(s.get("enabled", True)), float(s["target_mb"]), s.get("text_column", "text"), s.get("hf_dataset") or s.get("dataset") or s.get("path")))
    return spark.createDataFrame(rows, "source string, enabled boolean, target_mb double, text_column string, dataset string")


def check_total(config: dict, tolerance: float = 0.5) -> None:
    """Raises unless the enabled targets add up to the corpus's total."""
    total = float(config["corpus"]["total_target_mb"])
    given = sum(float(s["target_mb"]) for s in config["sources"].values() if s.get("enabled", True))
    if abs(given - total) > tolerance:
        raise ValueError(f"enabled sources add up to {given} MB, not to {total}")
