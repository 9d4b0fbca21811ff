"""Model folders: vocabulary, merges, special tokens, configuration, and a tokenizer.json for the tokenizers library.

File names, their keys and the first line of a merges file are fixed formats. With a session given, folders may
lie in any store that Spark reads; without one they are local.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions import text as T
from ..operators.codec import Model
from ..session import file_names, read_text, write_text

#: The first line of a merges file, which alone is passed over when reading; the files of a model;
#: names of the special tokens, in the order of our own.
HEADER = "#version: 0.2"
FILES = ["vocab.json", "merges.txt", "tokenizer.json", "tokenizer_config.json", "special_tokens_map.json"]
ROLES = ("eos_token", "pad_token", "unk_token", "bos_token", "sep_token")


class Folder:
    """Small text files below a path."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = str(path).rstrip("/"), spark

    def names(self) -> list[str]:
        if self.spark:
            return file_names(self.spark, self.path)
        return sorted(p.name for p in Path(self.path).iterdir()) if Path(self.path).is_dir() else []

    def read(self, name: str) -> str:
        return read_text(self.spark, f"{self.path}/{name}") if self.spark else (Path(self.path) / name).read_text(encoding="utf-8")

    def write(self, name: str, text: str) -> None:
        if self.spark:
            write_text(self.spark, f"{self.path}/{name}", text)
        else:
            Path(self.path).mkdir(parents=True, exist_ok=True)
            (Path(self.path) / name).write_text(text, encoding="utf-8")

    def dump(self, name: str, value) -> None:
        self.write(name, json.dumps(value, ensure_ascii=False, indent=2))

    def load(self, name: str, default=None):
        return json.loads(self.read(name)) if name in self.names() else default


def model_texts(model: Model) -> dict:
    """The model's files as values, by name."""
    pattern = model.pattern or (T.CLUSTERED if model.digit_mode == "clustered" else T.SINGLE)
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return {
        "vocab.json": model.ids,
        "merges.txt": "\n".join([HEADER, *(f"{a} {b}" for a, b, _ in model.merges)]) + "\n",
        "special_tokens_map.json": {"all": model.specials} | dict(zip(ROLES, model.specials)),
        "tokenizer_config.json": {"vocab_size": len(model.ids), "regex_pattern": model.pattern, "digit_mode": model.digit_mode, "merge_frequencies": [n for *_, n in model.merges]},
        "tokenizer.json": {
            "version": "1.0", "truncation": None, "padding": None, "normalizer": None, "post_processor": None,
            "added_tokens": [{"id": model.ids[s], "content": s, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for s in model.specials],
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "decoder": level,
            "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": model.ids, "merges": [[a, b] for a, b, _ in model.merges]},
        },
    }


def save_model(model: Model, folder: str, spark: SparkSession | None = None) -> list[str]:
    """Writes the model; returns the file names."""
    at = Folder(folder, spark)
    for name, value in model_texts(model).items():
        if isinstance(value, str):
            at.write(name, value)
        else:
            at.dump(name, value)
    return at.names()


def read_merges(text: str) -> list[tuple[str, str]]:
    """Pairs of a merges file; merges that begin with # are merges like any other."""
    lines = text.split("\n")
    return [(a, b) for a, b in (x.rstrip("\r").split(" ", 1) for x in lines[lines[0].startswith("#version") :] if x.strip())]


def load_model(folder: str, spark: SparkSession | None = None) -> Model:
    """Reads a model folder, ours or one with vocab.json and merges.txt at least.

    Ids are those of vocab.json. Special tokens are those listed under `all`, else all values of
    special_tokens_map.json, else the entries of the vocabulary that neither are letters nor come from a merge.
    """
    at = Folder(folder, spark)
    if lost := [n for n in FILES[:2] if n not in at.names()]:
        raise FileNotFoundError(f"{folder} lacks {lost}")
    vocab, pairs = at.load("vocab.json"), read_merges(at.read("merges.txt"))
    config, named = at.load("tokenizer_config.json", {}), at.load("special_tokens_map.json")
    if named is None:
        made = {a + b for a, b in pairs} | set(T.byte_alphabet())
        specials = [t for t in vocab if t not in made]
    else:
        listed = named.get("all") or [v for k, v in named.items() if k != "all"]
        flat = [x for v in listed for x in (v if isinstance(v, list) else [v])]
        specials = list(dict.fromkeys(x["content"] if isinstance(x, dict) else x for x in flat))
    if lost := [a + b for a, b in pairs if a + b not in vocab]:
        raise ValueError(f"vocab.json and merges.txt in {folder} do not agree: no id for {lost[:5]}")
    counts = config.get("merge_frequencies") or [0] * len(pairs)
    return Model([(a, b, n) for (a, b), n in zip(pairs, counts, strict=True)], present(specials, vocab), vocab, config.get("digit_mode") or "clustered", config.get("regex_pattern"))


def present(specials: list[str], vocab: dict[str, int]) -> list[str]:
    """The special tokens that the vocabulary has."""
    return [s for s in specials if s in vocab]


def model_card(model: Model, name: str, metrics: dict) -> str:
    """A Markdown card."""
    rows = "\n".join(f"| {k} | {v} |" for k, v in metrics.items())
    return f"# {name}\n\nByte-level BPE vocabulary with {len(model.ids)} tokens and {len(model.merges)} merges.\n\n| Metric | Value |\n|---|---|\n{rows}\n"


def staged(model: Model, name: str, metrics: dict) -> dict[str, int]:
    """A dry run: the files that a package would hold and their bytes."""
    sizes = {n: len((v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, indent=2)).encode()) for n, v in model_texts(model).items()}
    return dict(sorted((sizes | {"README.md": len(model_card(model, name, metrics).encode())}).items()))


def export_package(model: Model, folder: str, name: str, metrics: dict, spark: SparkSession | None = None, dry_run: bool = False) -> list[str]:
    """A package: the model's files and a card. Nothing is uploaded; a dry run writes nothing."""
    if dry_run:
        return list(staged(model, name, metrics))
    save_model(model, folder, spark)
    Folder(folder, spark).write("README.md", model_card(model, name, metrics))
    return Folder(folder, spark).names()
