"""Tokenizers of other libraries behind the same measures: a pair of functions, made anew in every task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Pair = tuple[Callable[[str], list[int]], Callable[[list[int]], str]]


class External:
    """name, vocabulary size, and `open`: a function without arguments that gives (encode, decode) inside a task."""

    def __init__(self, name: str, vocab_size: int, open: Callable[[], Pair], unk_id: int = -1):
        self.name, self.vocab_size, self.open, self.unk_id = name, vocab_size, open, unk_id


def from_tokenizer_json(path: str, name: str | None = None) -> External:
    """A tokenizer.json of the tokenizers library, from the driver's disk."""
    with open(path, encoding="utf-8") as f:
        return from_tokenizer_text(f.read(), name or path.rsplit("/", 1)[-1])


def from_tokenizer_text(spec: str, name: str) -> External:
    """The same from the file's text, which goes to the tasks."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)

    def start() -> Pair:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(spec)
        return lambda text: t.encode(text, add_special_tokens=False).ids, lambda ids: t.decode(ids, skip_special_tokens=False)

    return External(name, tokenizer.get_vocab_size(), start)


def from_tiktoken(path: str, pattern: str = T.CLUSTERED, name: str | None = None, specials: dict[str, int] | None = None) -> External:
    """A file of base-64 tokens and ranks, as the tiktoken library reads it."""
    import base64

    with open(path, encoding="ascii") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    label = name or path.rsplit("/", 1)[-1]

    def start() -> Pair:
        import tiktoken

        t = tiktoken.Encoding(label, pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials or {})
        return lambda text: t.encode(text, allowed_special="all"), t.decode

    return External(label, len(ranks) + len(specials or {}), start)


def measure(docs: DataFrame, tokenizer: External, keep: list[str], text_col: str = "text") -> DataFrame:
    """As `codec.measure`, by another library: `keep` columns, n_bytes, n_chars, n_words, n_tokens, n_unk, is_lossless, used."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [*keep, "n_bytes", "n_chars", "n_words"]
    rows = docs.select(*keep, T.byte_length(text).alias("n_bytes"), F.length(text).cast("long").alias("n_chars"), T.word_count(text).alias("n_words"), text.alias("text__"))

    def run(batches):
        encode, decode = tokenizer.open()
        for batch in batches:
            texts = batch.column("text__").to_pylist()
            ids = [encode(t) for t in texts]
            same = [decode(i) == t for i, t in zip(ids, texts, strict=True)]
            unknown = [sum(x == tokenizer.unk_id for x in i) for i in ids]
            used = pa.array([np.unique(np.array(i, dtype=np.int32)) for i in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([len(i) for i in ids], pa.int64()), pa.array(unknown, pa.int64()), pa.array(same, pa.bool_()), used], names=[*names, "n_tokens", "n_unk", "is_lossless", "used"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, n_unk long, is_lossless boolean, used array<int>")
