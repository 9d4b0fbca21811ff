"""Incremental decoding: token ids arrive one by one, text leaves as soon as its bytes are whole.

State per stream is the bytes still held back. The same rules run in a plain object and as a Structured
Streaming operator (`applyInPandasWithState`).
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.codec import Model


def held_back(data: bytes) -> int:
    """How many bytes at the end begin a character that is not whole yet."""
    for n in range(1, min(4, len(data)) + 1):
        b = data[-n]
        if b & 0xC0 != 0x80:
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            return n if need > n else 0
    return 0


class TextDecoder:
    """feed() returns the text that became whole, flush() the rest. Unknown ids add nothing; bytes that can
    no longer become a character are dropped while feeding and replaced by U+FFFD when flushing."""

    def __init__(self, model: Model, pending: bytes = b""):
        self.model, self.pending = model, bytes(pending)

    def feed(self, token_id: int) -> str:
        if not 0 <= token_id < len(self.model.tokens) or self.model.tokens[token_id] is None:
            return ""
        token = self.model.tokens[token_id]
        if token in self.model.specials:
            return self.flush() + token
        data = self.pending + bytes(self.model.raw[c] for c in token)
        cut = len(data) - held_back(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "ignore")

    def flush(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


def decode_stream(tokens: DataFrame, model: Model) -> DataFrame:
    """(stream_id, pos, text) increments, pos that of the first token in them, of a streaming DataFrame (stream_id long, pos long, token_id int, last boolean).

    Tokens of a stream are taken in the order of pos within a micro-batch; `last` flushes and ends it.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(key, frames, state: GroupState):
        decoder = TextDecoder(shared.value, state.get[0] if state.exists else b"")
        out, ended = [], False
        rows = pd.concat(list(frames)).sort_values("pos")
        for row in rows.itertuples():
            out.append(decoder.feed(int(row.token_id)))
            if row.last:
                out.append(decoder.flush())
                ended = True
        if ended:
            state.remove()
        else:
            state.update((decoder.pending,))
        yield pd.DataFrame({"stream_id": [key[0]], "pos": [rows["pos"].iloc[0]], "text": ["".join(out)]})

    return tokens.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, pos long, text string", "pending binary", "append", GroupStateTimeout.NoTimeout)


def quota_stream(docs: DataFrame, quota_bytes: int) -> DataFrame:
    """A stream's documents (source, doc_id, text) until each source has passed its byte quota; the one that
    passes it is still let through. State per source is the number of bytes so far.

    Of a batch of rows, those go before the shuffle that have the whole quota before them in the batch alone: what
    stays of it fills the quota, so nothing behind can pass. So texts of a large source do not meet in one task.
    """

    def ahead(batches):
        for batch in batches:
            rows = batch.select(["source", "doc_id", "size"]).to_pandas().sort_values("doc_id", kind="stable")
            before = rows.groupby("source", dropna=False)["size"].cumsum() - rows["size"]
            yield batch.filter(pa.array((before < quota_bytes).sort_index().to_numpy()))

    def run(key, frames, state: GroupState):
        total = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("doc_id", kind="stable").reset_index(drop=True)
        kept = rows[total + rows["size"].cumsum() - rows["size"] < quota_bytes]
        state.update((int(total + kept["size"].sum()),))
        yield kept[["source", "doc_id", "text"]]

    sized = docs.select("source", "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    passed = sized.mapInArrow(ahead, "source string, doc_id long, text string, size long")
    return passed.groupBy("source").applyInPandasWithState(run, "source string, doc_id long, text string", "total long", "append", GroupStateTimeout.NoTimeout)


def run_in_batches(parts: list[DataFrame], folder: str, apply) -> str:
    """Streams the parts one after the other, each as one micro-batch of as many files as it has partitions; state goes on
    from one to the next. apply: a streaming DataFrame to the stream that is written; returns the folder of its rows."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = part.sparkSession.readStream.schema(part.schema).parquet(f"{folder}/in")
        run = apply(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return f"{folder}/out"
