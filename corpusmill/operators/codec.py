"""Encoding and decoding with a learned vocabulary.

Texts are cut into words natively; one Arrow pass then merges each distinct word of a batch once, remembers
words within the task, and gathers the ids of all occurrences at once. Nothing is shuffled, so frequent
words are no hot keys. The model travels as one broadcast; its size is the vocabulary's, not the corpus's.
"""

from __future__ import annotations

import heapq
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import vocabulary as V

#: Words remembered in a task; beyond it the memory starts anew.
MEMORY = 500_000
#: Words (or ids) of a batch that are worked on at a time; a batch has 10,000 texts, which can be long.
PART = 1 << 17
#: Words of more symbols are merged with a heap, shorter ones by looking at all pairs each time.
SHORT = 48


def parts(batches, column: int | str):
    """The batches in slices of rows that have `PART` list elements in the column at most, or are one row."""
    for batch in batches:
        upto = batch.column(column).offsets.to_numpy()
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + PART, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


class Model:
    """Merges in rank order and the special tokens; ids follow vocabulary_tokens, or a vocabulary that is given."""

    def __init__(self, merges: list[tuple[str, str, int]], specials: list[str] | None = None, vocab: dict[str, int] | None = None, digit_mode: str = "clustered", pattern: str | None = None):
        self.merges = list(merges)
        self.specials = list(V.SPECIAL_TOKENS if specials is None else specials)
        self.digit_mode, self.pattern = digit_mode, pattern
        self.letters = T.byte_alphabet()
        self.raw = {c: b for b, c in enumerate(self.letters)}
        self.ids = dict(vocab) if vocab is not None else {t: i for i, t in enumerate(V.vocabulary_tokens(self.merges, self.specials))}
        self.tokens: list[str | None] = [None] * (max(self.ids.values(), default=-1) + 1)  # None: an id that is not used
        for t, i in self.ids.items():
            self.tokens[i] = t
        if lost := [t for t in [*self.letters, *self.specials] if t not in self.ids]:
            raise ValueError(f"the vocabulary lacks {lost[:5]}")
        self.first = [self.ids[c] for c in self.letters]
        self.joins: dict[tuple[int, int], tuple[int, int]] = {}  # pair of ids -> rank, id of the joined token
        for rank, (left, right, _) in enumerate(self.merges):
            self.joins.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))

    def prefix(self, merges: int) -> Model:
        """The model that training for fewer merges would give."""
        return Model(self.merges[:merges], self.specials, None, self.digit_mode, self.pattern)

    def encode_word(self, word: str, dropout: float = 0.0, rng: random.Random | None = None) -> list[int]:
        """Ids of a word: the pair of lowest rank is joined everywhere, again and again. With dropout, ranked
        candidates are passed over with that probability; if all are, merging ends."""
        s = [self.first[b] for b in word.encode("utf-8", "replace")]
        if len(s) > SHORT and not dropout:
            return self._merge_long(s)
        joins = self.joins
        while len(s) > 1:
            ranked = {(*joins[p], p) for p in zip(s, s[1:]) if p in joins}
            if dropout:
                chosen = next((x for x in sorted(ranked) if rng.random() >= dropout), None)
            else:
                chosen = min(ranked, default=None)
            if chosen is None:
                break
            _, made, pair = chosen
            out, k = [], 0
            while k < len(s):
                hit = k + 1 < len(s) and (s[k], s[k + 1]) == pair
                out.append(made if hit else s[k])
                k += 1 + hit
            s = out
        return s

    def _merge_long(self, s: list[int]) -> list[int]:
        """The same for long words: a heap of places by rank, over a chain of the symbols that are left."""
        n, joins = len(s), self.joins
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(joins[p][0], k) for k, p in enumerate(zip(s, s[1:])) if p in joins]
        heapq.heapify(heap)
        while heap:
            rank, fresh = heap[0][0], set()
            while heap and heap[0][0] == rank:  # a rank's places from left to right; what they make waits
                _, k = heapq.heappop(heap)
                to = after[k]
                if s[k] < 0 or to < 0 or joins.get((s[k], s[to]), (-1,))[0] != rank or k in fresh or to in fresh:
                    continue
                s[k], s[to] = joins[s[k], s[to]][1], -1
                after[k] = after[to]
                if after[to] >= 0:
                    before[after[to]] = k
                fresh.add(k)
            for k in fresh:
                for a, b in ((before[k], k), (k, after[k])):
                    if a >= 0 and b >= 0 and (s[a], s[b]) in joins:
                        heapq.heappush(heap, (joins[s[a], s[b]][0], a))
        return [i for i in s if i >= 0]

    def bpe(self, word: str, dropout: float = 0.0, rng: random.Random | None = None) -> list[str]:
        """Symbols of a word."""
        return [self.tokens[i] for i in self.encode_word(word, dropout, rng)]

    def token(self, i: int) -> str:
        if not 0 <= i < len(self.tokens) or self.tokens[i] is None:
            raise ValueError(f"unknown token id {i}")
        return self.tokens[i]

    def decode(self, ids: list[int], errors: str = "replace", skip_special: bool = False) -> str:
        out, held = [], bytearray()
        special = set(self.specials)
        for i in ids:
            token = self.token(i)
            if token in special:
                out.append(held.decode("utf-8", errors))
                held.clear()
                out.append("" if skip_special else token)
            else:
                held.extend(self.raw[c] for c in token)
        return "".join([*out, held.decode("utf-8", errors)])

    def pieces(self) -> list[bytes]:
        """The bytes of each token."""
        special = set(self.specials)
        return [b"" if t is None else t.encode() if t in special else bytes(self.raw[c] for c in t) for t in self.tokens]


class Encoder:
    """A model at work in one task: remembers words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def words(self, words: list[str]) -> list[list[int]]:
        if len(self.known) > MEMORY:
            self.known.clear()
        out = []
        for w in words:
            if (ids := self.known.get(w)) is None:
                ids = self.known[w] = self.model.encode_word(w)
            out.append(ids)
        return out

    def lists(self, words: pa.ListArray, special: pa.ListArray | None = None) -> pa.ListArray:
        """Ids of each row of words; `special` marks words that are special tokens."""
        flat = words.flatten()
        coded = flat.dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        ids = self.words(kinds)
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if special is not None:
            marks = special.flatten().to_numpy(zero_copy_only=False)
            ids += [[self.model.ids.get(w, -1)] for w in kinds]
            which = np.where(marks, which + len(kinds), which)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        values = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        lens = sizes[which]
        upto = np.concatenate([[0], np.cumsum(lens)])
        at = np.arange(upto[-1]) - np.repeat(upto[:-1] - begin[which], lens)
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        return pa.ListArray.from_arrays(pa.array(upto[offsets].astype(np.int32)), pa.array(values[at]))


class Decoder:
    """A model at work in one task: token bytes as one table."""

    def __init__(self, model: Model, skip_special: bool = False):
        pieces = model.pieces()
        self.special = np.array([t in set(model.specials) for t in model.tokens], dtype=bool)
        if skip_special:
            pieces = [b"" if s else p for p, s in zip(pieces, self.special.tolist(), strict=True)]
            self.special[:] = False
        self.known = np.array([t is not None for t in model.tokens], dtype=bool)
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def lists(self, ids: pa.ListArray) -> list[str]:
        """The text of each row of ids; special tokens part what stands before and after them."""
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        bad = np.flatnonzero((flat < 0) | (flat >= len(self.sizes)) | ~self.known[np.clip(flat, 0, len(self.known) - 1)])
        if len(bad):
            raise ValueError(f"unknown token id {flat[bad[0]]}")
        lens = self.sizes[flat]
        upto = np.concatenate([[0], np.cumsum(lens)])
        data = self.bytes[np.arange(upto[-1]) - np.repeat(upto[:-1] - self.begin[flat], lens)].tobytes()
        rows = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        marks = np.flatnonzero(self.special[flat])
        lo, hi = np.searchsorted(marks, rows[:-1]), np.searchsorted(marks, rows[1:])
        ends, out = upto[rows].tolist(), []
        for k in range(len(rows) - 1):
            cuts = [ends[k], *(int(c) for m in marks[lo[k] : hi[k]] for c in (upto[m], upto[m + 1])), ends[k + 1]]
            out.append("".join(data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])))
        return out


def split_specials(text: Column, specials: list[str]) -> Column:
    """The text cut into special tokens and what lies between them."""
    if not specials:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
    either = "|".join(re.escape(s) for s in specials)
    return F.regexp_extract_all(text, F.lit(f"(?s)(?:{either})|(?:(?!{either}).)+"), F.lit(0))


def holds_banned(text: Column, specials: list[str], allowed: set[str] | str | None) -> Column:
    """Whether a text holds a special token that is not allowed (None: no token is; 'all': all are)."""
    banned = [] if allowed == "all" else [s for s in specials if s not in (allowed or set())]
    return text.rlike("|".join(re.escape(s) for s in banned)) if banned else F.lit(False)


def guard_specials(text: Column, specials: list[str], allowed: set[str] | str | None) -> Column:
    """The text, or an error if it holds a special token that is not allowed."""
    if allowed == "all" or not specials:
        return text
    return F.when(holds_banned(text, specials, allowed), F.raise_error(F.lit("text holds a special token that is not allowed"))).otherwise(text)


def word_lists(text: Column, model: Model, allowed: set[str] | str | None = None) -> tuple[Column, Column | None]:
    """(words of a text in order, which of them are special tokens: null if none can be)."""
    text = guard_specials(F.coalesce(text, F.lit("")), model.specials, allowed)
    chosen = model.specials if allowed == "all" else [s for s in model.specials if s in (allowed or set())]
    cut = lambda t: T.pre_tokenize(t, model.digit_mode, model.pattern)
    if not chosen:
        return cut(text), None
    known = F.array(*[F.lit(s) for s in chosen])
    parts = split_specials(text, chosen)
    words = F.flatten(F.transform(parts, lambda p: F.when(F.array_contains(known, p), F.array(p)).otherwise(cut(p))))
    marks = F.flatten(F.transform(parts, lambda p: F.when(F.array_contains(known, p), F.array(F.lit(True))).otherwise(F.transform(cut(p), lambda _: F.lit(False)))))
    return words, marks


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", allowed: set[str] | str | None = None) -> DataFrame:
    """(id_col, ids): each text's token ids; null and empty texts give an empty array. Rows keep their number."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    words, marks = word_lists(F.col(text_col), model, allowed)
    marked = marks is not None

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.lists(batch.column(1), batch.column(2) if marked else None)], names=[id_col, "ids"])

    rows = docs.select(F.col(id_col), words.alias("words"), *([] if not marked else [marks.alias("marks")]))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def tokenize(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", allowed: set[str] | str | None = None) -> DataFrame:
    """(id_col, tokens): each text's subwords, as vocabulary strings."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        tokens = pa.array(shared.value.tokens)
        for batch in parts(batches, 1):
            ids = batch.column(1)
            names = pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy() - ids.offsets[0].as_py(), pa.int32()), tokens.take(ids.flatten()))
            yield pa.RecordBatch.from_arrays([batch.column(0), names], names=[id_col, "tokens"])

    return encode(docs, model, id_col, text_col, allowed).mapInArrow(run, f"`{id_col}` {kind}, tokens array<string>")


def measure(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", allowed: set[str] | str | None = None) -> DataFrame:
    """`keep` columns and per text, in one pass: n_bytes, n_chars, n_words, n_tokens, n_unk, is_lossless and used
    (its distinct ids). Encodes and decodes; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    unk = model.ids.get("<|unk|>", -1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, marks = word_lists(F.col(text_col), model, allowed)
    marked = marks is not None
    counts = [T.byte_length(text).alias("n_bytes"), F.length(text).cast("long").alias("n_chars"), T.word_count(text).alias("n_words")]
    rows = docs.select(*keep, *counts, text.alias("text__"), words.alias("words__"), *([] if not marked else [marks.alias("marks__")]))
    names = [*keep, "n_bytes", "n_chars", "n_words"]

    def run(batches):
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in parts(batches, "words__"):
            ids = encoder.lists(batch.column("words__"), batch.column("marks__") if marked else None)
            same = [a == b for a, b in zip(decoder.lists(ids), batch.column("text__").to_pylist(), strict=True)]
            flat, rows_ = ids.flatten().to_numpy(), ids.offsets.to_numpy()
            lens = np.diff(rows_)
            unknown = np.concatenate([[0], np.cumsum(flat == unk)])[rows_]
            used = pa.array([np.unique(flat[a:b]) for a, b in zip(rows_[:-1], rows_[1:])], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lens.astype(np.int64)), pa.array(np.diff(unknown).astype(np.int64)), pa.array(same, pa.bool_()), used], names=[*names, "n_tokens", "n_unk", "is_lossless", "used"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, n_unk long, is_lossless boolean, used array<int>")


def encode_dropout(docs: DataFrame, model: Model, dropout: float, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) with BPE dropout per occurrence; the choice depends on seed, id and place alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            out = []
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rng = random.Random(f"{seed}-{key}")
                out.append([i for w in words for i in m.encode_word(w, dropout, rng)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=[id_col, "ids"])

    words = docs.select(F.col(id_col).cast("long").alias(id_col), T.pre_tokenize(F.coalesce(F.col(text_col), F.lit("")), model.digit_mode, model.pattern).alias("words"))
    return words.mapInArrow(run, f"{id_col} long, ids array<int>")


def tokens_of(encoded: DataFrame, vocab: DataFrame, id_col: str = "doc_id", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id_col, pos, id, token): a token per row; unknown ids raise an error. The vocabulary is broadcast up to `broadcast_rows`."""
    small = F.broadcast(vocab) if vocab.count() <= broadcast_rows else vocab
    rows = encoded.select(id_col, F.posexplode("ids").alias("pos", "id")).join(small, "id", "left")
    return rows.select(id_col, "pos", "id", F.coalesce("token", F.raise_error(F.concat(F.lit("unknown token id "), F.col("id").cast("string"))).cast("string")).alias("token"))


def inspected(tokens: DataFrame, first: int = 30) -> DataFrame:
    """Adds to rows of `tokens_of` what is shown of the first tokens: display text (space as a dot, line ends and
    tabs as signs), hex and number of the token's bytes."""
    raw = F.encode(F.translate(F.col("token"), *T.letter_tables()), "ISO-8859-1")
    shown = F.replace(F.replace(F.replace(F.col("token"), F.lit("\u0120"), F.lit("\u00b7")), F.lit("\n"), F.lit("\u23ce\n")), F.lit("\t"), F.lit("\u21e5\t"))
    return tokens.where(F.col("pos") < first).withColumns({"display": shown, "byte_hex": F.hex(raw), "n_bytes": F.octet_length(raw).cast("int")})


def decode(encoded: DataFrame, model: Model, id_col: str = "doc_id", skip_special: bool = False) -> DataFrame:
    """(id_col, text) of (id_col, ids), in one pass; bytes that are no UTF-8 become U+FFFD, unknown ids raise an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        decoder = Decoder(shared.value, skip_special)
        for batch in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoder.lists(batch.column(1)), pa.string())], names=[id_col, "text"])

    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return encoded.select(F.col(id_col), ids.alias("ids")).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")
