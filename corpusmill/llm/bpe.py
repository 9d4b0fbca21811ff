"""Byte-pair encoding by prefix-sharing trie traversal, and decoding.

Distinct words are visited in the order of a depth-first walk over their trie (sorted, with the prefixes
shared with the word before kept on a stack). The state of a prefix is the last token of its encoding:
the one token that ends the prefix and can stand beside the last token of what precedes it. Shared
prefixes are thus encoded once, and a word's tokens are read back along the stack.

Two adjacent tokens can stand together if undoing their merges, latest first, never uncovers a merge
across their border that would have come earlier.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, tidy

#: Fixed value: the split pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK, LETTER, DIGIT, OTHER = range(4)
#: Words (and pairs of tokens) remembered in a task; beyond it the memory starts anew.
MEMORY = 300_000
#: Bytes of texts that are worked on at a time: more share more prefixes, but take more memory.
PART = 1 << 20


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def odd_letters(every: str) -> list[str]:
    """The letters and digits that the tokenizers library, whose Unicode tables are older, takes for symbols."""
    from tokenizers.pre_tokenizers import ByteLevel

    splitter = ByteLevel(add_prefix_space=False)
    late = [c for run in regex.findall(r"[\p{L}\p{N}]+", every) for c in run if unicodedata.category(c) == "Cn"]
    return [c for c in late if len(splitter.pre_tokenize_str("!" + c)) == 1]


@cache
def kinds() -> np.ndarray:
    """The kind of each code point, as `PATTERN` tells them apart."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, named in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(named, every):
            out[m.start() : m.end()] = kind
    out[[ord(c) for c in odd_letters(every)]] = OTHER
    return out


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level tokenizer.json (held on the driver, sent to tasks)."""

    def __init__(self, spec: dict):
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        if odd := [t["content"] for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]:
            raise ValueError(f"added tokens that take white space or stand alone are not supported: {odd[:5]}")
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {as_bytes(s): i for s, i in model["vocab"].items() if s not in self.added}
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        for content, i in self.added.items():
            self.pieces[i] = content.encode()
        self.rank: dict[int, int] = {}  # of the merge that joins left * size + right
        self.born = [-1] * size  # rank of the merge that makes a token
        self.halves: list[tuple[int, int]] = [(-1, -1)] * size
        for r, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = self.ids[as_bytes(left)], self.ids[as_bytes(right)]
            made = self.ids[self.pieces[a] + self.pieces[b]]
            self.rank.setdefault(a * size + b, r)
            if self.born[made] < 0:
                self.born[made], self.halves[made] = r, (a, b)
        self.made: Endings | None = None

    def endings(self) -> Endings:
        """Made where it is used first and kept as long as the vocabulary, in a worker thus from task to task."""
        self.made = self.made or Endings(self.ids, len(self.pieces))
        return self.made

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))


class Endings:
    """Which tokens end at a place of a word: an Aho-Corasick automaton over the tokens' bytes.

    `longest` is the longest token that ends where a state is reached, `shorter` the next one that ends with it.
    """

    def __init__(self, ids: dict[bytes, int], size: int):
        self.step: dict[int, int] = {}  # state << 8 | byte -> state
        self.longest, self.shorter = [-1], [-1] * size
        above, depth = [0], [0]  # of a state: the step to it
        for piece, token in ids.items():
            at = 0
            for k, byte in enumerate(piece):
                key = at << 8 | byte
                to = self.step.get(key)
                if to is None:
                    to = self.step[key] = len(self.longest)
                    self.longest.append(-1)
                    above.append(key)
                    depth.append(k + 1)
                at = to
            if at:
                self.longest[at] = token
        self.back = [0] * len(self.longest)  # the longest other state that ends a state
        for state in np.argsort(depth, kind="stable").tolist()[1:]:
            before, byte = above[state] >> 8, above[state] & 255
            to = self._step(self.back[before], byte) if before else 0
            self.back[state] = to
            if self.longest[state] >= 0:
                self.shorter[self.longest[state]] = self.longest[to]
            else:
                self.longest[state] = self.longest[to]
        self.moves = dict(self.step)  # and what was found by going back

    def _step(self, state: int, byte: int) -> int:
        while state and state << 8 | byte not in self.step:
            state = self.back[state]
        return self.step.get(state << 8 | byte, 0)

    def move(self, state: int, byte: int) -> int:
        if len(self.moves) > len(self.step) + MEMORY:
            self.moves.clear()
            self.moves.update(self.step)
        to = self.moves[state << 8 | byte] = self._step(state, byte)
        return to


class Codec:
    """Encodes and decodes within one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.size = len(vocabulary.pieces)
        self.beside: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True)))) if vocabulary.added else None
        self.added = {content.encode(): i for content, i in vocabulary.added.items()}
        self.sizes = [len(p) for p in vocabulary.pieces]
        self.lengths = np.array(self.sizes, dtype=np.int64)
        self.flat = np.frombuffer(b"".join(vocabulary.pieces), dtype=np.uint8)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.decimals = [b"%d" % i for i in range(self.size)]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.tokens = np.zeros(0, dtype=np.int32)  # of all known words, one after the other
        self.upto = np.zeros(1, dtype=np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether token a may be followed by token b in one word's encoding."""
        key = a * self.size + b
        found = self.beside.get(key)
        if found is None:
            if len(self.beside) > MEMORY:
                self.beside.clear()
            found = self.beside[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        born, halves, rank = self.v.born, self.v.halves, self.v.rank
        before = len(rank) + 1  # merges across the border count if their rank is under this
        while True:
            if rank.get(a * self.size + b, before) < before:
                return False
            if born[a] < 0 and born[b] < 0:
                return True
            if born[a] > born[b]:  # the left one was made last; of equal ranks the leftmost goes first
                before = min(before, born[a])
                a = halves[a][1]
            else:
                before = min(before, born[b] + 1)
                b = halves[b][0]

    def _stands_alone(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as this one token."""
        found = self.whole.get(token)
        if found is None:
            a, b = self.v.halves[token]
            found = self.whole[token] = a < 0 or (self._stands_alone(a) and self._stands_alone(b) and self._joins(a, b))
        return found

    def _joins(self, a: int, b: int) -> bool:
        """Whether a and b, undisturbed until their own merge, meet at their border."""
        born, halves, rank = self.v.born, self.v.halves, self.v.rank
        before = rank[a * self.size + b] + 1
        while born[a] >= 0 or born[b] >= 0:
            if max(born[a], born[b]) >= before:
                return False
            if born[a] > born[b]:
                before, a = born[a], halves[a][1]
            else:
                before, b = born[b] + 1, halves[b][0]
            if rank.get(a * self.size + b, before) < before:
                return False
        return True

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Tokens of distinct words."""
        ends, lens = self.v.endings(), self.sizes
        moves, longest, shorter = ends.moves, ends.longest, ends.shorter
        if len(self.beside) > MEMORY:
            self.beside.clear()
        beside, size, slow = self.beside, self.size, self._compatible
        out: dict[bytes, list[int]] = {}
        last: list[int] = [-1]  # by prefix length
        states: list[int] = [0]
        before = b""
        for word in sorted(words):
            n = len(word)
            shared, most = 0, min(n, len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state = states[shared]
            for end in range(shared + 1, n + 1):
                to = moves.get(state << 8 | word[end - 1])
                state = ends.move(state, word[end - 1]) if to is None else to
                token = longest[state]
                while token >= 0:
                    begin = end - lens[token]
                    if begin:
                        key = last[begin] * size + token
                        good = beside.get(key)
                        if good is None:
                            good = beside[key] = slow(last[begin], token)
                    else:
                        good = self._stands_alone(token)
                    if good:
                        break
                    token = shorter[token]
                else:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(token)
                states.append(state)
            tokens, end = [], n
            while end:
                tokens.append(last[end])
                end -= lens[last[end]]
            out[word] = tokens[::-1]
            before = word
        return out

    def _pieces(self, texts: list[str]) -> tuple[list[str], list[int], list[int]]:
        """(texts cut at added tokens, which of the pieces are added tokens, number of pieces of each text)."""
        if self.special is None:
            return texts, [], [1] * len(texts)
        pieces, special, counts = [], [], []
        for text in texts:
            at, n = 0, len(pieces)
            for m in self.special.finditer(text):
                if at < m.start():
                    pieces.append(text[at : m.start()])
                special.append(len(pieces))
                pieces.append(m.group())
                at = m.end()
            if at < len(text):
                pieces.append(text[at:])
            counts.append(len(pieces) - n)
        return pieces, special, counts

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(the words of all texts one after the other, in UTF-8, where those of each text end).

        They are what `PATTERN` finds, an added token being one word: runs of letters, digits, blanks and others, of
        which the first three take a space before them and a run of blanks gives its last one away.
        """
        pieces, special, counts = self._pieces(texts)
        whole = "".join(pieces)
        points = np.frombuffer(whole.encode("utf-32-le", "replace"), dtype="<u4")
        data = whole.encode("utf-8", "replace")
        n, sizes = len(points), [len(p) for p in pieces]
        begin = np.cumsum([0, *sizes])
        kind = kinds()[points]
        first = np.zeros(n + 3, dtype=bool)  # of a piece; three more, so that looking ahead stays inside
        first[begin] = True
        first[n:] = True
        starts = first.copy()
        starts[1:n] |= kind[1:] != kind[:-1]
        follow = np.flatnonzero(starts[1:n] & ~first[1:n] & (kind[1:] != BLANK) & (kind[:-1] == BLANK)) + 1
        starts[follow - 1] = True
        starts[follow[points[follow - 1] == 0x20]] = False
        quote = np.flatnonzero(starts[:n] & (points == 0x27))
        quote = quote[~first[quote + 1]]
        near, far = points[quote + 1], points[np.minimum(quote + 2, n - 1)]
        double = ((near == ord("r")) | (near == ord("v"))) & (far == ord("e")) | (near == ord("l")) & (far == ord("l"))
        double &= ~first[quote + 2]
        single = np.isin(near, [ord(c) for c in "stmd"])
        starts[quote[single | double] + 1] = False
        starts[quote[single] + 2] = True
        starts[quote[double] + 3] = True
        for k in special:
            starts[begin[k] + 1 : begin[k + 1]] = False
        at = np.flatnonzero(starts[:n])
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[np.append(at, n)]
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return words, np.searchsorted(at, begin[np.cumsum(counts, dtype=np.int64)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        words, ends = self.words(texts)
        coded = words.dictionary_encode()
        if len(self.known) > MEMORY:
            self._forget()
        kinds = coded.dictionary.to_pylist()
        self._learn([w for w in kinds if w not in self.known])
        which = np.fromiter(map(self.known.__getitem__, kinds), dtype=np.int64, count=len(kinds))[coded.indices.to_numpy()]
        begin = self.upto[which]
        lens = self.upto[which + 1] - begin
        upto = np.concatenate([[0], np.cumsum(lens)])
        ids = self.tokens[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], lens)]
        rows = [0, *upto[ends].tolist()]
        return [ids[a:b] for a, b in zip(rows, rows[1:])]

    def _learn(self, words: list[bytes]) -> None:
        """Adds distinct words to the known ones."""
        found = self.encode_words([w for w in words if w not in self.added])
        found |= {w: [self.added[w]] for w in words if w in self.added}
        self.known.update(zip(found, range(len(self.known), len(self.known) + len(found))))
        lens = [len(tokens) for tokens in found.values()]
        self.tokens = np.concatenate([self.tokens, np.fromiter(chain.from_iterable(found.values()), dtype=np.int32, count=sum(lens))])
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(lens, dtype=np.int64)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 of the text of token ids; bytes that are no UTF-8 become U+FFFD. Unknown ids raise IndexError."""
        if not len(ids):
            return b""
        lens = self.lengths[ids]
        ends = np.cumsum(lens)
        raw = self.flat[np.arange(int(ends[-1])) + np.repeat(self.at[ids] - (ends - lens), lens)].tobytes()
        return raw.decode("utf-8", "replace").encode()

    def digest(self, ids: np.ndarray) -> str:
        return hashlib.sha256(b",".join(map(self.decimals.__getitem__, ids.tolist()))).hexdigest()


def _shared(docs: DataFrame, path: str):
    """The vocabulary, broadcast: its size is that of the file."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    release()
    return shared


def _codec(shared, cell: list) -> Codec:
    if not cell:
        cell.append(Codec(shared.value))
    return cell[0]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the whole text's token ids; null texts count as empty, and empty ones give no ids.

    Strings of added tokens in a text become those tokens. Ids may be null or repeat; other columns are
    ignored; an empty table gives an empty result.
    """
    shared = _shared(docs, path)

    def run(batches):
        cell: list = []
        for batch in batches:
            codec, texts = _codec(shared, cell), batch.column(1)
            for lo, hi in slices(texts, PART):
                ids = codec.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of the token ids; null ids give a null text."""
    shared = _shared(encoded, path)

    def run(batches):
        cell: list = []
        for batch in batches:
            codec = _codec(shared, cell)
            texts = [codec.decode(np.asarray(x.values.to_numpy(zero_copy_only=False))).decode() if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), ids_col).mapInArrow(tidy(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the encoding and of its decoding, in one pass.

    Nulls, blanks and repeats are as in `encode`.
    """
    shared = _shared(docs, path)

    def run(batches):
        cell: list = []
        for batch in batches:
            codec, texts = _codec(shared, cell), batch.column(1)
            rows = []
            for lo, hi in slices(texts, PART):
                for ids in codec.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()]):
                    rows.append((len(ids), codec.digest(ids), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, own, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
