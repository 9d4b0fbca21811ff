"""Learning a byte-level vocabulary: word counts, pair counts, ranked merges, the vocabulary table.

Counting is distributed. Merges are sequential; `merge_steps` keeps the words distributed and brings to the driver
only the parts of them in which the next merges lie, `train` works on the collected word counts as long as they
are few. Both find merges with an inverted index and a heap, and give those of a full recount each time.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import Table
from . import segments

#: Special tokens of a new vocabulary, in the order of their ids.
SPECIAL_TOKENS = ["<|endoftext|>", "<|pad|>", "<|unk|>", "<|bos|>", "<|eos|>"]
SEPARATOR = "\n\n"


def word_counts(docs: DataFrame, text_col: str = "clean", digit_mode: str = "clustered", separator: str = SEPARATOR) -> DataFrame:
    """(word, n): chunks of all texts, each followed by the separator as in a corpus file. Lines that `text_files.read_corpus`
    gives want a line end as separator."""
    chunks = T.pre_tokenize(F.concat(F.col(text_col), F.lit(separator)), digit_mode)
    return docs.select(F.explode(chunks).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def with_symbols(words: DataFrame) -> DataFrame:
    """Adds symbols; words of one byte have nothing to merge and go."""
    return words.where(F.octet_length("word") > 1).withColumn("symbols", T.symbols_of(T.to_byte_letters(F.col("word"))))


def pair_counts(words: DataFrame) -> DataFrame:
    """(l, r, freq): adjacent symbol pairs over all words, weighted by n; overlaps count."""
    parts = words.select("n", T.split_symbols(F.col("symbols")).alias("s")).where(F.size("s") > 1)
    pairs = F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("l"), F.slice("s", F.lit(2), F.size("s") - 1).alias("r"))
    return parts.select("n", F.explode(pairs).alias("p")).groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")).agg(F.sum("n").cast("long").alias("freq"))


def merged(symbols, left: str, right: str):
    """All occurrences of the pair joined, from left to right."""
    return F.replace(symbols, F.lit(f"\x02{left}\x03\x02{right}\x03"), F.lit(f"\x02{left}{right}\x03"))


def _leading(pairs: np.ndarray, freq: np.ndarray, whole: bool, least: int, count: int) -> tuple[np.ndarray, int]:
    """(pairs, bar): about `count` of the most frequent pairs (sorted by frequency), with all that tie; every other pair
    has `bar` occurrences at most. None if the ties go on beyond what is given. `whole`: no pair of `least` occurrences is missing."""
    if whole and len(freq) <= count:
        return pairs, least - 1
    bar = int(freq[min(count, len(freq) - 1)])
    if bar == freq[0]:  # at least the most frequent ones
        rarer = freq[freq < bar]
        bar = int(rarer[0]) if len(rarer) else least - 1 if whole else bar
    return pairs[freq > bar], bar


def merge_steps(words: DataFrame, merges: int, min_frequency: int = 2, look: int = 16_384, budget: int = 1 << 20) -> list[tuple[str, str, int]]:
    """(left, right, frequency) of up to `merges` merges: most frequent pair first, ties to the smallest pair.

    The words stay distributed. Each round counts the pairs and takes the most frequent ones. As long as a merge has
    more occurrences than any other pair, it lies in runs of symbols that hang together by these pairs: what it makes
    is no more frequent than what it joins. So the distinct runs with their weights say all, and the merges are found
    on the driver, until the other pairs could come first or a merge makes a token that is there already. The pairs
    of a round are as many as have `budget` symbols in distinct runs at most, but at least the most frequent ones; the
    next round takes up to four times as many if this one's were far from it.
    """
    state, tokens, found = Table(segments.from_words(words)), T.byte_alphabet(), []
    number = {t: i for i, t in enumerate(tokens)}
    joins: list[segments.Join] = []  # found, but not yet in the state
    count = max(16, min(128, 4 * merges))
    while len(found) < merges:
        counted = Table(segments.pair_counts(state.df, joins).where(F.col("freq") >= min_frequency))
        chosen, wide = np.zeros(0, dtype=np.int64), max(2, look)
        while not len(chosen):  # ties beyond the rows that are looked at: look at more
            rows = counted.df.orderBy(F.desc("freq"), "pair").limit(wide).toArrow()
            pairs, freq = (rows.column(c).to_numpy() for c in ("pair", "freq"))
            whole = len(rows) < wide
            if not len(rows):
                break
            chosen, bar = _leading(pairs, freq, whole, min_frequency, int(count))
            wide *= 8
        counted.drop()
        while len(chosen):
            table = Table(segments.segments(state.df, joins, np.sort(chosen)))
            size = table.df.agg(F.sum(F.octet_length("symbols") + 12)).first()[0] or 0
            smaller, below = _leading(pairs, freq, whole, min_frequency, len(chosen) // 2)
            if size <= 4 * budget or len(smaller) >= len(chosen):
                break
            table.drop()
            chosen, bar = smaller, below
        if not len(chosen):
            break
        rows = table.df.toArrow()
        table.drop()
        flat, lens = _arrays(rows.column("symbols"), np.int32)
        more = _learn(flat.astype(np.int64), lens, rows.column("n").to_numpy(), tokens, merges - len(found), min_frequency, bar)
        for left, right, _ in more:
            made = number.setdefault(left + right, len(tokens))
            if made == len(tokens):
                tokens.append(left + right)
            joins.append((number[left], number[right], made))
        found += more
        count = len(chosen) * (4 if size <= budget // 4 else 2 if size <= budget else 1.2)  # the fewer rounds, the fewer passes
        if len(joins) >= 64 and len(found) < merges:
            state, old = Table(segments.joined(state.df, joins)), state
            joins = []
            old.drop()
    state.drop()
    return found


def learn(counts: dict[tuple[str, ...], int], merges: int, min_frequency: int = 2) -> list[tuple[str, str, int]]:
    """The same merges from word counts in memory: an inverted index says which words a merge touches, and a
    heap with stale entries gives the next pair. Pairs are counted and indexed as arrays before the first merge."""
    letters = sorted({c for w in counts for c in w})
    code = {c: i for i, c in enumerate(letters)}
    lens = np.fromiter((len(w) for w in counts), dtype=np.int64, count=len(counts))
    flat = np.fromiter((code[c] for w in counts for c in w), dtype=np.int64, count=int(lens.sum()))
    return _learn(flat, lens, np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), letters, merges, min_frequency)


def _learn(flat: np.ndarray, lens: np.ndarray, weight: np.ndarray, tokens: list[str], merges: int, min_frequency: int, bar: int | None = None) -> list[tuple[str, str, int]]:
    """Words as one array of token numbers, `lens` of them a word; tokens: their strings. With a bar, learning ends where
    pairs are no more frequent than it, and with a merge that makes a token that is there already."""
    tokens, n = list(tokens), len(lens)
    if not len(flat):
        return []
    number = {t: i for i, t in enumerate(tokens)}
    begin = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(n), lens)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    pair_of, word_of = (flat[inner] << 32) | flat[inner + 1], owner[inner]
    order = np.argsort(pair_of, kind="stable")
    pair_of, word_of = pair_of[order], word_of[order]
    kinds, first = np.unique(pair_of, return_index=True)
    sums = np.add.reduceat(weight[word_of], first) if len(first) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(pair_of))
    split = lambda c: (c >> 32, c & 0xFFFFFFFF)
    freq = {split(c): f for c, f in zip(kinds.tolist(), sums.tolist(), strict=True)}
    base = {split(c): (a, b) for c, a, b in zip(kinds.tolist(), first.tolist(), last.tolist(), strict=True)}
    more: dict[tuple[int, int], set[int]] = defaultdict(set)
    words: dict[int, list[int]] = {}  # those that a merge has touched
    weights = weight.tolist()
    heap = [(-f, tokens[a], tokens[b]) for (a, b), f in freq.items()]
    heapq.heapify(heap)
    found = []
    while heap and len(found) < merges:
        count, left, right = heapq.heappop(heap)
        pair = (number[left], number[right])
        if freq.get(pair) != -count:
            continue
        if -count < min_frequency or (bar is not None and -count <= bar):
            break
        found.append((left, right, -count))
        made = number.setdefault(left + right, len(tokens))
        if made == len(tokens):
            tokens.append(left + right)
        elif bar is not None:
            break
        lo, hi = base.pop(pair, (0, 0))
        touched: set[tuple[int, int]] = set()
        for i in more.pop(pair, set()).union(word_of[lo:hi].tolist()):
            old = words.get(i)
            if old is None:
                old = flat[begin[i] : begin[i] + lens[i]].tolist()
            new, k = [], 0
            while k < len(old):
                hit = k + 1 < len(old) and old[k] == pair[0] and old[k + 1] == pair[1]
                new.append(made if hit else old[k])
                k += 1 + hit
            if len(new) == len(old):
                continue
            for p in zip(old, old[1:]):
                freq[p] -= weights[i]
                touched.add(p)
            for p in zip(new, new[1:]):
                freq[p] = freq.get(p, 0) + weights[i]
                more[p].add(i)
                touched.add(p)
            words[i] = new
        for p in touched:
            if freq[p] > 0:
                heapq.heappush(heap, (-freq[p], tokens[p[0]], tokens[p[1]]))
            else:
                del freq[p]
                more.pop(p, None)
                base.pop(p, None)
    return found


def _arrays(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, values a row) of a column of bytes or texts."""
    raw = column.combine_chunks()
    raw = raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw
    raw = raw.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(raw) else np.zeros(0, np.uint8)
    return data.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def train(words: DataFrame, vocab_size: int, min_frequency: int = 2, specials: list[str] | None = None, driver_bytes: int = 1 << 20) -> list[tuple[str, str, int]]:
    """Merges for a vocabulary of `vocab_size`.

    The distinct words (never the corpus) are collected if they have `driver_bytes` at most, as learning takes many
    times their size; beyond that they stay distributed and `merge_steps` finds the same merges.
    """
    if vocab_size < 256 or min_frequency < 1:
        raise ValueError("vocab_size must be 256 at least and min_frequency 1 at least")
    special = SPECIAL_TOKENS if specials is None else specials
    merges = max(0, vocab_size - 256 - len(special))
    table = Table(words.where(F.octet_length("word") > 1).select("word", "n"))
    size = table.df.agg(F.sum(F.octet_length("word") + 8)).first()[0] or 0
    if size > driver_bytes:
        found = merge_steps(table.df, merges, min_frequency)
        table.drop()
        return found
    rows = table.df.toArrow()
    table.drop()
    data, lens = _arrays(rows.column("word"), np.uint8)
    return _learn(data.astype(np.int64), lens, rows.column("n").to_numpy(), T.byte_alphabet(), merges, min_frequency)


def vocabulary_tokens(merges: list[tuple[str, str, int]], specials: list[str] | None = None) -> list[str]:
    """Tokens by id: special tokens, the byte letters, then each new merged token."""
    tokens = dict.fromkeys([*(SPECIAL_TOKENS if specials is None else specials), *T.byte_alphabet()])
    tokens |= dict.fromkeys(left + right for left, right, _ in merges)
    return list(tokens)


def merge_table(spark: SparkSession, merges: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame([(i, left, right, n) for i, (left, right, n) in enumerate(merges)], "merge_rank int, l string, r string, freq long")


def vocabulary_table(spark: SparkSession, merges: list[tuple[str, str, int]], specials: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(vocabulary_tokens(merges, specials))), "id int, token string").select("token", "id")


def specials_present(vocab: DataFrame, specials: list[str]) -> DataFrame:
    """The rows of a vocabulary that are one of the special tokens (a handful)."""
    named = vocab.sparkSession.createDataFrame([(s,) for s in specials], "token string")
    return vocab.join(F.broadcast(named), "token", "left_semi")


def sweep_counts(words: DataFrame, models: list) -> DataFrame:
    """(vocab_size, n_tokens) of each model over word counts. Models are prefixes of one another, shortest first:
    one pass replaces the merges in order and counts the symbols at each size."""
    symbols = T.symbols_of(T.to_byte_letters(F.col("word")))
    counts, done = [], 0
    rows = words.withColumn("symbols", symbols)
    for k, model in enumerate(models):
        for left, right, _ in model.merges[done:]:
            rows = rows.withColumn("symbols", merged(F.col("symbols"), left, right))
        done = len(model.merges)
        rows = rows.withColumn(f"size{k}", F.size(T.split_symbols(F.col("symbols"))))
        counts.append(F.sum(F.col("n") * F.col(f"size{k}")).cast("long").alias(f"n{k}"))
    pairs = F.array(*[F.struct(F.lit(len(m.tokens)).alias("vocab_size"), F.col(f"n{k}").alias("n_tokens")) for k, m in enumerate(models)])
    return rows.agg(*counts).select(F.inline(pairs))
