"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A model has one table per n-gram order: the sorted hashes of all n-grams seen in any language, and behind
each hash the log probabilities, fully interpolated, of the languages that have seen it; and such a table
of contexts with the back-off weights. So a model holds what its languages have seen, never n-grams times
languages. Hashes are a bijection of the packed n-gram, so no two collide; letters outside the Basic
Multilingual Plane share one code, so scripts there are one letter each time. Texts are scored whole; the
language of the lowest cross-entropy per character wins. A logistic curve over the margin to the next
language and a bound on the cross-entropy itself, both fitted on rows left out of the counts, give the
score and the rejection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, release, slices, tidy

ORDER, CODE_BITS = 4, 16
UNKNOWN = "und"
_FOLD = None


def _fold() -> np.ndarray:
    """Code point -> 16-bit code of its lower-case letter; 0 for all that is no letter."""
    global _FOLD
    if _FOLD is None:
        table = np.zeros(0x110000, dtype=np.uint16)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                table[c] = min(ord(low) if len(low) == 1 else c, 0xFFFF)
        _FOLD = table
    return _FOLD


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed n-grams of the highest order, row of each, letters per row); runs of non-letters are one boundary."""
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(texts)), [len(t or "") for t in texts])
    codes = _fold()[points].astype(U64)
    letters = np.bincount(rows[codes > 0], minlength=len(texts))
    keep = codes > 0
    keep[1:] |= (codes[1:] == 0) & ((codes[:-1] > 0) & (rows[1:] == rows[:-1]))
    codes, rows = codes[keep], rows[keep]
    packed = codes.copy()
    for k in range(1, ORDER):
        packed[k:] |= np.where(rows[k:] == rows[:-k], codes[:-k], U64(0)) << U64(CODE_BITS * k)
    return packed, rows, letters


class HashTable:
    """Sorted hashes, each with entries (language, value); a directory on the top bits leaves a step or two to search."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        """parts: (distinct keys, values) of each language."""
        hashes = mix64(np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, U64))
        owners = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(k) for k, _ in parts])
        values = np.concatenate([v for _, v in parts]) if parts else np.zeros(0)
        order = np.argsort(hashes, kind="stable")
        hashes, self.owners, self.values = hashes[order], owners[order], values[order].astype(np.float32)
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        self.hashes, self.first = hashes[new], np.append(np.flatnonzero(new), len(hashes))
        bits = max(1, int(len(self.hashes)).bit_length())
        self.shift = U64(64 - bits)
        self.starts = np.searchsorted(self.hashes >> self.shift, np.arange(1 << bits, dtype=U64))

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in keys, language, value) of all entries of the keys."""
        at = self.find(keys)
        seen = np.flatnonzero(at >= 0)
        lo = self.first[at[seen]]
        n = self.first[at[seen] + 1] - lo
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)
        return np.repeat(seen, n), self.owners[which], self.values[which]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        want = mix64(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.hashes):
            return out
        open_, at = np.arange(len(keys)), self.starts[(want >> self.shift).astype(np.int64)]
        while len(open_):
            inside = at < len(self.hashes)
            open_, at = open_[inside], at[inside]
            here, mine = self.hashes[at], want[open_]
            out[open_[here == mine]] = at[here == mine]
            more = here < mine
            open_, at = open_[more], at[more] + 1
        return out


@dataclass
class Model:
    languages: list[str]
    tables: list[HashTable]  # by order, from 1
    contexts: list[HashTable]  # back-off weights of the contexts, by order, from 2
    floor: np.ndarray  # log probability of an unseen character
    slope: float = 10.0
    intercept: float = 0.0
    limits: np.ndarray | None = None  # cross-entropy above which a text is rejected

    def log_probs(self, packed: np.ndarray) -> np.ndarray:
        """(n-grams, languages) log2 probabilities of the last character given those before."""
        out = np.tile(np.asarray(self.floor, dtype=np.float32), (len(packed), 1))
        for order in range(1, ORDER + 1):
            keys = packed & U64((1 << (CODE_BITS * order)) - 1)
            if order > 1:
                row, lang, weight = self.contexts[order - 2].entries(keys >> U64(CODE_BITS))
                out[row, lang] += weight
            row, lang, value = self.tables[order - 1].entries(keys)
            out[row, lang] = value
        return out

    def cross_entropy(self, texts: list[str | None], cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages) bits per character, and letters per row. An n-gram is looked up once a step."""
        packed, rows, letters = grams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        step = max(1, cells // max(1, len(self.languages)))
        for lo in range(0, len(packed), step):
            r = rows[lo : lo + step]
            kinds, which = np.unique(packed[lo : lo + step], return_inverse=True)
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            total[r[starts]] += np.add.reduceat(self.log_probs(kinds).astype(np.float64)[which], starts, axis=0)
        return -total / np.maximum(np.bincount(rows, minlength=len(texts)), 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        bits, letters = self.cross_entropy(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        best = bits.argmin(axis=1)
        low = np.take_along_axis(bits, best[:, None], axis=1)[:, 0]
        rest = bits.copy()
        np.put_along_axis(rest, best[:, None], np.inf, axis=1)
        margin = np.minimum(rest.min(axis=1, initial=np.inf) - low, 64.0)
        score = np.where(letters > 0, 1 / (1 + np.exp(-np.clip(self.slope * margin + self.intercept, -30, 30))), 0.0)
        rejected = (letters == 0) | ((low > self.limits[best]) if self.limits is not None else False)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)], score, rejected


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from each language's (packed n-grams of the highest order, counts)."""
    languages = sorted(counts)
    letters = np.unique(np.concatenate([np.unique(k & U64((1 << CODE_BITS) - 1)) for k, _ in counts.values()])) if languages else np.zeros(0, U64)
    tables: list[list] = [[] for _ in range(ORDER)]
    contexts: list[list] = [[] for _ in range(ORDER - 1)]
    floor = np.zeros(len(languages), np.float32)
    for j, lang in enumerate(languages):
        keys, n = counts[lang]
        order = np.argsort(keys)
        levels = {ORDER: (keys[order], n[order].astype(np.float64))}
        for k in range(ORDER - 1, 0, -1):  # below the top: in how many contexts one character longer
            shorter, kinds = np.unique(levels[k + 1][0] & U64((1 << (CODE_BITS * k)) - 1), return_counts=True)
            levels[k] = (shorter, kinds.astype(np.float64))
        lower = lower_keys = None
        for k in range(1, ORDER + 1):
            keys, n = levels[k]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            heads, head = np.unique(keys >> U64(CODE_BITS), return_inverse=True) if k > 1 else (np.zeros(1, U64), np.zeros(len(keys), dtype=np.int64))
            total = np.bincount(head, weights=n, minlength=len(heads))
            weight = np.where(total > 0, discount * np.bincount(head, minlength=len(heads)) / np.maximum(total, 1), 1.0)
            # an n-gram's end of one character less was seen with it
            base = lower[np.searchsorted(lower_keys, keys & U64((1 << (CODE_BITS * (k - 1))) - 1))] if k > 1 else 1 / (len(letters) + 1)
            lower, lower_keys = np.maximum(n - discount, 0) / total[head] + weight[head] * base, keys
            tables[k - 1].append((keys, np.log2(np.maximum(lower, 1e-12))))
            if k > 1:
                contexts[k - 2].append((heads, np.log2(np.maximum(weight, 1e-12))))
            else:
                floor[j] = np.log2(max(weight[0] / (len(letters) + 1), 1e-12))
    return Model(languages, [HashTable(t) for t in tables], [HashTable(c) for c in contexts], floor)


def platt(x: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(good | x), with Platt's smoothed targets, by Newton steps."""
    yes, no = int(good.sum()), int((~good).sum())
    target = np.where(good, (yes + 1) / (yes + 2), 1 / (no + 2))
    scale = max(float(np.abs(x).max(initial=0.0)), 1e-9)  # of the margins, so that the curve's slope is of order one
    x = x / scale
    at = np.array([0.0, np.log((yes + 1) / (no + 1))])

    def loss(t: np.ndarray) -> float:
        z = t[0] * x + t[1]
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * t @ t)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - target) * x).sum(), (p - target).sum()]) + 1e-3 * at
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step, now, t = np.linalg.solve(h, g), loss(at), 1.0
        while t > 1e-6 and loss(at - t * step) > now:
            t /= 2
        at = at - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    a, b = at[0] / scale, at[1]
    return float(a), float(b)


#: Sampling rates of at most so many languages are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000


def _chars(text):
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def train(labelled: DataFrame, sample_chars: int = 3_000_000, reject_quantile: float = 0.999, seed: int = 3) -> Model:
    """Fits a model on (text, lang) rows. A bounded sample is used: per language about `sample_chars`
    characters of whole texts, drawn from all rows by a hash of the text; a tenth of it calibrates. The text
    of a language with the smallest hash is always drawn and counted, so no language is lost. The driver holds
    the distinct n-grams of the sample (some 20 bytes each), the tasks the model (some 20 bytes an n-gram)."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    place = F.xxhash64("text", F.lit(seed))
    sizes = rows.groupBy("lang").agg(F.sum(_chars(F.col("text"))).alias("chars"), F.min(F.when(_chars(F.col("text")) > 0, place)).alias("first"))
    chance = sizes.select(F.col("lang").alias("l"), "first", F.least(F.lit(1.0), F.lit(float(sample_chars)) / F.greatest("chars", F.lit(1))).alias("p"))
    if rows.select("lang").distinct().count() <= BROADCAST_LANGUAGES:  # else whole texts would be shuffled by language
        chance = F.broadcast(chance)
    draw = lambda s: F.pmod(F.xxhash64("text", F.lit(s)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(chance, F.col("lang") == F.col("l")).where((draw(seed) < F.col("p")) | (place == F.col("first"))).withColumn("test", (draw(seed + 1) < 0.1) & (place != F.col("first"))).select("text", "lang", "test")

    def count(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(0), 4 << 20):
                part = batch.slice(lo, hi - lo)
                yield from counts(part.column(0).to_pylist(), np.array(part.column(1).to_pylist(), dtype=object))

    def counts(texts, langs):
        packed, where, _ = grams(texts)
        for lang in sorted(set(langs)):
            keys, n = np.unique(packed[langs[where] == lang], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.where("not test").select("text", "lang").mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, keys, n = np.array(counted.column("lang").to_pylist(), dtype=object), counted.column("gram").to_numpy().view(U64), counted.column("n").to_numpy()
    model = kneser_ney({x: (keys[langs == x], n[langs == x]) for x in sorted(set(langs))})
    del counted, langs, keys, n
    release()
    if not model.languages:
        return model
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                bits, letters = shared.value.cross_entropy(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(letters)], names=["lang", "bits", "letters"])

    held = sample.where("test").select("text", "lang").mapInArrow(tidy(measure), "lang string, bits array<double>, letters long").where("letters > 0").collect()
    if held:
        bits = np.array([r["bits"] for r in held])
        best, low = bits.argmin(axis=1), np.sort(bits, axis=1)
        good = np.array([model.languages[b] == r["lang"] for b, r in zip(best, held, strict=True)])
        if len(model.languages) > 1:
            model.slope, model.intercept = platt(low[:, 1] - low[:, 0], good)
        model.limits = np.array([np.quantile(low[best == j, 0], reject_quantile) * 1.25 if (best == j).any() else np.inf for j in range(len(model.languages))])
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1, calibrated), rejected.

    Null texts and texts without a letter are `und` with score 0 and rejected, as is every text if the
    model knows no language. `rejected` also marks texts unlike all training text, whose best language is
    still named. Ties go to the language first in code point order. Ids may be null or repeat; other
    columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            out = [shared.value.predict(texts.slice(lo, hi - lo).to_pylist()) for lo, hi in slices(texts, 1 << 20)]
            langs = [x for part in out for x in part[0]]
            score = np.concatenate([part[1] for part in out]) if out else np.zeros(0)
            rejected = np.concatenate([part[2] for part in out]) if out else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, rejected boolean")
