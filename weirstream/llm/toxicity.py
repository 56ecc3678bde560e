"""Operator 8: toxicity after noisy-channel deobfuscation.

Words that look disguised (leetspeak characters among letters, letters spaced or dotted apart, runs of a letter, a star in
place of a letter) become lattices: each written character can stand for some letters or for nothing, at a cost. Viterbi
decoding picks the restored word that a character trigram model makes likeliest. The model mixes trigrams counted over all
texts with trigrams of the words that mark toxic rows. Before that, full-width letters, invisible joints and letters of other
scripts inside Latin words are made plain. Restored texts are scored by a logistic regression over character 4- and 5-grams.

Training: n-gram document frequencies by label come from all training rows; all n-grams (by hash, of 2**BUCKET_BITS buckets)
that are surely commoner in toxic rows are features; weights are fitted on at most MAX_FIT training rows, those of lowest
hash, with at most MAX_FIT of the marking words as short examples. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts have no features and score the intercept; repeated rows score alike; labels for unknown
documents and null labels are ignored, and of several labels of a document the highest counts; without training rows of both
kinds the score is the prior (0.05 if there are none); a null doc_id is kept and has no label; empty tables give no rows;
extra columns are ignored; words and texts of any length are scanned whole. A run beyond three of a letter says no more than
three.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import bounded, materialise, small_batches, table

#: Letters that a written character can stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SEPARATORS = "._-*~'"
VOWELS = "aeiou"
NGRAMS = (4, 5)
BUCKET_BITS = 22
CHUNK = 4096
#: Bytes of text handled at once; an n-gram takes some hundred bytes meanwhile.
PIECE = 1 << 19
MAX_FIT = 20_000
LEAST_DOCS = 3
LEAST_MARGIN, LEXICON_MARGIN = 0.7, 4.0
#: Label tables up to this many rows (12 bytes each) are broadcast to the texts; larger ones are joined by shuffle.
BROADCAST_LABELS = 1_000_000
LETTERS = 28  # a to z, a word's edge, any other character
#: Letters of other scripts that look like Latin ones, for words that mix them with Latin letters.
ALIKE = {
    "а": "a", "в": "b", "е": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
}
#: Characters that show nothing: soft hyphen, zero-width space and joiners, word joiner, byte order mark.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_ALIKE = {ord(k): v for k, v in ALIKE.items()} | {ord(k.upper()): v.upper() for k, v in ALIKE.items()}
_PLAIN = {0xFF01 + i: chr(0x21 + i) for i in range(94)} | dict.fromkeys(map(ord, INVISIBLE))
_OTHER = "".join(map(chr, _ALIKE))
_MIXED = re.compile(rf"(?<!\S)(?=\S*?(?:[a-zA-Z][{_OTHER}]|[{_OTHER}][a-zA-Z]))\S+")
_L = "a-zA-ZÀ-ÖØ-öø-ÿ"
_X = re.escape("0123456789@$!|+(€")
_S = re.escape(SEPARATORS)
_T = _X.replace("!", "")
_OPEN = r"\s\"“”„«‹(\[{<"
#: Disguised words, of any length: a leet character beside a letter (but marks of exclamation at the end), or a star between
#: letters; single letters apart; a letter three times.
DISGUISED = re.compile(
    rf"(?<!\S)(?=\S*?(?:[{_X}][{_L}]|[{_L}]!*[{_T}]|[{_L}]\*{{1,3}}[{_L}]))\S+"
    rf"|(?<![^{_OPEN}])[{_L}{_X}](?:[{_S}]{{1,3}}[{_L}{_X}]){{2,}}(?![{_L}{_X}])"
    rf"|(?<![^{_OPEN}])[{_L}{_X}](?:[\x20\t]{{1,3}}[{_L}{_X}]){{3,}}(?![{_L}{_X}])"
    rf"|(?<!\S)(?=\S*?(?i:([{_L}])\1\1))\S+"
)
_LONG_RUN = re.compile(rf"(?i:([{_L}])\1\1\1+)")
_AROUND = re.compile(rf"^[^{_L}{_X}]+|[^{_L}{_X}]+$")
_CLASS = np.full(256, LETTERS - 1, np.uint8)
_CLASS[list(range(97, 123))] = np.arange(26)
_CLASS[list(range(65, 91))] = np.arange(26)
_CLASS[[9, 10, 11, 12, 13, 32]] = 26


def trigram_counts(data: np.ndarray) -> np.ndarray:
    c = _CLASS[data].astype(np.int64)
    return np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3) if len(c) > 2 else np.zeros(LETTERS**3, np.int64)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        for _, _, data, _ in V.chunks(batch.column(0), PIECE):
            total += trigram_counts(data)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["g", "n"])


def trigram_model(counts: np.ndarray, lexicon: np.ndarray, share: float = 0.5) -> np.ndarray:
    """Log-probabilities (28, 28, 28) of a character after two: corpus and lexicon trigrams mixed, smoothed by bigrams."""

    def probabilities(c: np.ndarray) -> np.ndarray:
        c = c.reshape(LETTERS, LETTERS, LETTERS).astype(float)
        two = c.sum(axis=0)
        low = (two + 0.5) / (two + 0.5).sum(axis=1, keepdims=True)
        return (c + 2 * low[None]) / (c.sum(axis=2, keepdims=True) + 2)

    p = probabilities(counts)
    return np.log(p if not lexicon.sum() else (1 - share) * p + share * probabilities(lexicon))


class Restorer:
    """Viterbi decoding of disguised words under a character trigram model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self._cached = lru_cache(maxsize=100_000)(self._restore)

    def restore(self, written: str) -> str:
        """The likeliest word; punctuation around it is dropped, and what a letter's run holds beyond three."""
        bare = _LONG_RUN.sub(lambda m: m.group(0)[:3], _AROUND.sub("", written))
        return self._cached(bare) if len(bare) <= 64 else self._restore(bare)

    @staticmethod
    def lattice(written: str) -> list[list[tuple[str, float]]]:
        """For each written character the letters it may stand for, with log channel probabilities; '' deletes it."""
        plain = written.lower()
        # a star hides a vowel if letters stand in a row beside it; in letters set apart it is a separator
        stars = [plain[max(0, i - 2) : i].isalpha() and i > 1 or (plain[i + 1 : i + 3].isalpha() and len(plain) > i + 2) for i in range(len(plain))]
        out: list[list[tuple[str, float]]] = []
        for i, ch in enumerate(plain):
            if ch in LEET:
                some = [(x, -0.7) for x in LEET[ch]]
                if ch in "!|(+" and (i == len(plain) - 1 or not plain[i + 1 :].strip("!|(+.,;:?)")):
                    some = [("", -0.1), *(some if ch != "!" else ())]
                elif not i and ch in "!|(+":
                    some.append(("", -0.1))
                elif i and plain[i - 1] == ch:
                    some.append(("", -1.0))
                out.append(some)
            elif ch == "*" and stars[i]:
                out.append([(x, -1.2) for x in VOWELS] + [("", -1.0)])
            elif ch.isspace() or ch in SEPARATORS:
                out.append([("", -0.1)])
            elif not ch.isalpha():
                out.append([("", -1.0)] if i == len(plain) - 1 else [(ch, -0.5), ("", -2.0)])
            elif i > 1 and plain[i - 1] == ch and plain[i - 2] == ch:
                out.append([("", -0.1)])  # a third in a row says nothing more
            elif i and plain[i - 1] == ch and (plain[i + 1 : i + 2] == ch):
                out.append([("", -0.5), (ch, -1.0)])  # a run of three or more: one letter or two
            else:
                out.append([(ch, 0.0)])
        return out

    def _restore(self, written: str) -> str:
        edge, other = 26, LETTERS - 1
        model = self.model
        # the letters chosen so far as a chain (before, letter), shared by paths, so a long word costs its length
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(edge, edge): (0.0, None)}
        for options in self.lattice(written):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (x, y), (score, chain) in states.items():
                for letter, cost in options:
                    if letter:
                        z = ord(letter) - 97 if "a" <= letter <= "z" else other
                        state, value = (y, z), score + cost + model[x][y][z]
                    else:
                        state, value = (x, y), score + cost - 2.0
                    if state not in after or after[state][0] < value:
                        after[state] = (value, (chain, letter) if letter else chain)
            states = after
        chain = max(((score + model[x][y][edge], x, y, chain) for (x, y), (score, chain) in states.items()), key=lambda s: s[:3])[3]
        letters = []
        while chain:
            chain, letter = chain
            letters.append(letter)
        return "".join(reversed(letters))

    def restored(self, text: str) -> str:
        """The text with disguised words restored; the others stand as they are."""
        text = _MIXED.sub(lambda m: m.group(0).translate(_ALIKE), text.translate(_PLAIN))
        return DISGUISED.sub(lambda m: self.restore(m.group(0)), text)


def framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with white space as spaces and one more space around each text, and where each text then begins."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    place = np.ones(len(data) + n + 1, bool)
    at = offsets + np.arange(n + 1)
    place[at] = False
    out[place] = np.where(V.IS_WORD[data], V.LOWERED[data], 32)
    return out, at


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of the character n-grams of the texts, framed by spaces; only of the wanted buckets, if given."""
    text, at = framed(data, offsets)
    out_b, out_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    byte = V._BYTES[text]
    h, size = byte[: max(0, len(text) - NGRAMS[0] + 1)].copy(), 1
    for goal in NGRAMS:
        h = h[: max(0, len(text) - goal + 1)]
        while size < goal:
            h *= V.U(0x9E3779B97F4A7C15)
            h += byte[size : len(h) + size]
            size += 1
        bucket = ((h * V.U(0xD1342543DE82EF95)) >> V.U(64 - BUCKET_BITS)).astype(np.int32)
        place = np.arange(len(bucket)) if wanted is None else np.flatnonzero(wanted[bucket])
        out_b.append(bucket[place].astype(np.int64))
        out_p.append(place | (np.int64(goal) << np.int64(48)))
    bucket, place = np.concatenate(out_b), np.concatenate(out_p)
    goal, place = place >> np.int64(48), place & np.int64((1 << 48) - 1)
    owner = np.searchsorted(at, place, side="right") - 1
    fits = (owner < len(offsets) - 1) & (place + goal <= at[np.minimum(owner + 1, len(offsets) - 1)] + 1)
    return bucket[fits], owner[fits]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the n-gram buckets that toxic rows of this part hold."""
    toxic_n, clean_n = np.zeros(1 << BUCKET_BITS, np.int32), np.zeros(1 << BUCKET_BITS, np.int32)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in V.chunks(batch.column(0), PIECE):
            for kind, total in ((1, toxic_n), (0, clean_n)):
                _add_frequencies(total, data, offsets, toxic[lo:hi] == kind, None)
    at = np.flatnonzero(toxic_n)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(clean_n[part].astype(np.int64)), pa.array(toxic_n[part].astype(np.int64))], names=["f", "clean", "toxic"])


def _add_frequencies(total: np.ndarray, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, wanted: np.ndarray | None) -> None:
    if not rows.any():
        return
    bucket, text = ngram_buckets(data, offsets, wanted)
    keep = rows[text]
    seen = np.unique(bucket[keep] * len(rows) + text[keep])
    seen //= len(rows)
    first = np.flatnonzero(np.diff(seen, prepend=-1))
    total[seen[first]] += np.diff(first, append=len(seen)).astype(np.int32)


def _clean_counts(features: np.ndarray):
    """Clean document frequencies of the features: dense counts of CHUNK features a row, so a part gives few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = np.zeros(1 << BUCKET_BITS, bool), np.zeros(1 << BUCKET_BITS, np.int32)
        wanted[features] = True
        for batch in batches:
            clean = batch.column(1).to_numpy(zero_copy_only=False) == 0
            for lo, hi, data, offsets in V.chunks(batch.column(0), PIECE):
                _add_frequencies(total, data, offsets, clean[lo:hi], wanted)
        counts = total[features].astype(np.int64)
        parts = [counts[i : i + CHUNK].tobytes() for i in range(0, len(counts), CHUNK)]
        slot = np.random.default_rng(int(counts.sum()) + len(counts)).integers(0, 64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([int(slot)] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "slot", "counts"])

    return run


def _summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
    return pa.table([group.column("chunk").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["chunk", "counts"])


def clean_frequencies(pairs: DataFrame, features: np.ndarray) -> np.ndarray:
    """Sums over all rows, in two levels (64 slots a chunk, then one), so no task gathers the rows of every part."""
    rows = pairs.mapInArrow(_clean_counts(features), "chunk int, slot int, counts binary")
    half = rows.groupBy("chunk", "slot").applyInArrow(_summed, "chunk int, counts binary")
    out = np.zeros(len(features), np.int64)
    for r in half.groupBy("chunk").applyInArrow(_summed, "chunk int, counts binary").collect():
        part = np.frombuffer(r["counts"], np.int64)
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(part)] = part
    return out


def _feature_rows(features: np.ndarray):
    index = np.full(1 << BUCKET_BITS, -1, np.int32)
    index[features] = np.arange(len(features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in V.chunks(batch.column(0), PIECE):
                bucket, text = ngram_buckets(data, offsets, index >= 0)
                pairs = np.unique(text * np.int64(len(features)) + index[bucket])
                lists = np.split(pairs % len(features), np.searchsorted(pairs // len(features), np.arange(1, hi - lo))) if len(features) else []
                yield pa.RecordBatch.from_arrays([pa.array(toxic[lo:hi].astype(np.int32)), pa.array([x.astype(np.int32) for x in lists], pa.list_(pa.int32()))], names=["toxic", "fs"])

    return run


def fit_logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression over presence features, by full-batch Adam steps."""
    w = np.zeros(width + 1)
    w[-1] = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], minlength=len(y)) + w[-1]
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = np.append(np.bincount(cols, g[rows], minlength=width) + ridge * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _grams_of_words(words: list[str]) -> np.ndarray:
    return trigram_counts(np.frombuffer(("  " + "  ".join(words) + "  ").encode(), np.uint8))


def _word_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        total += _grams_of_words(batch.column(0).to_pylist())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["g", "n"])


class Model:
    """Features with weights, an intercept and a restorer; small (a weight for each of at most 2**BUCKET_BITS features, 28**3 trigrams)."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, intercept: float, trigrams: np.ndarray):
        self.features, self.weights, self.intercept, self.trigrams = features, weights, intercept, trigrams

    def score(self, texts: pa.Array, restorer: Restorer) -> np.ndarray:
        weight, wanted = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS, bool)
        weight[self.features] = self.weights
        wanted[self.features] = True
        out = [np.zeros(0)]
        for lo, hi, data, offsets in V.chunks(texts, PIECE):
            data, offsets = restore_all(data, offsets, restorer)
            bucket, text = ngram_buckets(data, offsets, wanted)
            pairs = np.unique(text << np.int64(BUCKET_BITS) | bucket)
            z = np.bincount(pairs >> BUCKET_BITS, weight[pairs & ((1 << BUCKET_BITS) - 1)], minlength=hi - lo) + self.intercept
            out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return np.concatenate(out)


_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(0x80, 0x100))] = True
_IS_LEET = np.zeros(256, bool)
_IS_LEET[[ord(c) for c in LEET if ord(c) < 128]] = True


def disguised_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Indices of texts that may hold a disguised word: what DISGUISED needs, tested on bytes all at once."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    letter, leet = _IS_LETTER[data], _IS_LEET[data]
    mark = data == ord("!")
    found = [np.flatnonzero(leet[:-1] & letter[1:]), np.flatnonzero((letter | mark)[:-1] & (leet & ~mark)[1:])]
    if (data >= 0xC2).any():
        found += _other_marks(data, letter)
    found.append(np.flatnonzero(_STAR_BESIDE[data[:-1]] & letter[1:]))
    if len(data) > 5:  # letters of two bytes, whose cases differ by one bit of the second
        second = data | 0x20
        alike = (data[:-2] == 0xC3) & (data[2:] == 0xC3)
        alike[:-1] &= second[1:-2] == second[3:]
        found.append(np.flatnonzero(alike[:-3] & alike[2:-1]))
    found.append(np.flatnonzero(letter[2:] & (V.LOWERED[data[2:]] == V.LOWERED[data[1:-1]]) & (V.LOWERED[data[1:-1]] == V.LOWERED[data[:-2]])))
    word = letter | leet
    alone = word.copy()
    alone[1:] &= ~word[:-1]
    alone[:-1] &= ~word[1:]
    place = np.flatnonzero(alone)
    if len(place) > 2:
        found.append(place[:-2][place[2:] - place[:-2] <= 8])
    return np.unique(np.searchsorted(offsets, np.concatenate(found), side="right") - 1)


_STAR_BESIDE = np.zeros(256, bool)
_STAR_BESIDE[ord("*")] = True
_ASCII_LETTER = _IS_LETTER & (np.arange(256) < 128)
#: First bytes of Greek and Cyrillic letters.
_FOREIGN = np.zeros(256, bool)
_FOREIGN[[0xCE, 0xCF, 0xD0, 0xD1, 0xD2, 0xD4]] = True


def _other_marks(data: np.ndarray, letter: np.ndarray) -> list[np.ndarray]:
    """Places of the euro sign, invisible characters, full-width forms, and letters of other scripts beside Latin ones."""
    a, b, c = data[:-2], data[1:-1], data[2:]
    threes = ((a == 0xE2) & (b == 0x82) & (c == 0xAC)) | ((a == 0xE2) & (b == 0x80) & (c >= 0x8B) & (c <= 0x8D)) | ((a == 0xE2) & (b == 0x81) & (c == 0xA0))
    threes |= (a == 0xEF) & ((b == 0xBC) | (b == 0xBD) | ((b == 0xBB) & (c == 0xBF)))
    latin = _ASCII_LETTER[data]
    return [np.flatnonzero(threes), np.flatnonzero((a == 0xC2) & (b == 0xAD)), np.flatnonzero(latin[:-1] & _FOREIGN[data[1:]]), np.flatnonzero(_FOREIGN[a] & latin[2:])]


def restore_all(data: np.ndarray, offsets: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    rows = disguised_rows(data, offsets)
    if not len(rows):
        return data, offsets
    pieces, lengths, last = [], np.diff(offsets), 0
    for i in rows.tolist():
        pieces.append(data[offsets[last] : offsets[i]])
        clear = restorer.restored(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")).encode()
        pieces.append(np.frombuffer(clear, np.uint8))
        lengths[i] = len(clear)
        last = i + 1
    pieces.append(data[offsets[last] :])
    return np.concatenate(pieces), np.concatenate([[0], np.cumsum(lengths)])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit: int = MAX_FIT) -> Model:
    """Fit on the rows of docs that labels (id_col, label_col 0/1) covers; trigrams are counted over all docs."""
    small_batches(docs.sparkSession)
    text = docs.select(F.col(text_col).alias("text"))
    counts = np.zeros(LETTERS**3, np.int64)
    for r in text.mapInArrow(_count_trigrams, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect():
        counts[r["g"]] = r["n"]  # at most 28**3 rows
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IN (0, 1)")
    known = materialise(known.groupBy("l_id").agg(F.max("toxic").alias("toxic")), "labels")

    def labelled(ids: DataFrame) -> DataFrame:
        side = F.broadcast(ids) if bounded(ids, BROADCAST_LABELS) else ids
        return docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).join(side, F.col("d_id") == F.col("l_id"))

    # equal texts count once, else a group of copies would make marks of all its n-grams
    firsts = labelled(known).groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("d_id").alias("l_id")).select("l_id", "toxic")
    firsts = materialise(firsts, "firsts")
    rows = labelled(firsts).select("d_id", "text", "toxic")
    n = {r["toxic"]: r["n"] for r in firsts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        prior = (n1 + 0.05) / (n0 + n1 + 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), math.log(prior / (1 - prior)), trigram_model(counts, np.zeros(LETTERS**3)))

    def margin(clean: str):
        """Log-odds less 1.64 standard errors: surely commoner in toxic rows, not by chance."""
        odds = F.log((F.col("toxic") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col(clean) + 0.5) / F.lit(n0 + 1.0))
        return odds - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col(clean) + 0.5))

    pairs = rows.select("text", "toxic")
    marked = pairs.mapInArrow(_marked, "f bigint, clean bigint, toxic bigint").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # clean counts are partial here (parts without toxic rows for f say nothing), so the margin is at least the true one
    marked = materialise(marked.where(F.col("toxic") >= LEAST_DOCS).where(margin("clean") > LEAST_MARGIN), "marked")
    hopeful = np.array(sorted(tuple(r) for r in marked.select("f", "toxic").collect()), np.int64).reshape(-1, 2)  # at most 2**BUCKET_BITS
    clean_n = clean_frequencies(pairs, hopeful[:, 0])
    sure = np.log((hopeful[:, 1] + 0.5) / (n1 + 1.0)) - np.log((clean_n + 0.5) / (n0 + 1.0)) - 1.64 * np.sqrt(1 / (hopeful[:, 1] + 0.5) + 1 / (clean_n + 0.5))
    features = np.sort(hopeful[sure > LEAST_MARGIN, 0])
    share = min(1.0, max_fit / (n0 + n1))
    fit = rows.where(F.pmod(F.xxhash64("d_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text", "toxic")
    data = fit.mapInArrow(_feature_rows(features), "toxic int, fs array<int>").collect() if len(features) else []
    y = np.array([r["toxic"] for r in data], float)
    if not len(y) or y.min() == y.max():
        weights, intercept = np.ones(len(features)), math.log(n1 / n0)
    else:
        at = np.repeat(np.arange(len(y)), [len(r["fs"] or []) for r in data])
        cols = np.array([f for r in data for f in r["fs"] or []], np.int64)
        weights, intercept = fit_logistic(at, cols, y, len(features))
    # words that mark toxic rows make the lexicon of the character model, and short examples: each alone is toxic enough
    counted = pairs.mapInArrow(_lexicon(features, weights), "word string, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    marking = materialise(counted.where(margin("clean") > LEXICON_MARGIN).select("word"), "lexicon")
    # trigrams of all marking words are summed where these lie; at most 28**3 rows come
    spoken = np.zeros(LETTERS**3, np.int64)
    for r in marking.mapInArrow(_word_trigrams, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect():
        spoken[r["g"]] = r["n"]
    lexicon = [r["word"] for r in marking.orderBy(F.xxhash64("word"), "word").limit(max_fit).collect()]
    if lexicon and len(y) and y.min() != y.max():
        wanted, index = np.zeros(1 << BUCKET_BITS, bool), np.full(1 << BUCKET_BITS, -1, np.int64)
        wanted[features], index[features] = True, np.arange(len(features))
        _, _, data_, offsets = next(V.chunks(pa.array(lexicon), 1 << 30))
        bucket, word = ngram_buckets(data_, offsets, wanted)
        more = np.unique(word * np.int64(len(features)) + index[bucket])
        rows_, cols_ = np.concatenate([at, len(y) + more // len(features)]), np.concatenate([cols, more % len(features)])
        weights, intercept = fit_logistic(rows_, cols_, np.concatenate([y, np.ones(len(lexicon))]), len(features))
    return Model(features, weights, intercept, trigram_model(counts, spoken))


def _lexicon(features: np.ndarray, weights: np.ndarray):
    """Document frequencies by label of words in which n-grams of high weight stand."""
    strong = np.zeros(1 << BUCKET_BITS, bool)
    if len(weights):
        strong[features[weights >= max(0.1, np.quantile(weights, 0.5))]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[dict[str, int]] = [{}, {}]
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in V.chunks(batch.column(0), PIECE):
                _, owner = ngram_buckets(data, offsets, strong)
                for i in np.unique(owner).tolist():
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    words = list({w.strip(".,!?;:#$%&*") for w in text.lower().split()} - {""})
                    if words:
                        _, _, bytes_, at = next(V.chunks(pa.array(words), 1 << 30))
                        for k in np.unique(ngram_buckets(bytes_, at, strong)[1]).tolist():
                            of = counts[int(toxic[lo + i])]
                            of[words[k]] = of.get(words[k], 0) + 1
        every = sorted({*counts[0], *counts[1]})
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([counts[k].get(w, 0) for w in every], pa.int64()) for k in (1, 0)]], names=["word", "toxic", "clean"])

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of all rows of docs."""
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.trigrams)
        for batch in batches:
            size = max(1, (1 << 22) * batch.num_rows // max(1, batch.nbytes))
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1), restorer))], names=["doc_id", "score"])

    return kept.mapInArrow(run, "doc_id bigint, score double")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
