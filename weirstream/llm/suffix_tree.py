"""Operator 3: language-model scoring by a probabilistic suffix tree over the symbols of a text.

Symbols are the bytes of the lower-cased words, a space between words and an end mark. From the training rows every context
of up to DEPTH symbols is counted with what follows it. A context is retained as a state if it occurs at least LEAST_COUNT
times and its next-symbol distribution diverges from that of its longest retained suffix by at least DIVERGENCE
nats for each distinct symbol that follows. Distributions are smoothed by absolute discounting towards the suffix. Each symbol
is scored at the longest suffix of what precedes it that is a state; score is the sum of log10 probabilities, a proper
distribution over sequences of words.

The tree is never gathered: it grows with the text and lies in buckets by the three nearest symbols of a context. Each part
of the input is cut into blocks of so many bytes as it is read, whatever its ids; a block sends each bucket its distinct
contexts with the symbol that follows and their number in training rows (0 if none), and the bucket, which sees all counts
below its contexts, answers with a log-probability for each. Blocks are written with their texts, and a block finds its
distinct contexts again from these, so answers carry no keys.

Beside it stands a unigram word model over the same training rows, by the same way: a block sends its distinct words to buckets
by ranges of their hashes, and gets their exact counts back in order.

Defined cases: null and empty texts are the end mark alone; a null doc_id is kept (for the query's folds it counts as the
empty string) and scored like others; repeated rows count and score each; without training rows the suffix tree is uniform and unigram counts are 0; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import materialise, small_batches, table

DEPTH = 6
#: Occurrences that a context needs at any size of the corpus; the divergence test guards what is significant.
LEAST_COUNT = 2
DIVERGENCE = 2.0
DISCOUNT = 0.5
#: Bytes of text in a block of documents that is counted and looked up together.
BLOCK_BYTES = 12 << 20
#: Bytes of text that are turned into symbols at once, and contexts that are sorted at once.
PIECE_BYTES, SORTED = 1 << 19, 2_000_000
#: Contexts, not yet merged, that a block holds beside those merged.
HELD = 3_000_000
END, SPACE = 10, 32
#: Symbols: bytes but for white space, which becomes a space; line feed serves as the end mark.
ALPHABET = 256 - 4
_ZSTD = pa.Codec("zstd", compression_level=1)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbol stream of some texts, each after DEPTH end marks, which parts are to be predicted, and each text's begin."""
    low = V.LOWERED[data]
    word = V.IS_WORD[low]
    after = np.zeros(len(low), bool)  # whether the byte before, in the same text, is of a word
    after[1:] = word[:-1]
    after[offsets[:-1][offsets[:-1] < len(low)]] = False
    # of white space, the first byte after a word stays: a space, or the end mark after the last word
    kept = np.flatnonzero(word | after)
    values = np.where(word[kept], low[kept], np.uint8(SPACE))
    first = np.searchsorted(kept, offsets)
    n = np.diff(first)
    open_end = n == 0
    open_end[n > 0] = word[kept[first[1:][n > 0] - 1]]
    begin = np.concatenate([[0], np.cumsum(n + open_end + DEPTH)])
    out = np.full(begin[-1], END, np.uint8)
    out[np.arange(len(kept)) + np.repeat(begin[:-1] + DEPTH - first[:-1], n)] = values
    out[begin[1:] - 1] = END
    predicted = np.ones(begin[-1], bool)
    for k in range(DEPTH):
        predicted[begin[:-1] + k] = False
    return out, predicted, begin


def context_keys(stream: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """For each predicted symbol its DEPTH predecessors, the nearest in the highest byte, and itself in the lowest."""
    if len(stream) <= DEPTH:
        return np.zeros(0, V.U)
    # eight bytes at every place, read as one little-endian number: the oldest of DEPTH symbols lowest, the next one above the nearest
    padded = np.concatenate([stream, np.zeros(8, np.uint8)])
    key = np.ndarray((len(stream) - DEPTH,), "<u8", padded, strides=(1,)) & V.U((1 << (8 * DEPTH)) - 1)
    key <<= V.U(8)
    key |= stream[DEPTH:]
    return key[predicted[DEPTH:]]


def _packed_floats(x: np.ndarray) -> bytes:
    return _ZSTD.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unpacked_floats(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(data, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.float32).ravel()


def run_counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their number or summed weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)


def flagged_counts(keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct context keys, sorted, with the number of those that are marked: one sort, the mark in a bit that keys leave free."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    both = (keys << V.U(1)) | own.astype(V.U)
    both.sort()
    key = both >> V.U(1)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(both & V.U(1), first).view(np.int64)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, byte plane by byte plane, compressed."""
    n = np.int64(len(keys)).tobytes()
    planes = np.concatenate([np.diff(keys, prepend=V.U(0)).view(np.uint8).reshape(-1, 8).T.ravel(), counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.ravel()])
    return n + _ZSTD.compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    planes = np.frombuffer(_ZSTD.decompress(blob[8:], 16 * n, asbytes=True), np.uint8).reshape(2, 8, n)
    back = [np.ascontiguousarray(p.T).view(V.U).ravel() for p in planes]
    return np.cumsum(back[0], dtype=V.U), back[1].astype(np.int64)


def merged(parts: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts (sorted, distinct each), with summed counts; at most so many keys wait beside those merged,
    or as many as these."""

    def joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if len(held) == 1:
            return held[0]
        every = np.sort(np.concatenate([k for k, _ in held]))
        every = every[np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))] if len(every) else every
        total = np.zeros(len(every), np.int64)
        for k, c in held:
            total[np.searchsorted(every, k)] += c
        return every, total

    held, waiting = [(np.zeros(0, V.U), np.zeros(0, np.int64))], 0
    for part in parts:
        held.append(part)
        waiting += len(part[0])
        if waiting > max(most, len(held[0][0])):
            held, waiting = [joined(held)], 0
    return joined(held)


def block_keys(texts: pa.ChunkedArray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts of a block with the next symbol, and their number in training rows."""

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, own, size = [], [], 0
        for lo, hi, data, offsets in V.chunks(texts, PIECE_BYTES):
            stream, predicted, begin = symbols(data, offsets)
            keys.append(context_keys(stream, predicted))
            own.append(np.repeat(train[lo:hi], np.diff(begin) - DEPTH))
            size += len(keys[-1])
            if size >= SORTED:
                yield flagged_counts(np.concatenate(keys), np.concatenate(own))
                keys, own, size = [], [], 0
        if keys:
            yield flagged_counts(np.concatenate(keys), np.concatenate(own))

    return merged(parts(), HELD)


class Places:
    """Finds where keys stand in an array of distinct ones, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, int(4 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, step = np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            slot = self._slot(keys[left], step)
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            left, step = left[self.table[slot] != left], step + 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys * V.U(0x9E3779B97F4A7C15) >> V.U(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def of(self, asked: np.ndarray) -> np.ndarray:
        """The places of asked keys, all of which must be there."""
        at = self.table[self._slot(asked, 0)]
        wrong, step = np.flatnonzero(self.keys[at] != asked), 1
        while len(wrong):
            some = self.table[self._slot(asked[wrong], step)]
            at[wrong] = some
            wrong, step = wrong[self.keys[some] != asked[wrong]], step + 1
        return at


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted keys by bucket, then key, and where each bucket begins in it."""
    # three nearest symbols decide the bucket, so suffixes of three symbols and more meet
    to = (V.mixed(keys >> V.U(8 * (DEPTH - 2))) % V.U(buckets)).astype(np.int16 if buckets < 1 << 15 else np.int32)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(buckets + 1))


#: The kinds of rows of the first pass: texts with their block, packed context counts by bucket (-1: contexts of up to two
#: symbols), and packed word counts by bucket.
TEXT, CONTEXTS, WORDS = range(3)
DEALT = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("text", pa.string()), ("bucket", pa.int32()), ("blob", pa.binary())])
DEALT_SQL = "kind int, block bigint, doc_id bigint, train boolean, text string, bucket int, blob binary"


def _dealt_rows(kind: int, block: int, size: int, **columns: pa.Array) -> pa.RecordBatch:
    known = {"kind": pa.array(np.full(size, kind, np.int32)), "block": pa.array(np.full(size, block, np.int64)), **columns}
    return pa.RecordBatch.from_arrays([known[f.name] if f.name in known else pa.nulls(size, f.type) for f in DEALT], schema=DEALT)


def _packed_rows(kind: int, block: int, blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return _dealt_rows(kind, block, len(blobs), bucket=pa.array([b for b, _ in blobs], pa.int32()), blob=pa.array([x for _, x in blobs], pa.binary()))


def word_ends(words: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, a range of hashes, begins among sorted words, and their end."""
    firsts = [V.U(-(-(b << 64) // buckets)) for b in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(words, np.array(firsts, V.U)), [len(words)]])


def _block_words(texts: pa.ChunkedArray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a block and their number in training rows."""

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo, hi, data, offsets in V.chunks(texts, 8 * PIECE_BYTES):
            hashes, first = V.word_hashes(data, offsets)
            own = np.repeat(train[lo:hi], np.diff(first))
            yield run_counts(hashes[own])
            rest = run_counts(hashes[~own])[0]
            yield rest, np.zeros(len(rest), np.int64)

    return merged(parts(), HELD)


def _deal(buckets: int):
    """Deals the rows of a part into blocks of BLOCK_BYTES (one text may be longer) as they come, and counts each block."""

    def counted(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.chunked_array([b.column(2) for b in held])
        train = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held])
        words, n = _block_words(texts, train)
        ends = word_ends(words, buckets)
        yield _packed_rows(WORDS, block, [(b, pack(words[lo:hi], n[lo:hi])) for b, (lo, hi) in enumerate(zip(ends, ends[1:])) if hi > lo])
        del words, n
        keys, counts = block_keys(texts, train)
        order, ends = by_bucket(keys, buckets)
        blobs = [(b, pack(keys[order[lo:hi]], counts[order[lo:hi]])) for b, (lo, hi) in enumerate(zip(ends, ends[1:])) if hi > lo]
        top = ((keys >> V.U(8 * (DEPTH - 1))) << V.U(8)) | (keys & V.U(255))
        blobs.append((-1, pack(*run_counts(top, counts))))
        yield _packed_rows(CONTEXTS, block, blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)) if batch.num_rows else np.zeros(0, np.int64)
            lo = 0
            while lo < batch.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = int(np.searchsorted(ends, before + BLOCK_BYTES - size, side="right"))
                if hi == lo and held:  # the next text does not fit
                    yield from counted(block, held)
                    block, held, size = block + 1, [], 0
                    continue
                hi = max(hi, lo + 1)
                part = batch.slice(lo, hi - lo)
                yield _dealt_rows(TEXT, block, hi - lo, doc_id=part.column(0), train=part.column(1), text=part.column(2))
                held.append(part)
                size, lo = size + int(ends[hi - 1]) - before, hi
        if held:
            yield from counted(block, held)

    return run


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return merged((unpack(blob.as_py()) for blob in group.column("blob")), HELD)


def _sum_blobs(group: pa.Table) -> pa.Table:
    return pa.table([pa.array([0], pa.int32()), pa.array([pack(*_merged(group))], pa.binary())], names=["slot", "blob"])


def summed(blobs: DataFrame, n_blobs: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of packed counts in two levels of about the root of their number, so that no task reads them all."""
    slots = max(1, math.isqrt(n_blobs))
    half = blobs.groupBy(F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot")).applyInArrow(_sum_blobs, "slot int, blob binary")
    whole = half.groupBy("slot").applyInArrow(_sum_blobs, "slot int, blob binary").first()
    return unpack(bytes(whole["blob"])) if whole else (np.zeros(0, V.U), np.zeros(0, np.int64))


def at_depth(keys: np.ndarray, counts: np.ndarray, depth: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (nearest `depth` symbols, next symbol) from those with `of` symbols."""
    return run_counts(((keys >> V.U(8 * (of - depth + 1))) << V.U(8)) | (keys & V.U(255)), counts)


def grow(keys, counts, low_keys, low_p, low: int, high: int, least: float, *, listed: bool = True):
    """Given smoothed probabilities at depth low: the states of depth low+1 .. high, if listed, as (depth, context, gain, nexts,
    counts), and the keys at depth high with their smoothed probabilities. Keys of count 0 are no evidence but get theirs."""
    found = []
    of = DEPTH if high == DEPTH else high
    for depth in range(low + 1, high + 1):
        k, c = at_depth(keys, counts, depth, of)
        context = k >> V.U(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        size = np.diff(np.append(first, len(k)))
        seen = c > 0
        kinds = np.add.reduceat(seen.astype(np.int64), first)
        total = np.add.reduceat(c, first)
        row = np.repeat(np.arange(len(first)), size)
        parent = ((context >> V.U(8)) << V.U(8)) | (k & V.U(255))
        p = low_p[np.searchsorted(low_keys, parent)]
        gain = np.add.reduceat(c * np.log(np.where(seen, c / np.maximum(total, 1)[row] / p, 1.0)), first)
        keep = (total >= least) & (gain >= DIVERGENCE * kinds)
        smooth = (c - DISCOUNT * seen + DISCOUNT * kinds[row] * p) / np.maximum(total, 1)[row]
        for i in np.flatnonzero(keep) if listed else ():
            part = first[i] + np.flatnonzero(seen[first[i] : first[i] + size[i]])
            found.append((depth, int(context[first[i]]), float(gain[i]), (k[part] & V.U(255)).astype(np.uint8).tobytes(), c[part].tobytes()))
        low_keys, low_p = k, np.where(keep[row], smooth, p)
    return found, low_keys, low_p


def _answers(low_keys: np.ndarray, low_p: np.ndarray):
    """For each block the log-probabilities of what it asks of a bucket, in the order of its keys."""

    def run(group: pa.Table) -> pa.Table:
        _, keys, p = grow(*_merged(group), low_keys, low_p, 2, DEPTH, LEAST_COUNT, listed=False)
        logp = np.log10(p).astype(np.float32)
        out = []
        for blob in group.column("blob"):
            part = logp[np.searchsorted(keys, unpack(blob.as_py())[0])]
            out.append(_packed_floats(part))
        n = pa.array([int(np.frombuffer(x.as_py()[:8], np.int64)[0]) for x in group.column("blob")], pa.int64())
        return pa.table([group.column("block"), group.column("bucket"), n, pa.array(out, pa.binary())], names=["block", "bucket", "n", "logp"])

    return run


def _packed_numbers(n: np.ndarray) -> bytes:
    return _ZSTD.compress(n.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def _unpacked_numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_ZSTD.decompress(data, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _word_answers(group: pa.Table) -> pa.Table:
    """For each block the counts of the words that it sent, in their order; and with block -1 the bucket's sum and kinds."""
    words, total = _merged(group)
    out = [(-1, 2, _packed_numbers(np.array([total.sum(), (total > 0).sum()])))]
    for block, blob in zip(group.column("block").to_pylist(), group.column("blob")):
        n = total[np.searchsorted(words, unpack(blob.as_py())[0])]
        out.append((block, len(n), _packed_numbers(n)))
    bucket = pa.array(np.full(len(out), group.column("bucket")[0].as_py(), np.int32))
    return pa.table([pa.array([x[0] for x in out], pa.int64()), bucket, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["block", "bucket", "n", "counts"])


def tree_scores(texts: pa.ChunkedArray, train: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """Sums of log10 probabilities by text, from the answers of the buckets to this block."""
    keys, _ = block_keys(texts, train)
    order, ends = by_bucket(keys, buckets)
    logp = np.full(len(keys), np.nan, np.float32)
    for bucket, n, data in zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "logp"))):
        logp[order[ends[bucket] : ends[bucket + 1]]] = _unpacked_floats(data, n)
    if np.isnan(logp).any():
        raise ValueError("a block lacks answers to what it asked")
    del order
    places, out = Places(keys), [np.zeros(0)]
    for _, _, data, offsets in V.chunks(texts, PIECE_BYTES):
        stream, predicted, begin = symbols(data, offsets)
        flat = logp[places.of(context_keys(stream, predicted))].astype(float)
        out.append(np.add.reduceat(flat, begin[:-1] - DEPTH * np.arange(len(begin) - 1)))
    return np.concatenate(out)


def root_probabilities(counts: np.ndarray) -> np.ndarray:
    p = (counts + 0.5) / (counts.sum() + 0.5 * ALPHABET)
    p[[9, 11, 12, 13]] = 0.0
    return p


class Automaton:
    """Longest-suffix automaton of a small tree, for each node and symbol class the log10 probability and the next node: the plain
    form of what the buckets answer."""

    def __init__(self, states: list[tuple[int, int, float, bytes, bytes]], root: np.ndarray):
        # contexts arrive nearest symbol first; in the trie the oldest comes first
        known = {bytes(c.to_bytes(d, "big"))[::-1]: (np.frombuffer(n, np.uint8), np.frombuffer(k, np.int64)) for d, c, _, n, k in states}
        used = np.zeros(256, bool)
        for context, (nexts, _) in known.items():
            used[list(context)] = True
            used[nexts] = True
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, used.sum() + 1)
        width = int(used.sum()) + 1
        trie: dict[bytes, int] = {b"": 0}
        for context in sorted(known, key=len):
            for i in range(1, len(context) + 1):
                trie.setdefault(context[:i], len(trie))
        order = sorted(trie, key=len)
        number = {s: i for i, s in enumerate(order)}
        children: dict[bytes, list[bytes]] = {}
        for s in order[1:]:
            children.setdefault(s[:-1], []).append(s)
        self.next = np.zeros((len(order), width), np.int32)
        p = np.zeros((len(order), width), np.float32)
        symbol = np.flatnonzero(used)
        p[0, 1:] = root[symbol]
        # class 0: bytes never seen in a state, each with its own small share of the root
        rest = np.ones(256, bool)
        rest[symbol] = False
        rest[[9, 11, 12, 13]] = False
        p[0, 0] = root[rest].mean() if rest.any() else 1e-12
        fail = np.zeros(len(order), np.int64)
        for i, s in enumerate(order):  # by length, so a node's failure and its row are complete before its children's
            if i:
                above = number[s[:-1]]
                f = fail[i] = self.next[fail[above], self.classes[s[-1]]] if len(s) > 1 else 0
                p[i] = p[f]
                if s in known:
                    nexts, n = known[s]
                    total, kinds = n.sum(), len(n)
                    p[i] = p[f] * (DISCOUNT * kinds / total)
                    p[i, self.classes[nexts]] += (n - DISCOUNT) / total
                self.next[i] = self.next[f]
            for child in children.get(s, ()):
                self.next[i, self.classes[child[-1]]] = number[child]
        np.maximum(p, np.float32(1e-38), out=p)
        self.logp = np.log10(p, out=p)

    def score(self, stream: np.ndarray, predicted: np.ndarray, begin: np.ndarray, column: int = 256) -> np.ndarray:
        """Sums of log10 probabilities by text: the stream is cut in columns that are walked side by side."""
        width = self.next.shape[1]
        step, logp = self.next.ravel(), self.logp.ravel()
        n = len(stream)
        cols = -(-n // column)
        padded = np.full(DEPTH + cols * column, END, np.uint8)
        padded[DEPTH : DEPTH + n] = stream
        classes = self.classes[padded]
        out = np.zeros((column, cols), np.float32)
        state = np.zeros(cols, np.int32)
        at = np.arange(cols) * column
        for t in range(DEPTH + column):
            index = state * width + classes[at + t]
            if t >= DEPTH:
                out[t - DEPTH] = logp[index]
            state = step[index]
        flat = out.T.ravel()[:n].astype(np.float64)
        flat[~predicted] = 0.0
        return np.add.reduceat(flat, begin[:-1])


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); train: a column, true for training rows."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), train.alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes, ends = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("int")), F.lit(0))).first()
    buckets = int(max(32, n_bytes // (64 << 20)))
    dealt = materialise(rows.mapInArrow(_deal(buckets), DEALT_SQL), "blocks", compression="zstd")
    left = dealt.where(F.col("kind") == TEXT).select("block", "doc_id", "train", "text")
    blobs = dealt.where(F.col("kind") == CONTEXTS).select("block", "bucket", "blob")

    words = dealt.where(F.col("kind") == WORDS).select("block", "bucket", "blob")
    counted = materialise(words.groupBy("bucket").applyInArrow(_word_answers, "block bigint, bucket int, n bigint, counts binary"), "words")
    tokens, kinds = int(ends), int(ends > 0)
    for r in counted.where("block < 0").collect():  # a row for each bucket
        some = _unpacked_numbers(bytes(r["counts"]), 2)
        tokens, kinds = tokens + int(some[0]), kinds + int(some[1])

    short = blobs.where("bucket < 0")
    keys, counts = summed(short, short.count())
    root = root_probabilities(np.bincount((keys & V.U(255)).astype(np.int64), counts, minlength=256))
    low_keys, low_p = keys, np.zeros(0)  # contexts of up to two symbols: at most 2**24 keys
    if len(keys):
        _, low_keys, low_p = grow(keys, counts, np.arange(256, dtype=V.U), root, 0, 2, LEAST_COUNT, listed=False)
    answers = blobs.where("bucket >= 0").groupBy("bucket").applyInArrow(_answers(low_keys, low_p), "block bigint, bucket int, n bigint, logp binary")

    log_total = np.log10(tokens + 0.1 * (kinds + 1))

    def block_scores(texts: pa.Table, known: pa.Table) -> pa.Table:
        answered = known.filter(pc.is_valid(known.column("logp")))
        counts = known.filter(pc.is_valid(known.column("counts"))).sort_by("bucket")
        words_ = _block_words(texts.column("text"), np.zeros(len(texts), bool))[0]
        n = np.concatenate([np.zeros(0, np.int64), *[_unpacked_numbers(x, k) for x, k in zip(counts.column("counts").to_pylist(), counts.column("n").to_pylist())]])
        if len(n) != len(words_):
            raise ValueError("a block lacks counts of what it asked")
        out: list[list[np.ndarray]] = [[], [], []]
        for _, _, data, offsets in V.chunks(texts.column("text"), 8 * PIECE_BYTES):
            hashes, first = V.word_hashes(data, offsets)
            c = n[np.searchsorted(words_, hashes)] if len(hashes) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            size = np.diff(first) + 1
            out[0].append(size)
            out[1].append(np.bincount(row, c > 0, minlength=len(size)).astype(np.int64) + (ends > 0))
            out[2].append(np.bincount(row, np.log10(c + 0.1), minlength=len(size)) + np.log10(ends + 0.1) - size * log_total)
        trees = tree_scores(texts.column("text"), texts.column("train").to_numpy(), answered, buckets)
        cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table(
            [texts.column("doc_id"), pc.invert(texts.column("train")), pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(np.full(len(cols[0]), tokens)), pa.array(cols[2]), pa.array(trees)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    nothing = F.lit(None).cast("binary")
    right = counted.where("block >= 0").select(F.col("block").alias("at"), "bucket", "n", "counts", nothing.alias("logp"))
    right = right.unionByName(answers.select(F.col("block").alias("at"), "bucket", "n", nothing.alias("counts"), "logp"))
    return left.groupBy("block").cogroup(right.groupBy("at")).applyInArrow(block_scores, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return score_texts(table(spark, sf_dir, "documents"), train=F.pmod(F.crc32(text_id), F.lit(10)) != 0)
