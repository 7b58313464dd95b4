"""Byte-pair encoding of whole columns with a public vocabulary, in numpy.

Texts are cut into words by vectorised character classes (letters, digits, white space, the rest), so a
batch of documents is one array operation.  Words not seen before in the batch are encoded together:
they are bucketed by length into padded matrices, and in every round each row merges its leftmost pair
of least rank; pairs are looked up in an open-addressing hash table, and rows that have no pair left
leave the matrix.  A word too wide to share one is a matrix of one row, in which all places of the least pair merge
in one round, with the same result.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Widest word, in bytes, that is encoded in a matrix.
MATRIX_WIDTH = 160
#: Cells of one matrix.
MATRIX_CELLS = 1 << 19
_NONE = np.int32(2**31 - 1)

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
# The contractions of the public pre-tokenizer's pattern.
_SHORT = ("s", "d", "m", "t")
_LONG = ("ll", "ve", "re")
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """The class of each code point by its Unicode category."""
    global _classes
    if _classes is None:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        by_category = {"L": LETTER, "N": DIGIT}
        for cp in range(sys.maxunicode + 1):
            found = by_category.get(unicodedata.category(chr(cp))[0])
            if found is not None:
                table[cp] = found
        for cp in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            table[cp] = SPACE
        _classes = table
    return _classes


def word_bounds(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Starts of the words of `points` (code points); no word crosses a position of `breaks` (text starts)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    cls = _class_table()[points]
    text_start = np.zeros(n, bool)
    text_start[breaks[breaks < n]] = True
    run_start = text_start.copy()
    run_start[1:] |= cls[1:] != cls[:-1]
    is_space = cls == SPACE
    # The last white space of a run before other characters: a plain space joins the next word, anything else stands alone.
    next_ends = np.ones(n, bool)
    next_ends[:-1] = run_start[1:]
    at_text_end = np.ones(n, bool)
    at_text_end[:-1] = text_start[1:]
    last_space = is_space & next_ends & ~at_text_end
    start = run_start.copy()
    start |= last_space
    joins = last_space & (points == 32)
    start[1:] &= ~joins[:-1] | text_start[1:]
    # An apostrophe that begins a word, before s, d, m, t, ll, ve or re.
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        cut = np.concatenate([text_start, np.ones(2, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        ok1 = ~cut[quote + 1] & np.isin(one, [ord(c) for c in _SHORT])
        ok2 = np.zeros(len(quote), bool)
        for pair in _LONG:
            ok2 |= (one == ord(pair[0])) & (two == ord(pair[1]))
        ok2 &= ~cut[quote + 1] & ~cut[quote + 2]
        for hit, width in ((quote[ok1], 2), (quote[ok2 & ~ok1], 3)):
            start[hit + 1] = False
            after = hit + width
            start[after[after < n]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of byte strings, as two hash tables that can be broadcast (their size is that of the vocabulary)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(2, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        pending, values, slots = keys, np.array(merged, np.int32), self._slot(keys)
        self.probes = 0
        while len(pending):
            self.probes += 1
            free = self.keys[slots] == -1
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            first = first[free[first]]
            self.keys[slots[first]], self.values[slots[first]] = pending[first], values[first]
            rest = np.ones(len(pending), bool)
            rest[first] = False
            pending, values, slots = pending[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a file of base64 tokens and ranks, one a line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))})

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank, which is also the id, that each pair merges to; the largest int32 for none."""
        keys = left.astype(np.int64) * self.size + right
        out = np.full(keys.shape, _NONE, np.int32)
        slots = self._slot(keys)
        found = self.keys[slots]
        hit = found == keys
        out[hit] = self.values[slots[hit]]
        open_at = np.flatnonzero(~hit & (found != -1))
        while len(open_at):
            slots[open_at] = (slots[open_at] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_at]]
            hit = found == keys[open_at]
            out[open_at[hit]] = self.values[slots[open_at[hit]]]
            open_at = open_at[~hit & (found != -1)]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and the number of ids of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # word numbers, counts, flat ids
        order = np.argsort(lengths, kind="stable")
        narrow = order[(lengths[order] > 0) & (lengths[order] <= MATRIX_WIDTH)]
        at = 0
        while at < len(narrow):
            # A bucket holds words whose lengths differ by an eighth at most.
            width = int(lengths[narrow[at]]) + max(2, int(lengths[narrow[at]]) // 8)
            stop = int(np.searchsorted(lengths[narrow], width, side="right"))
            stop = min(stop, at + max(1, MATRIX_CELLS // width))
            chosen = narrow[at:stop]
            parts.append((chosen, *self._matrix([words[i] for i in chosen])))
            at = stop
        for i in order[lengths[order] > MATRIX_WIDTH]:
            ids = self._wide(words[i])
            parts.append((np.array([i]), np.array([len(ids)]), ids))
        counts = np.zeros(len(words), np.int64)
        for chosen, n, _ in parts:
            counts[chosen] = n
        starts = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(starts[-1], np.int32)
        for chosen, n, ids in parts:
            flat[np.repeat(starts[chosen], n) + _within(n)] = ids
        return flat, counts

    def _matrix(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        rows, width = len(words), int(lengths.max())
        ids = np.full((rows, width), -1, np.int32)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((rows, width), _NONE, np.int32)
        both = inside[:, 1:]
        ranks[:, :-1][both] = self.pair_ranks(ids[:, :-1][both], ids[:, 1:][both])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        alive, length = np.arange(rows), lengths.copy()
        while len(alive):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            row = np.arange(len(alive))
            best = ranks[row, at]
            ends = best == _NONE
            if ends.any():
                done.append((alive[ends], _pack(ids[ends], length[ends])))
                keep = ~ends
                alive, ids, ranks, length, at, best = alive[keep], ids[keep], ranks[keep], length[keep], at[keep], best[keep]
                if not len(alive):
                    break
                row = np.arange(len(alive))
            ids[row, at] = best
            # Compaction: drop the merged right half of every row.
            left = np.ones(ids.shape, bool)
            left[row, at + 1] = False
            ids, ranks = ids[left].reshape(len(alive), -1), ranks[left].reshape(len(alive), -1)
            length -= 1
            has_next = at + 1 < length
            ranks[row, at] = _NONE
            r, p = row[has_next], at[has_next]
            ranks[r, p] = self.pair_ranks(ids[r, p], ids[r, p + 1])
            r, p = row[at > 0], at[at > 0]
            ranks[r, p - 1] = self.pair_ranks(ids[r, p - 1], ids[r, p])
            widest = int(length.max())
            if widest < ids.shape[1]:
                ids, ranks = ids[:, :widest], ranks[:, :widest]
        counts = np.zeros(rows, np.int64)
        for who, packed in done:
            counts[who] = np.diff(packed[1])
        starts = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(starts[-1], np.int32)
        for who, packed in done:
            n = np.diff(packed[1])
            flat[np.repeat(starts[who], n) + _within(n)] = packed[0]
        return counts, flat

    def _wide(self, word: bytes) -> np.ndarray:
        """A matrix of one wide row, which merges all places of its least pair each round.

        A pair with a merged token has a greater rank than that token, so the places of the least pair are the next
        merges in any case, from the left; of places that overlap every second one is left over.
        """
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].astype(np.int32)
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == best)
            begin = np.append(True, np.diff(at) > 1)
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))) % 2 == 0]
            ids[at] = best
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            here = at - np.arange(len(at))
            for p in (here[here < len(ranks)], here[here > 0] - 1):
                ranks[p] = self.pair_ranks(ids[p], ids[p + 1])
        return ids

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the offsets (one more than texts)."""
        return Encoder(self).encode_texts(texts)


class Encoder:
    """A vocabulary with the words that it has met; forgets them all once they hold MEMORY ids."""

    MEMORY = 1 << 22

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the offsets (one more than texts)."""
        joined = "".join(texts)
        text_starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = word_bounds(points, text_starts[:-1])
        bounds = [*starts.tolist(), len(joined)]
        words = list(map(joined.__getitem__, map(slice, bounds, bounds[1:])))
        if len(self.flat) > self.MEMORY:
            self._forget()
        fresh = [w for w in dict.fromkeys(words) if w not in self.number]
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
        flat, counts = self.vocabulary.encode_words([w.encode("utf-8", "replace") for w in fresh])
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        word_starts = np.cumsum(self.counts) - self.counts
        n = self.counts[number]
        ids = self.flat[np.repeat(word_starts[number], n) + _within(n)]
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[np.searchsorted(starts, text_starts)]


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each group of a list of group sizes."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _pack(matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.arange(matrix.shape[1]) < lengths[:, None]
    return matrix[inside], np.concatenate([[0], np.cumsum(lengths)])


def _chunks(column: pa.Array, limit: int = 1 << 21) -> Iterator[list[str]]:
    """Texts of a column in groups of about `limit` characters; null becomes empty."""
    group, size = [], 0
    for text in column.to_pylist():
        text = text or ""
        group.append(text)
        size += len(text)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_column(rows: DataFrame, key: str, text: str, vocabulary_path: str, lengths_only: bool = False) -> DataFrame:
    """`key` and ids (array of int), or `key` and n_tokens, of every row.

    An empty and a null text both give the empty list.  Nothing is shuffled: each partition encodes its own rows.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary_path))  # bounded by the vocabulary: some 10 MB for 50,000 tokens
    chosen = rows.select(key, text)
    key_type = chosen.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, " + ("n_tokens int" if lengths_only else "ids array<int>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            at = 0
            for group in _chunks(batch.column(1)):
                ids, offsets = encoder.encode_texts(group)
                keys = batch.column(0).slice(at, len(group))
                at += len(group)
                if lengths_only:
                    value = pa.array(np.diff(offsets).astype(np.int32))
                else:
                    value = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys, value], names=[key, "n_tokens" if lengths_only else "ids"])

    return chosen.mapInArrow(run, schema)
