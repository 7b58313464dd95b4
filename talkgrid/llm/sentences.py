"""Sentence ends in many languages and scripts, by a hidden-event n-gram language model.

Between two visible characters a boundary token may stand, whether or not a mark shows it.  The model knows how
often each stretch of characters stands before and after boundaries (n-grams of several lengths, backed off to
shorter ones).  The boundary token is a token of the n-grams: where one stands among the characters before a gap,
the n-gram begins with it.  So the hidden state at a gap is how many characters there are since the last
boundary, up to the length at which it leaves the n-grams; a boundary leads back to the beginning.  Together with
what the gap itself shows (marks, white space, quotes; log-odds set by hand) this is a chain, and forward and
backward sums over it give each gap's posterior.

The counts come from all texts, each delivery once: certain marks, ends and beginnings
of texts are boundaries, gaps inside clauses are none, doubtful gaps are not counted.  As marks are not
part of the n-grams, what is learned where they are written holds where they are missing, and in scripts
that have none.

Counts are hashed into tables of fixed size, so the model can be broadcast whatever the corpus's size; rare n-grams
of a very large corpus share entries.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talkgrid.llm.spans import _Hashes
from talkgrid.operators.durable import cut_lineage
from talkgrid.llm.turns import automaton, head_speaker, spans

ORDERS = (1, 2, 4, 7)
#: log2 of the entries of each table; there are two tables for each order.
BITS = 18
#: Weight of the shorter n-gram in the backed-off estimate.
BACKOFF = 2.0
#: States of the chain: characters since the last boundary, the last for as many or more.
STATES = 4

_STRONG = frozenset("。｡！？!?।॥؟")
_PERIOD, _DOTS, _COMMA = frozenset(".．"), frozenset("…‥"), frozenset("、､，,;；:：")
_OPENING, _CLOSING = frozenset("「『“«‹《｢"), frozenset("」』”»›》｣")
_JOINED_SCRIPTS = ((0x0030, 0x0E00), (0x1E00, 0x2000), (0xFF10, 0xFF5B))


# Codes of characters: white space and invisible ones, marks, visible ones by themselves, visible ones of scripts
# that part words by spaces, and combining marks of those scripts and of others.
_BLANK, _MARK, _SINGLE, _JOINED, _JOINED_COMBINING, _COMBINING = range(6)


class _Codes(dict):
    """Character to code, worked out when first met."""

    def __missing__(self, cp: int) -> str:
        ch, category = chr(cp), unicodedata.category(chr(cp))
        joined = any(lo <= cp < hi for lo, hi in _JOINED_SCRIPTS)
        if ch.isspace() or category in ("Cf", "Cc", "Cs"):
            code = _BLANK
        elif category[0] == "M":
            code = _JOINED_COMBINING if joined else _COMBINING
        elif category[0] in "LN":
            code = _JOINED if joined else _SINGLE
        else:
            code = _MARK
        self[cp] = chr(code)
        return self[cp]


class _Folds(dict):
    """Character to the one that stands for it in n-grams: digits are one, widths are folded."""

    def __missing__(self, cp: int) -> str:
        ch = unicodedata.normalize("NFKC", chr(cp))[:1] or chr(cp) if cp > 0xFF00 else chr(cp)
        self[cp] = "0" if ch.isdigit() else ch
        return self[cp]


_codes, _folds = _Codes(), _Folds()
#: Marks that begin what follows them.
_LEADING = frozenset("¿¡(（[［【〈<＜@＠#＃+＋*＊・•$¥€£")
_QUOTES = _OPENING | _CLOSING | {'"'}
#: Log-odds of a boundary between two characters with nothing between them.
BARE = -4.5


class Batch:
    """The gaps of many texts in arrays: places in the texts, what the gaps show, and the n-grams around them.

    The texts are joined, so that all but the doubtful gaps are found by array operations over all of them.
    """

    def __init__(self, texts: list[str], found):
        joined = "\x00".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        codes = np.frombuffer(joined.translate(_codes).encode("latin-1"), np.uint8)
        shown = np.flatnonzero(codes != _BLANK)
        last = np.searchsorted(shown, starts + sizes) - 1
        has = (last >= 0) & (len(shown) > 0)
        ends = np.where(has, shown[np.maximum(last, 0)] + 1 if len(shown) else 0, 0) - starts
        self.end = np.where(ends > 0, ends, 0)  # the sentence end that every visible text has
        visible = codes >= _SINGLE
        gone: list[list[tuple[int, int]]] = []
        quoted = np.zeros(len(joined), np.int64)
        for text, start in zip(texts, starts.tolist()):
            notes = [(s + start, e + start) for s, e in _noted(text, found)]
            gone.append(notes)
            for s, e in notes:
                visible[s:e] = False
            if not _QUOTES.isdisjoint(text):
                quoted[start : start + len(text)] = _quoted(text)
        at = np.flatnonzero(visible)
        number = np.searchsorted(starts, at, side="right") - 1
        pad = max(ORDERS)
        points = np.zeros(len(at) + 2 * pad * len(texts), np.uint32)
        place_of = np.arange(len(at)) + pad * (2 * number + 1)
        points[place_of] = np.frombuffer(joined.translate(_folds).encode("utf-32-le", "surrogatepass"), np.uint32)[at]
        self.hashes = _Hashes(points)
        before, after = at[:-1], at[1:]
        own = number[:-1] == number[1:] if len(at) else np.zeros(0, bool)
        direct = after - before == 1
        left, right = codes[before], codes[after]
        one_word = (right >= _JOINED_COMBINING) | (right == _JOINED) & ((left == _JOINED) | (left == _JOINED_COMBINING))
        places, shows, labels = after.copy(), np.full(len(after), BARE), np.zeros(len(after), np.int64)
        kept = own & direct & ~one_word & ~(quoted[before] > 0)
        far = np.flatnonzero(own & ~direct)
        # A space after a word of a script that parts words by spaces, outside quotations and notes.
        spaced = (after[far] - before[far] == 2) & (left[far] >= _JOINED) & (left[far] <= _JOINED_COMBINING)
        for k, i, j, n, simple in zip(far.tolist(), (before[far] + 1).tolist(), after[far].tolist(), number[far].tolist(), spaced.tolist()):
            notes = gone[n]
            plain = not (quoted[j] or quoted[i - 1]) and not (notes and _meets(notes, i, j))
            if plain:
                if simple and joined[i] == " ":
                    places[k], shows[k], kept[k] = i, _WORD_GAP, True
                    continue
                # Most other gaps are a single mark.
                known = None if joined[j].islower() else _PLAIN_GAPS.get(joined[i:j])
                if known is not None:
                    places[k], shows[k], labels[k], kept[k] = i + 1, known[0], known[1], True
                    continue
            inside = [(s, e) for s, e in notes if s >= i and e <= j]
            stop = inside[0][0] if inside else j
            place = i
            for m in range(i, stop):  # marks belong to the sentence before, as far as they are visible and open nothing
                ch = joined[m]
                if ch in _OPENING or ch in _LEADING or ch == '"' and m > i and joined[m - 1].isspace():
                    break
                if codes[m] != _BLANK:
                    place = m + 1
            between = [joined[m] for m in range(i, j) if not any(s <= m < e for s, e in inside)] if inside else list(joined[i:j])
            value, label = _evidence(between, joined, i - 1, joined[j], bool(quoted[j] and quoted[j] == quoted[i - 1]), bool(inside), codes)
            places[k], shows[k], labels[k], kept[k] = place, value, label, value > -50
        self.places = (places - starts[number[1:]])[kept] if len(at) else np.zeros(0, np.int64)
        self.shows, self.labels = shows[kept], labels[kept]
        self.at = place_of[1:][kept] if len(at) else np.zeros(0, np.int64)  # of the character after the gap
        self.counts = np.bincount(number[1:][kept], minlength=len(texts)) if len(at) else np.zeros(len(texts), np.int64)
        # The ends of texts end sentences, their beginnings begin them.
        filled = np.bincount(number, minlength=len(texts))
        full = filled > 0
        first = pad * (2 * np.arange(len(texts)) + 1) + np.cumsum(filled) - filled
        self.first, self.last = first[full], (first + filled)[full]
        self.begin = first[number[1:]][kept] if len(at) else np.zeros(0, np.int64)  # of each gap's text

    def buckets(self, at: np.ndarray, order: int, right: bool) -> np.ndarray:
        h = self.hashes.of(at, at + order) if right else self.hashes.of(at - order, at)
        return (h >> np.uint64(64 - BITS)).astype(np.int64)

    def after_boundary(self, at: np.ndarray, since: np.ndarray) -> np.ndarray:
        """Buckets of a boundary token and the `since` characters between it and the gap."""
        h = (self.hashes.of(at - since, at) + np.uint64(0xB0A2D) * (since.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - BITS)).astype(np.int64)

    def known(self) -> np.ndarray:
        """Characters between each gap and the last certain boundary of its text before it."""
        sure = np.maximum.accumulate(np.where(self.labels == 1, self.at, 0))
        before = np.append(0, sure[:-1]) if len(sure) else sure
        return self.at - np.maximum(before, self.begin)


#: What single marks show where no small letter follows: log-odds and label.
_PLAIN_GAPS = {**{c: (9.0, 1, 1) for c in "。｡！？।॥"}, **{c: (-4.5, 0, 1) for c in "、､"}}


#: Log-odds at a space after a word of a script that parts words by spaces.
_WORD_GAP = -6.5


def _meets(gone: list[tuple[int, int]], i: int, j: int) -> bool:
    return any(s < j and e > i for s, e in gone) if gone else False


def _noted(text: str, found) -> list[tuple[int, int]]:
    """Disjoint stretches that belong to the sentence after them: notes, stamps, hesitations and the speaker at the head."""
    marks = spans(text, found)
    head = head_speaker(text, marks)
    gone = [(s, e) for s, e, _ in marks if head is None or s >= head[0]]
    return [(0, head[0]), *gone] if head is not None else gone


def _quoted(text: str) -> np.ndarray:
    """The number of the quotation that each character is in, 0 outside; the marks themselves are outside."""
    out = np.zeros(len(text), np.int64)
    opened, straight, number = [], -1, 0
    for i, ch in enumerate(text):
        if ch not in _QUOTES:
            continue
        if ch == '"':
            if straight < 0:
                straight = i
            else:
                number += 1
                out[straight + 1 : i] = number
                straight = -1
        elif ch in _OPENING:
            opened.append(i)
        elif opened:
            start = opened.pop()
            if not opened:
                number += 1
                out[start + 1 : i] = number
    return out  # a quotation that is never closed is none


def _evidence(between: list[str], text: str, at: int, nxt: str, inside: bool, noted: bool, codes: np.ndarray) -> tuple[float, int]:
    """(log-odds of a boundary that the gap after text[at] shows, label for counting)."""
    if inside:
        return -99.0, 0
    prev = text[at]
    if len(between) == 1 and between[0] in "'’-" and not noted:
        return -99.0, 0
    has = frozenset(between)
    closes = bool(has & _CLOSING) or '"' in has and between.index('"') < len(between) - 1 and not (between[-1] == '"' and between.count('"') == 1)
    space = any(c.isspace() for c in between)
    newline = "\n" in has or "\r" in has
    capital = nxt.isupper() or nxt.istitle()
    lower = nxt.islower()
    if closes and between[-1] in _OPENING | {'"'} and not (has & (_STRONG | _PERIOD)):
        closes = False
    if closes:
        # A quotation that stands alone ends; one inside a sentence goes on.
        marked = bool(has & (_STRONG | _PERIOD | _DOTS))
        if lower and not noted:
            return -14.0, 0
        return (2.0 if capital and marked else 0.5 if newline else -1.5 if marked else -3.0), -1
    if has & _STRONG:
        if lower and not noted and not newline and has & frozenset("!?"):
            return 1.0, -1
        return 9.0, 1
    if newline:
        return 4.0, -1
    if has & _PERIOD and not has & _DOTS and between.count(".") + between.count("．") < 3:
        begin = at
        while begin > 0 and codes[begin - 1] in (_JOINED, _JOINED_COMBINING):
            begin -= 1
        word = text[begin : at + 1]
        short = len(word) <= 2 or any(c.isupper() for c in word[1:])
        if not space and not noted:
            return (1.0, -1) if capital and (prev.isdigit() or len(word) > 2 and prev.islower()) else (-99.0, 0)
        if noted:
            return (3.0 if prev.isdigit() else 5.0 if not short else -1.0), -1
        if not capital:
            return (-3.0, -1) if unicodedata.category(nxt) == "Lo" and not nxt.isdigit() else (-7.0, 0)
        if prev.isdigit():
            return -1.0, -1
        if short:
            return (-8.0 if len(word) == 1 and prev.isupper() else -5.0), -1
        return 3.0, (1 if len(word) > 3 else -1)
    if has & _DOTS or between.count(".") >= 3:
        if lower and not noted:
            return -5.0, -1
        return (0.5 if not noted else 1.0), -1
    if has & _COMMA:
        # Where commas were written for full stops, only what stands on both sides can tell.
        return (-4.5 if has & frozenset("、､") else -9.0), 0
    if "　" in has:
        return 2.5, -1
    if noted:
        return 0.0, -1
    if space:
        if ord(prev) < 0x0E00 or prev.isdigit() or nxt.isdigit():
            return -6.5, 0
        return -0.5, -1
    if has:
        return -4.0, -1
    return BARE, 0


def _tables() -> list[tuple[int, bool]]:
    """Order and side of the tables; one more holds the n-grams that begin with a boundary."""
    return [(order, right) for right in (False, True) for order in ORDERS]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of one partition: table, bucket, boundaries, others."""
    found = automaton()
    size = 1 << BITS
    sums = np.zeros((len(_tables()) + 1, 2, size), np.float64)
    for batch in batches:
        texts = [t for t in batch.column("text").to_pylist() if t and t.strip()]
        for k in range(0, len(texts), 4000):
            b = Batch(texts[k : k + 4000], found)
            for n, (order, right) in enumerate(_tables()):
                for value, row in ((1, 0), (0, 1)):
                    np.add.at(sums[n, row], b.buckets(b.at[b.labels == value], order, right), 1.0)
                np.add.at(sums[n, 0], b.buckets(b.first if right else b.last, order, right), 1.0)
            since = b.known()
            for value, row in ((1, 0), (0, 1)):
                near = (b.labels == value) & (since < STATES) & (since > 0)
                np.add.at(sums[-1, row], b.after_boundary(b.at[near], since[near]), 1.0)
    for n in range(len(sums)):
        seen = np.flatnonzero(sums[n].sum(axis=0))
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), n, np.int32)), pa.array(seen.astype(np.int32)), pa.array(sums[n, 0, seen]), pa.array(sums[n, 1, seen])], names=["t", "bucket", "yes", "no"])


class Model:
    """Log-odds of a boundary by the n-grams before and after a gap."""

    def __init__(self, t: np.ndarray, bucket: np.ndarray, yes: np.ndarray, no: np.ndarray):
        self.yes = np.zeros((len(_tables()) + 1, 1 << BITS), np.float32)
        self.no = np.zeros_like(self.yes)
        self.yes[t, bucket], self.no[t, bucket] = yes, no
        one = self.yes[0].sum(), self.no[0].sum()
        self.base = float((one[0] + 1) / (one[0] + one[1] + 20))

    @classmethod
    def of(cls, texts: DataFrame) -> Model:
        """Counts over all rows of `texts` (a column text); the driver receives at most the tables' fixed size."""
        counted = texts.select("text").mapInArrow(_count, "t int, bucket int, yes double, no double").groupBy("t", "bucket").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        table = counted.toArrow()
        return cls(*(table.column(c).to_numpy() for c in ("t", "bucket", "yes", "no")))

    def log_odds(self, b: Batch) -> np.ndarray:
        """Log-odds of a boundary at each gap, by the state."""
        logit = lambda p: np.log(p / (1 - p))
        base = logit(self.base)
        side = {False: [], True: []}
        for right, found in side.items():
            p = np.full(len(b.at), self.base)
            for n, (order, of) in enumerate(_tables()):
                if of == right:
                    k = b.buckets(b.at, order, right)
                    yes, no = self.yes[n, k], self.no[n, k]
                    p = (yes + BACKOFF * p) / (yes + no + BACKOFF)
                    found.append((order, p))
        clip = lambda p: np.clip(p, 2e-3, 1 - 2e-3)
        known = b.shows + logit(clip(side[True][-1][1])) - base
        out = np.empty((len(b.at), STATES))
        out[:, -1] = known + logit(clip(side[False][-1][1]))
        for since in range(1, STATES):
            # The n-gram that begins with the boundary, backed off to those that are as short.
            p = next((q for order, q in reversed(side[False]) if order <= since), np.full(len(b.at), self.base))
            k = b.after_boundary(b.at, np.full(len(b.at), since))
            yes, no = self.yes[-1, k], self.no[-1, k]
            out[:, since - 1] = known + logit(clip((yes + BACKOFF * p) / (yes + no + BACKOFF)))
        return out

    def ends(self, b: Batch) -> list[list[int]]:
        """Places of the sentence ends of each text, the last one included."""
        odds = self.log_odds(b)
        width = int(b.counts.max()) if len(b.counts) else 0
        rows = np.repeat(np.arange(len(b.counts)), b.counts)
        starts = np.cumsum(b.counts) - b.counts
        cols = np.arange(len(odds)) - np.repeat(starts, b.counts)
        grid = np.full((len(b.counts), width, STATES), -60.0)
        grid[rows, cols] = odds
        steps = np.ones((len(b.counts), width), np.int64)
        steps[rows, cols] = np.where(cols > 0, np.diff(b.at, prepend=0), b.at - b.begin)
        post = posteriors(grid, steps)
        out = []
        for i, (start, n, end) in enumerate(zip(starts.tolist(), b.counts.tolist(), b.end.tolist())):
            ends = b.places[start : start + n][post[i, :n] > 0.5].tolist()
            if end:
                ends.append(end)
            out.append(sorted({e for e in ends if e > 0}))
        return out


def posteriors(odds: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Forward-backward posteriors of boundaries at the gaps of each row.

    `odds` has the log-odds of a boundary by row, gap and state; `steps` the characters from the gap before (or the
    beginning) to each gap.  State k (from 0) is k + 1 characters since the last boundary, the last state as many or more.
    """
    rows, width, states = odds.shape
    if not width:
        return np.zeros((rows, width))
    weight = np.exp(np.clip(odds, -60, 60))
    step = np.clip(steps, 1, states)
    moves = _moves(states)
    forward = np.zeros((rows, width, states))
    forward[np.arange(rows), 0, step[:, 0] - 1] = 1.0
    both = np.empty((rows, 1, states + 1))  # without a boundary by state, and with one
    for j in range(1, width):
        before = forward[:, j - 1]
        both[:, 0, :states] = before
        np.einsum("rk,rk->r", before, weight[:, j - 1], out=both[:, 0, states])
        here = np.matmul(both, moves[step[:, j]])[:, 0]
        np.divide(here, here.sum(axis=1, keepdims=True), out=forward[:, j])  # only ratios count
    after = np.ones((rows, width, states + 1))  # what follows a gap, by the same choices
    nxt = np.ones((rows, states))
    for j in range(width - 2, -1, -1):
        nxt = after[:, j + 1, :states] + weight[:, j + 1] * after[:, j + 1, states:]
        nxt /= nxt.sum(axis=1, keepdims=True)
        after[:, j] = np.matmul(moves[step[:, j + 1]], nxt[:, :, None])[:, :, 0]
    yes = np.einsum("rjk,rjk->rj", forward, weight) * after[:, :, states]
    no = np.einsum("rjk,rjk->rj", forward, after[:, :, :states])
    return yes / (yes + no)


@lru_cache(maxsize=4)
def _moves(states: int) -> np.ndarray:
    """For each step, which state every state leads to, and (the last row) a boundary."""
    out = np.zeros((states + 1, states + 1, states))
    for d in range(1, states + 1):
        for k in range(states):
            out[d, k, min(k + d, states - 1)] = 1.0
        out[d, states, d - 1] = 1.0
    return out


def sentence_ends(rows: DataFrame, model: Model, key: str = "utt_id", text: str = "text") -> DataFrame:
    """`key` and ends (array of int) of every text: characters up to and including the last visible one of each sentence.

    Null, empty and blank texts have no sentence; any other text ends at its last visible character.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # two tables of 2^BITS floats for each order and side and for boundaries: 19 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                # Texts of like length share a matrix.
                texts = [t or "" for t in part.column(1).to_pylist()]
                order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
                ends: list[list[int]] = [[] for _ in texts]
                for j in range(0, len(order), 500):
                    some = order[j : j + 500]
                    for i, e in zip(some, shared.value.ends(Batch([texts[i] for i in some], found))):
                        ends[i] = e
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends, pa.list_(pa.int32()))], names=[key, "ends"])

    chosen = rows.select(key, text)
    return chosen.mapInArrow(run, f"`{key}` {chosen.schema[key].dataType.simpleString()}, ends array<int>")


def _in_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for ends, words in zip(batch.column("ends").to_pylist(), batch.column("words").to_pylist()):
            words = sorted((w["i"], w["n"]) for w in words)
            upto = np.cumsum([n for _, n in words])
            at = np.minimum(np.searchsorted(upto, np.array(ends, np.int64)), len(words) - 1)
            out.append(sorted({words[k][0] for k in at.tolist()}))
        yield pa.RecordBatch.from_arrays([batch.column("utt_id"), pa.array(out, pa.list_(pa.int64()))], names=["utt_id", "ends"])


def sentences(utterances: DataFrame, words: DataFrame) -> DataFrame:
    """layer, utt_id, pos: the sentence ends of texts, and of the words that make them up."""
    once = cut_lineage(utterances.select("utt_id", "text").where("text IS NOT NULL").dropDuplicates(["utt_id"]))
    model = Model.of(once)
    found = sentence_ends(once, model)
    # Words only carry their lengths; a word delivered twice counts once.
    parts = words.select("utt_id", "word_idx", F.coalesce(F.char_length("word"), F.lit(0)).alias("n")).groupBy("utt_id", "word_idx").agg(F.max("n").alias("n"))
    of_utt = parts.groupBy("utt_id").agg(F.collect_list(F.struct(F.col("word_idx").alias("i"), "n")).alias("words"))
    joined = found.join(of_utt, "utt_id", "left")
    both = cut_lineage(joined)
    text = both.select(F.lit("text").alias("layer"), "utt_id", F.explode("ends").alias("pos")).select("layer", "utt_id", F.col("pos").cast("bigint").alias("pos"))
    word = both.where("words IS NOT NULL").select("utt_id", "ends", "words").mapInArrow(_in_words, "utt_id bigint, ends array<bigint>")
    return text.unionByName(word.select(F.lit("words").alias("layer"), "utt_id", F.explode("ends").alias("pos")))
