"""Personal information in free text, by a linear-chain conditional random field.

Texts are cut into tokens (Latin words, runs of digits, and single characters of other scripts and marks).
A token's features are its form, its shape and its neighbours' forms and shapes, alone and in pairs, hashed
into one table of weights.  The field is trained by gradient on its likelihood (forward and backward sums)
over the labelled table of this package, and decoded by Viterbi over padded batches in numpy.  A check of
the found stretches follows: a mention must hold what its kind requires, and begins and ends at what
belongs to it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from talkgrid.llm.lookalike import LATIN_LOOKS
from talkgrid.llm.pii_table import KINDS, labelled

BITS = 17
#: Distinct tokens whose scores a process holds: some 30 MB.
HELD = 1 << 16
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_TAG = {t: i for i, t in enumerate(TAGS)}
#: Offsets of the neighbours whose own features count, and of the pairs of neighbours that count together.
WINDOW = (-8, -7, -6, -5, -4, -3, -2, -1, 0, 1, 2, 3, 4)
PAIRS = ((-2, -1), (-1, 0), (0, 1), (1, 2), (-1, 1))

_TOKEN = re.compile(r"[A-Za-zÀ-ɏͰ-ϿЀ-ӿＡ-Ｚａ-ｚﬁ̀-ͯ­​-‏⁠﻿]+|[0-9０-９]+|\s|.", re.DOTALL)
_INVISIBLE = {0xAD: None, 0xFEFF: None, 0x2060: None, **{c: None for c in range(0x200B, 0x2010)}}
_FOLD = str.maketrans(LATIN_LOOKS)
_KANJI_DIGITS = "〇一二三四五六七八九"
# Characters of places in addresses, of parts of organisations, and at the ends of surnames and given names; words for digits.
_PLACE_UNITS = frozenset("都道府県市区町村郡番号室丁目地栋楼单元省路街巷通坂沢台")
_ORG_UNITS = frozenset("課係部室班局科组処处社店")
_NAME_ENDS = frozenset("田川山野原沢澤谷崎島井村本木森林橋口池岡坂藤瀬尾浦城")
_GIVEN_ENDS = frozenset("子美香奈恵江代乃里也郎助介司人吾平夫男雄彦輝樹斗")
_DIGIT_WORDS = frozenset("zero one two three four five six seven eight nine oh double".split())
_ROADS = frozenset("lane road street close row ave avenue mews drive terrace way court st flat apt calle avda plaza straße weg gasse allee".split())


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of every token; white space is a token of its own."""
    return [m.span() for m in _TOKEN.finditer(text)]


@lru_cache(maxsize=1 << 16)
def _shape(token: str) -> str:
    first = token[0]
    if first.isspace():
        return "s"
    if token.isdigit():
        return ("z" if token[0] == "0" else "d") + str(min(len(token), 13))
    if first.isalpha() and first < "ɐ":
        if token.lower() in _DIGIT_WORDS:
            return "dw"
        case = "U" if token.isupper() else "C" if first.isupper() else "l"
        return case + ("1" if len(token) == 1 else "2" if len(token) < 4 else "")
    if first in _KANJI_DIGITS:
        return "hd"
    if "一" <= first <= "鿿" or "豈" <= first <= "﫿" or first in "々ヶケノ":
        return "h"
    if "ぁ" <= first <= "ん":
        return "k"
    if "ァ" <= first <= "ヺ" or first == "ー":
        return "K"
    if unicodedata.category(first)[0] in "LM":
        return "x" + ("t" if "ก" <= first <= "๛" else "i")
    return "p" + (first if first in "@-.,:;()（）/・「」[]_+'＠" else "")


@lru_cache(maxsize=1 << 16)
def folded(token: str) -> str:
    """The token in compatibility form, without invisible characters, in look-alike Latin letters."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", token.translate(_INVISIBLE)).translate(_FOLD)) or " "


@lru_cache(maxsize=1 << 16)
def _plain(token: str) -> str:
    """The folded token; of digits only how many there are and whether the first is a zero."""
    out = folded(token)
    return ("0" if out[0] == "0" else "5") + "5" * min(len(out) - 1, 12) if out.isdigit() else out


def _hash(text: str) -> int:
    return xxhash.xxh32_intdigest(text) & ((1 << BITS) - 1)


@lru_cache(maxsize=1 << 17)
def _own(token: str) -> tuple[str, ...]:
    """Features of a token by itself."""
    low, shape = token.lower(), _shape(token)
    word = "0" if token.isdigit() else low
    out = [f"s={shape}", f"S={shape[0]}"]
    if not (shape[0] in "UCl" and len(low) > 14):
        out.append(f"w={word}")
    if shape[0] in "UCl":
        out += [f"e={low[-3:]}", f"b={low[:2]}"]
        if low in _ROADS:
            out.append("road")
    for kind, held in (("place", _PLACE_UNITS), ("org", _ORG_UNITS), ("sur", _NAME_ENDS), ("given", _GIVEN_ENDS)):
        if token in held:
            out.append(kind)
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def _own_buckets(token: str) -> np.ndarray:
    """The buckets of a token's features, by offset."""
    return np.array([[_hash(f"{o}{f}") for f in _own(token)] for o in WINDOW], np.int64)


def _pair(token: str) -> tuple[str, str]:
    """What a token is called in pairs: its word (if it is short or common) and its shape."""
    shape = _shape(token)
    return ("0" if token.isdigit() else token.lower()), shape


@lru_cache(maxsize=1 << 16)
def _name_hash(name: str) -> int:
    return _hash("n" + name)


class Encoded:
    """Texts as numbers of distinct tokens, padded with a mark at both ends."""

    PAD = 9

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {"\x00": 0}
        seen: dict[str, int] = {}

        def of(token: str) -> int:
            if token not in seen:
                seen[token] = number.setdefault(_plain(token), len(number))
            return seen[token]

        rows = [list(map(of, _TOKEN.findall(t))) for t in texts]
        self.words = list(number)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.flat = np.zeros(int(self.lengths.sum()) + self.PAD * (len(rows) + 1), np.int64)
        self.starts = np.cumsum(np.append(0, self.lengths + self.PAD))[:-1] + self.PAD
        for r, at in zip(rows, self.starts):
            self.flat[at : at + len(r)] = r
        self.at = np.repeat(self.starts, self.lengths) + np.arange(int(self.lengths.sum())) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def features(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each offset, the buckets (tokens x features, -1 for none) of each distinct token; for each pair and naming, the bucket of each place."""
        return self.singles(), self.pairs()

    def singles(self) -> list[np.ndarray]:
        own = [_own_buckets(w) for w in self.words]
        table = np.full((len(WINDOW), len(own), max(x.shape[1] for x in own)), -1, np.int64)
        for i, x in enumerate(own):
            table[:, i, : x.shape[1]] = x
        return list(table)

    def pairs(self) -> list[np.ndarray]:
        names = [_pair(w) for w in self.words]
        pairs = []
        for kind in (0, 1):
            ids = np.array([_name_hash(n[kind]) for n in names], np.uint64)
            for n, (a, b) in enumerate(PAIRS):
                x, y = ids[self.flat[self.at + a]], ids[self.flat[self.at + b]]
                h = (x * np.uint64(0x9E3779B97F4A7C15) ^ (y + np.uint64(n * 2 + kind + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xBF58476D1CE4E5B9)
                pairs.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        ids = np.array([_hash("t" + n[1]) for n in names], np.uint64)
        x, y, z = (ids[self.flat[self.at + o]] for o in (-1, 0, 1))
        h = (x * np.uint64(0x9E3779B97F4A7C15) ^ y * np.uint64(0xC2B2AE3D27D4EB4F) ^ z * np.uint64(0x165667B19E3779F9)) * np.uint64(0xBF58476D1CE4E5B9)
        pairs.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        return pairs


class _Sums:
    """Sums of rows by a number that each row has."""

    def __init__(self, number: np.ndarray, size: int):
        self.order, self.size = np.argsort(number, kind="stable"), size
        inside = number[self.order]
        self.starts = np.flatnonzero(np.append(True, inside[1:] != inside[:-1])) if len(inside) else np.zeros(0, np.int64)
        self.which = inside[self.starts]

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((self.size, rows.shape[1]), rows.dtype)
        if len(self.which):
            out[self.which] = np.add.reduceat(rows[self.order], self.starts, axis=0)
        return out


class Field:
    """Weights of features by tag and of neighbouring tags."""

    def __init__(self):
        n = len(TAGS)
        self.weights = np.zeros((1 << BITS, n), np.float32)
        self.moves = np.zeros((n, n), np.float32)
        # Inside a mention only after its beginning or inside of the same kind.
        self.allowed = np.array([[not t.startswith("I") or s[1:] == t[1:] and s != "O" for t in TAGS] for s in TAGS])
        self.first = np.array([not t.startswith("I") for t in TAGS])

    def scores(self, e: Encoded, single, pairs) -> np.ndarray:
        """Scores of every tag at every place."""
        out = np.zeros((len(e.at), len(TAGS)), np.float32)
        for o, table in zip(WINDOW, single):
            own = np.zeros((len(table), len(TAGS)), np.float32)
            for column in table.T:
                some = column >= 0
                own[some] += self.weights[column[some]]
            out += own[e.flat[e.at + o]]
        for bucket in pairs:
            out += self.weights[bucket]
        return out

    def own_scores(self, e: Encoded) -> np.ndarray:
        """Scores that each distinct token gives the places around it, by offset and tag; worked out once a process."""
        held = self.__dict__.setdefault("_held", {})
        if len(held) > HELD:
            held.clear()
        new = [w for w in e.words if w not in held]
        if new:
            table = np.zeros((len(new), len(WINDOW), len(TAGS)), np.float32)
            for i, word in enumerate(new):
                own = _own(word)
                table[i] = self.weights[np.array([[_hash(f"{o}{f}") for f in own] for o in WINDOW])].sum(axis=1)
            held.update(zip(new, table))
        return np.stack([held[w] for w in e.words])

    def place_scores(self, e: Encoded) -> np.ndarray:
        """The same as `scores`, by the tokens' own scores."""
        own = self.own_scores(e)
        out = np.zeros((len(e.at), len(TAGS)), np.float32)
        for k, o in enumerate(WINDOW):
            out += own[e.flat[e.at + o], k]
        for bucket in e.pairs():
            out += self.weights[bucket]
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_held"}

    def transitions(self) -> np.ndarray:
        return np.where(self.allowed, self.moves, np.float32(-1e4))

    def _padded(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        grid = np.zeros((len(lengths), int(lengths.max()), len(TAGS)), np.float32)
        grid[np.arange(grid.shape[1]) < lengths[:, None]] = scores
        grid[:, 0, ~self.first] = -1e4
        return grid

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags of all places, texts one after the other."""
        if not len(scores):
            return np.zeros(0, np.int64)
        grid, move = self._padded(scores, lengths), self.transitions()
        rows, width, n = grid.shape
        back = np.zeros((rows, width, n), np.int8)
        best = grid[:, 0].copy()
        into = np.ascontiguousarray(move.T)  # the tag before on the last axis
        order = np.argsort(-lengths, kind="stable")  # texts that are still going on stand first
        grid, best = grid[order], best[order]
        going = np.searchsorted(-lengths[order], -np.arange(width), side="left")
        for j in range(1, width):
            k = going[j]
            step = best[:k, None, :] + into
            at = step.argmax(axis=2)
            back[order[:k], j] = at
            best[:k] = np.take_along_axis(step, at[:, :, None], axis=2)[:, :, 0] + grid[:k, j]
        best = best[np.argsort(order)]
        tags = np.zeros((rows, width), np.int64)
        tag = best.argmax(axis=1)
        for j in range(width - 1, -1, -1):
            live = j < lengths
            tags[live, j] = tag[live]
            inside = live & (j > 0)
            tag[inside] = back[inside, j, tag[inside]]
        return tags[np.arange(width) < lengths[:, None]]

    def gradients(self, scores: np.ndarray, lengths: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gold minus expected: by place and tag, and by pair of tags."""
        grid, move = self._padded(scores, lengths).astype(np.float64), np.exp(self.transitions().astype(np.float64))
        rows, width, n = grid.shape
        inside = np.arange(width) < lengths[:, None]
        seen = np.exp(grid - grid.max(axis=2, keepdims=True))
        # Sums are scaled at every place: only ratios count.
        alpha, beta = np.ones((rows, width, n)), np.ones((rows, width, n))
        alpha[:, 0] = seen[:, 0] / seen[:, 0].sum(axis=1, keepdims=True)
        for j in range(1, width):
            here = (alpha[:, j - 1] @ move) * seen[:, j]
            here /= here.sum(axis=1, keepdims=True)
            alpha[:, j] = np.where(inside[:, j, None], here, alpha[:, j - 1])
        for j in range(width - 2, -1, -1):
            here = (seen[:, j + 1] * beta[:, j + 1]) @ move.T
            beta[:, j] = np.where(inside[:, j + 1, None], here / here.sum(axis=1, keepdims=True), 1.0)
        node = alpha * beta
        node /= node.sum(axis=2, keepdims=True)
        tags = np.zeros((rows, width), np.int64)
        tags[inside] = gold
        pair = np.zeros((n, n))
        ahead = seen * beta
        for j in range(1, width):
            live = inside[:, j]
            before, after = alpha[live, j - 1], ahead[live, j]
            pair -= ((before / ((before @ move) * after).sum(axis=1, keepdims=True)).T @ after) * move
            np.add.at(pair, (tags[live, j - 1], tags[live, j]), 1.0)
        diff = -node[inside]
        diff[np.arange(len(gold)), gold] += 1.0
        return diff.astype(np.float32), pair.astype(np.float32)

    def fit(self, table: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 6, size: int = 48, rate: float = 0.25, seed: int = 3) -> Field:
        """Gradient ascent with a rate of its own for every weight (AdaGrad)."""
        rng = np.random.default_rng(seed)
        seen_w, seen_m = np.full_like(self.weights, 1e-1), np.full_like(self.moves, 1e-1)
        table = sorted(table, key=lambda x: len(x[0]))
        groups = [table[i : i + size] for i in range(0, len(table), size)]
        ready = []
        for group in groups:
            e = Encoded([t for t, _ in group])
            gold = np.concatenate([gold_tags(tokens(t), m) for t, m in group])
            single, pairs = e.features()
            # All buckets of the group once; each sum over places is one over neighbours in an order made beforehand.
            used, local = np.unique(np.concatenate([*(t.ravel() for t in single), *pairs]), return_inverse=True)
            cuts = np.cumsum([t.size for t in single] + [len(p) for p in pairs])[:-1]
            parts = np.split(local, cuts)
            own = [(_Sums(e.flat[e.at + o], len(e.words)), _Sums(x, len(used)), t.shape[1]) for o, t, x in zip(WINDOW, single, parts)]
            ready.append((e, single, pairs, gold, used, own, [_Sums(x, len(used)) for x in parts[len(single) :]]))
        for _ in range(epochs):
            for k in rng.permutation(len(ready)):
                e, single, pairs, gold, used, own, paired = ready[k]
                diff, pair = self.gradients(self.scores(e, single, pairs), e.lengths, gold)
                grad = np.zeros((len(used), len(TAGS)), np.float32)
                for by_word, by_bucket, n in own:
                    grad += by_bucket(np.repeat(by_word(diff), n, axis=0))
                for sums in paired:
                    grad += sums(diff)
                # The first bucket stands for none.
                hit, grad = (used[1:], grad[1:]) if used[0] < 0 else (used, grad)
                g = grad / size - 1e-5 * self.weights[hit]
                seen_w[hit] += g * g
                self.weights[hit] += rate * g / np.sqrt(seen_w[hit])
                g = pair / size
                seen_m += g * g
                self.moves += rate * g / np.sqrt(seen_m)
        return self

    def mentions(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the mentions of each text, in order, checked."""
        e = Encoded(texts)
        if not len(e.at):
            return [[] for _ in texts]
        full = e.lengths > 0
        tags = self.viterbi(self.place_scores(e), e.lengths[full])
        ends = np.cumsum(e.lengths)
        some = np.add.reduceat(np.append(tags != 0, False), np.append(0, ends[:-1])) * full > 0 if len(ends) else []
        out: list = []
        for text, n, end, hit in zip(texts, e.lengths.tolist(), ends.tolist(), some):
            # Most texts mention nothing.
            out.append([c for f in runs(tags[end - n : end].tolist(), tokens(text)) for c in checked(text, *f)] if hit else [])
        return out


def gold_tags(spans: list[tuple[int, int]], mentions: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(spans), np.int64)
    for a, b, kind in mentions:
        first = True
        for i, (s, e) in enumerate(spans):
            if s < b and e > a:
                out[i] = _TAG[("B-" if first else "I-") + kind]
                first = False
    return out


def runs(tags: list[int], spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Stretches of tags that begin with B and go on with I."""
    out: list[tuple[int, int, str]] = []
    for tag, (s, e) in zip(tags, spans):
        if not tag:
            continue
        name = TAGS[tag]
        if name.startswith("B"):
            out.append((s, e, name[2:]))
        elif name.startswith("I") and out and out[-1][1] == s and out[-1][2] == name[2:]:
            out[-1] = (out[-1][0], e, out[-1][2])
    return out


_HONORIFIC = re.compile(r"(?:さん|様|さま|くん|君|氏|ちゃん|先生|殿|先輩)$")
_TITLE = re.compile(r"^(?:Frau|Herr|Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Don|Doña)\.?\s+")
_FIRM = re.compile(r"株式会社|（株）|㈱|\(株\)|\bInc\b|\bK\.K|\bLtd\b|(?:課|係|室|班|局|チーム|支店|センター|委員会)$")
#: A capital word and then a small one that is no particle of a name.
_PHRASE = re.compile(r"^[A-ZÀ-Þ][a-zß-ÿ]+\.? (?!(?:de|del|la|von|van|der|zu|bin|da|di|dos)\b)[a-zß-ÿ]")
# What a street by one word and a number must end with, and months, which are no streets.
_STREET_WORD = re.compile(r"(?:straße|strasse|weg|gasse|allee|platz|ring|damm|ufer|hof)\s+\d", re.IGNORECASE)
_MONTH = re.compile(r"^(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}\b")
_DATE = re.compile(r"^\d{4}-\d{1,2}-\d{1,2}$")
_CALLABLE = re.compile(r"^(?:\+?1[ .-])?\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}$")
_UNNAMED = re.compile(r"^(?:話者|speaker|不明|unknown|組長|组长)", re.IGNORECASE)
_LETTER = "A-Za-z0-9０-９Ａ-Ｚａ-ｚͰ-ϿЀ-ӿ_+\\-­​-‏⁠﻿"
_EMAIL = re.compile(rf"[{_LETTER}](?:[{_LETTER}.．]|ドット)*(?:@|＠|アットマーク|\s?[\[(（]at[\])）]\s?| at )[{_LETTER}]+(?:(?:[.．]|ドット| dot )[{_LETTER}]+)+", re.IGNORECASE)
_HAN_NAME = re.compile(r"[一-鿿豈-﫿々ヶノ]")
_CALLED = re.compile("さん|様|さま|くん|氏|先生|ちゃん|殿")
_HYPHENED = re.compile(r"-[A-ZÀ-Þ][A-Za-zÀ-ÿ]+")
_REST = re.compile("([一-鿿々ヶノ]{0,3}[ぁ-ん]{0,3}?)(?:さん|様|さま|くん|氏)")


def _digits(text: str) -> int:
    return sum(c.isdigit() or c in _KANJI_DIGITS for c in text) + sum(w in _DIGIT_WORDS for w in re.split(r"[\s,]+", text.lower()))


def checked(text: str, start: int, end: int, kind: str) -> list[tuple[int, int, str]]:
    """The mention with its exact ends, or nothing if it lacks what its kind needs."""
    while start < end and (text[start].isspace() or text[start] in "、。，,：:；;・「『“\"'>＞<" and not (kind == "id_number" and text[start] == "・")):
        start += 1
    while end > start and (text[end - 1].isspace() or text[end - 1] in "、。，,：:；;「」『』“”\"'!！?？>＞"):
        end -= 1
    value = text[start:end]
    if kind == "id_number" and _CALLABLE.match(value):
        kind = "phone"  # no identity number is written in groups of three, three and four
    if kind == "name":
        cut = max((value.rfind(c) for c in ")]>）】"), default=-1) + 1
        start, value = start + cut + len(value[cut:]) - len(value[cut:].lstrip()), value[cut:].strip()
        cut = _HONORIFIC.sub("", value)
        lead = _TITLE.match(cut)
        start, end = start + (lead.end() if lead else 0), start + len(cut)
        if "\n" in value:
            return []
        # Before an honorific the name is a whole run of Chinese characters, and kana that end it.
        more = _REST.match(text, end)
        if more and _HAN_NAME.match(text[end - 1 : end]):
            end = more.end(1)
        if _CALLED.match(text, end):
            while start > 0 and _HAN_NAME.match(text[start : start + 1]) and _HAN_NAME.match(text[start - 1]):
                start -= 1
        more = _HYPHENED.match(text, end)
        end = more.end() if more else end
        value = text[start:end]
        if any(c.isdigit() for c in value) or _UNNAMED.match(value) or not any(c.isalpha() for c in value) or _FIRM.search(value) or _PHRASE.match(value):
            return []
    elif kind == "email":
        # No address ends inside a word, and none lacks its two parts.
        while start > 0 and re.match(rf"[{_LETTER}]", text[start - 1]) and re.match(rf"[{_LETTER}]", text[start]):
            start -= 1
        while end < len(text) and re.match(rf"[{_LETTER}]", text[end]) and re.match(rf"[{_LETTER}]", text[end - 1]):
            end += 1
        return [(m.start(), m.end(), kind) for m in _EMAIL.finditer(text, start, end)]
    elif kind == "phone":
        # Brackets that open the number belong to it.
        if start > 0 and text[start - 1] in "(（+" and not (text[start - 1] == "+" and start > 1 and text[start - 2].isdigit()):
            start -= 1
        stop = re.search(r"[.。]\s+\D", text[start:end])
        end = start + stop.start() if stop else end
        if _digits(text[start:end]) < 7 or _DATE.match(text[start:end].translate(_INVISIBLE)):
            return []
    elif kind == "id_number" and (_digits(value) < 6 or _DATE.match(value.translate(_INVISIBLE))):
        return []
    elif kind == "address":
        # No address goes on beyond a full stop of Japanese or Chinese; the stop of an abbreviation belongs to it.
        parts = [(m.start(), m.end()) for m in re.finditer(r"[^。！？!?\n]+", value)]
        best = max(parts, key=lambda p: _digits(value[p[0] : p[1]]), default=(0, 0))
        start, end = start + best[0], start + best[1]
        if re.match("[一-鿿]", text[start : start + 1]):
            # In Japanese no Chinese character stands before an address that does not belong to it.
            if re.search("[ぁ-んァ-ヺ]", text[max(0, start - 15) : end + 15]):
                while start > 0 and re.match("[一-鿿ヶノ]", text[start - 1]):
                    start -= 1
        else:
            if text[end : end + 1] == "." and re.search(r"\b(?:Ave|Rd|Blvd|Dr)$", text[start:end]):
                end += 1
            more = _HYPHENED.match(text, end)
            end = more.end() if more else end
        value = text[start:end]
        one_word = re.match(r"^\w+\s+\d+\w?$|^\d+\s+\w+$", value)
        if _digits(value) == 0 or len(value) < 5 or _MONTH.match(value) or one_word and not _STREET_WORD.search(value):
            return []
    if kind in ("phone", "id_number"):
        while end < len(text) and text[end].isdigit() and text[end - 1].isdigit():
            end += 1
        while end > start and text[end - 1] in ".-－ー":
            end -= 1
    return [(start, end, kind)] if end > start else []


_trained: dict[tuple, Field] = {}


def trained(table=None) -> Field:
    """The field trained on the labelled table (a few seconds, once in a process)."""
    key = ("own",) if table is None else (id(table),)
    if key not in _trained:
        _trained[key] = Field().fit(labelled() if table is None else table)
    return _trained[key]


def redacted(text: str, mentions: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder for every mention and otherwise unchanged."""
    out, at = [], 0
    for s, e, kind in mentions:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def found_mentions(rows: DataFrame, text: str, field: Field | None = None) -> DataFrame:
    """All columns of `rows`, and mentions (array of start, end, kind, value) and redacted of the column `text`.

    A null text has no mentions and stays null; an empty text stays empty.
    """
    shared = rows.sparkSession.sparkContext.broadcast(field or trained())  # 2^BITS weights for each tag: 6 MB
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", mentions array<struct<start:int,end:int,kind:string,value:string>>, redacted string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
            found: list = [[]] * len(texts)
            for k in range(0, len(order), 400):
                some = order[k : k + 400]
                for i, m in zip(some, shared.value.mentions([texts[i] or "" for i in some])):
                    found[i] = m
            items = [[{"start": s, "end": e, "kind": n, "value": t[s:e]} for s, e, n in m] for t, m in zip(texts, found)]
            clean = [None if t is None else redacted(t, m) for t, m in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(items, kind), pa.array(clean, pa.string())], names=[*batch.schema.names, "mentions", "redacted"])

    return rows.mapInArrow(run, schema)


def personal_information(utterances: DataFrame, field: Field | None = None) -> DataFrame:
    """utt_id, field ('text' or 'memo'), mentions and redacted of every utterance, each counted once."""
    once = utterances.select("utt_id", "text", "memo").dropDuplicates(["utt_id"])
    both = once.select("utt_id", F.explode(F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("t")), F.struct(F.lit("memo").alias("field"), F.col("memo").alias("t")))).alias("x"))
    return found_mentions(both.select("utt_id", "x.field", "x.t").where("t IS NOT NULL"), "t", field).drop("t")
