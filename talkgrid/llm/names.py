"""Variant spellings of names, attached to the registered person or firm they denote.

A noisy channel.  A registered name is written in some form (order, script, initials, nickname, part of the
name, honorific), which the channel charges for, and then mistyped, which it charges for by the error.  The
candidate canonical spellings are the forms of all registered rows, with the frequency of their exact spellings
in the corpus as prior, and all other spellings that are frequent enough to have variants, with their own
frequency.  A spelling goes to the candidate of greatest posterior; it is tied to nobody if that is a name that
is not registered (the spelling itself included), or if two registered people fit it alike.

All of it is joins: forms, and strings that arise from spellings and forms by deletions, are keys in tables (a
spelling and a form within k errors share a string that arises from both by k deletions, so no spelling is
compared with all forms).  Nothing of the register or of the labels is held on the driver or broadcast, and
of the people that share a form only the least and the greatest travel: two that fit are as good as all.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkgrid.operators.durable import cut_lineage
from talkgrid.llm.readings import folded, readings, romaji, short, sound_key, syllables

#: Share of a name's occurrences that one particular error may have.
ERROR_SHARE = 0.25

# Titles, honorifics and remarks that stand beside a name.
_AFTER = r"(?:さん|様|さま|氏|くん|君|ちゃん|殿|先生|御中|-san|-sama|\(remote\)|\(司会\)|\(書記\)|\(議長\)|\((?:chair|host|guest|online|オンライン|リモート)\))"
_TITLE = r"(?:部長|課長|係長|社長|主任|室長|次長|会長|専務|常務)"
_BEFORE = r"(?:dr\.?|mr\.?|mrs\.?|ms\.?|prof\.?|herr|frau|sr\.?|sra\.?)\s+"
_FIRM = r"株式会社|有限会社|合同会社|\(株\)|\(有\)|㈱|㈲"
_FIRM_LATIN = r"[,\s]*\b(?:inc|co|ltd|k\.?k|corp|llc|gmbh)\b\.?"
# How unnamed speakers are labelled.
_NOBODY = re.compile(r"^(?:|\?+|不明|unknown|未設定|話者|speaker|n/a|-+|none|匿名|anonymous)$")
_LETTERED = re.compile(r"^(?:話者|speaker|spk|発言者|参加者)[\s_\-]*([a-z]|[0-9]{1,3})$")
# Short forms of given names that are not their beginnings.
NICKNAMES = {
    "alexander": "sascha sandy lex", "benedict": "ben benny", "dorothy": "dot dotty dolly", "elizabeth": "liz lizzie beth betty lisa", "francisca": "fran paca cisca", "gabriele": "gabi", "johannes": "hannes hans jo", "josephine": "josie jo", "katharina": "kathi kati kat",
    "leopold": "poldi leo", "margaret": "peggy maggie meg", "nathaniel": "nat nate", "robert": "bob rob bobby", "theodore": "ted teddy theo", "wilhelmina": "mina willa", "william": "bill will billy",
}

_HAN = re.compile(r"[一-鿿々〆]")
_KANA = re.compile(r"[ぁ-ゖァ-ヺー]")


def cleaned(label: str) -> str:
    """A label without padding, brackets, honorifics, remarks and marks at its ends; case kept."""
    text = folded(label).strip()
    for _ in range(4):
        before = text
        text = re.sub(r"^[\[【〈<「『]\s*(.*?)\s*[\]】〉>」』]$", r"\1", text)
        text = re.sub(r"[\s:;,>、。・]+$", "", text)
        text = re.sub(rf"(?<=.)\s*{_AFTER}$", "", text, flags=re.IGNORECASE).strip()
        text = re.sub(rf"(?<=[^\s本][^\s]|.本)\s*{_TITLE}$", "", text)
        if text == before:
            break
    return text


def lettered(label: str | None) -> str | None:
    """The letter of an unnamed speaker, '' if the label names nobody, None if it may be a name."""
    if label is None:
        return ""
    text = cleaned(label).casefold()
    if _NOBODY.match(text):
        return ""
    found = _LETTERED.match(text)
    return found[1] if found else None


def _latin(text: str) -> str:
    """Letters of a Latin spelling, without accents and case."""
    out = unicodedata.normalize("NFKD", text.casefold().replace("ß", "ss"))
    return "".join(c for c in out if c.isalpha())


class Spelling:
    """What a cleaned spelling consists of."""

    def __init__(self, text: str):
        text = cleaned(text)
        self.firm = bool(re.search(_FIRM, text)) or bool(re.search(_FIRM_LATIN, text, re.IGNORECASE))
        core = re.sub(_FIRM, "", text)
        core = re.sub(rf"(?:{_FIRM_LATIN})+\s*$", "", core, flags=re.IGNORECASE) if self.firm else core
        core = re.sub(rf"^{_BEFORE}", "", core.strip(), flags=re.IGNORECASE)
        self.text = cleaned(core)
        self.han = bool(_HAN.search(self.text))
        self.kana = bool(_KANA.search(self.text))
        self.inside = ""
        found = re.match(r"^(.*?)\((.+)\)$", self.text)
        if found and _KANA.search(found[2]):
            self.text, self.inside = found[1].strip(), short(romaji(found[2]))
        self.comma = "," in self.text
        self.words = [w for w in re.split(r"[\s,・]+", self.text) if w]
        self.solid = "".join(self.words)


#: Kinds of forms and what the channel charges for them, as -log of their likelihood.
FULL, JOINED, INITIAL, SHORTENED, PART = 0.5, 1.0, 2.5, 2.5, 3.0


def _split_han(solid: str, givens: set[str]) -> tuple[str, str] | None:
    for cut in range(1, len(solid)):
        if solid[cut:] in givens:
            return solid[:cut], solid[cut:]
    return None


class Row:
    """One registered row: how its name is parted and read, and the forms it may be written in.

    `known` are parts of names and their readings (None where only known to be a given name) that other rows show,
    `ends` what several names end with alike: given names too, unless a shorter one is known to end them.
    """

    def __init__(self, display: str | None, aliases: Iterable[str | None] | None, known: Iterable[tuple[str, str | None]] = (), ends: Iterable[str] = ()):
        self.display = display or ""
        self.aliases = sorted(a for a in (aliases if aliases is not None else ()) if a and a.strip())
        self.spelled = [Spelling(t) for t in (self.display, *self.aliases)]
        self.givens: set[str] = set()
        self.read: dict[str, set[str]] = defaultdict(set)
        for part, reading in known:
            if reading is None:
                self.givens.add(part)
            else:
                self.read[part].add(reading)
        self.givens |= {e for e in ends if not any(e[k:] in self.givens for k in range(1, len(e)))}
        self._learn()

    def written(self) -> set[str]:
        """All beginnings and ends of the names in Chinese characters, and their words: what other rows may tell about."""
        out: set[str] = set()
        for s in self.spelled:
            if s.han and not s.firm:
                out |= {*s.words, *(s.solid[:k] for k in range(1, len(s.solid))), *(s.solid[k:] for k in range(1, len(s.solid)))}
        return out

    def shown(self) -> list[tuple[str, str | None, bool, str | None]]:
        """(part, reading, whether it is a given name, what stands before it): what this row shows of parts of names."""
        solid = {s.solid for s in self.spelled if s.han and not s.firm and not s.inside and len(s.words) == 1}
        ends = ((t[-k:], None, False, t[:-k]) for t in solid for k in (2, 3) if len(t) > k and readings(t[-k:]))
        return [*((part, r, False, None) for part, rs in self.read.items() for r in rs if self.sure), *((given, None, True, None) for given in self.givens), *ends]

    def _learn(self) -> None:
        """Given names as written, and readings of the parts, as far as this row's spellings show them."""
        latin = [[short(_latin(w)) for w in s.words] for s in self.spelled if not s.han and not s.kana and len(s.words) == 2]
        inside = {s.inside for s in self.spelled if s.inside}
        self.sure = False  # whether it is known where the parts meet
        for s in self.spelled:
            if s.firm or not s.han or s.inside:
                continue
            if len(s.words) == 2:
                self.givens.add(s.words[1])
            elif len(s.words) == 1 and _split_han(s.solid, self.givens) is None:
                # A row that writes its name in Latin letters as well shows where the parts meet.
                for cut in range(1, len(s.solid)):
                    a, b = readings(s.solid[:cut]), readings(s.solid[cut:])
                    if any(x in a and y in b or y in a and x in b for x, y in latin) or any(i in b for i in inside):
                        self.givens.add(s.solid[cut:])
        whole = next((s for s in self.spelled if s.han and not s.inside and not s.firm and self._parts(s)), None)
        if whole is None:
            return
        sur, given = self._parts(whole)
        self.sure = given in self.givens
        for s in self.spelled:
            if s.inside:
                self.read[given].add(s.inside)
        known_g, known_s = self.read[given] | readings(given), self.read[sur] | readings(sur)
        for s in self.spelled:
            if s.han or s.firm:
                continue
            words = [short(romaji(w)) if s.kana else short(_latin(w)) for w in s.words]
            if len(words) == 2 and all(len(w) > 1 for w in words):
                for a, b in (words, words[::-1]):
                    if b in known_g or a in known_s:
                        self.read[sur].add(a), self.read[given].add(b)
            elif len(words) == 1 and len(words[0]) > 5:
                for g in known_g:
                    if words[0].endswith(g) and len(words[0]) > len(g):
                        self.read[sur].add(words[0][: -len(g)]), self.read[given].add(g)
                for r in known_s if not known_g else ():
                    if words[0].startswith(r) and len(words[0]) > len(r):
                        self.read[sur].add(r), self.read[given].add(words[0][len(r) :])

    def _parts(self, s: Spelling) -> tuple[str, str] | None:
        if len(s.words) == 2:
            return s.words[0], s.words[1]
        if len(s.words) != 1 or s.firm:
            return None
        found = _split_han(s.solid, self.givens)
        if found is None and len(s.solid) > 2:  # most given names have two characters
            cut = len(s.solid) - (2 if len(s.solid) > 3 else 1)
            found = (s.solid[:cut], s.solid[cut:]) if readings(s.solid[:cut]) and readings(s.solid[cut:]) else None
        return found

    def _latin_of(self, part: str) -> set[str]:
        return {r for r in (self.read.get(part) or set()) | (set() if self.read.get(part) else set(readings(part))) if r}

    def forms(self) -> dict[str, float]:
        """Form to cost.  Keys tell scripts apart: 'h:' written, 'l:' Latin letters, 'i:' initial and surname, 'p:' one part, 'f:' firm."""
        forms: dict[str, float] = {}

        def put(key: str, cost: float) -> None:
            if len(key) > 3 or _HAN.fullmatch(key[2:]):  # one written character may be a surname, one letter is none
                forms[key] = min(cost, forms.get(key, cost))

        texts = self.spelled
        if any(s.firm for s in texts):
            for s in texts:
                if not s.solid or not (s.firm or s is texts[0] or len(s.solid) > 3):
                    continue
                put("f:" + s.solid.casefold(), FULL)
                latin = {_latin(s.solid)} if not (s.han or s.kana) else readings(s.solid)
                for r in latin:
                    for tail in ("", "inc", "coltd", "kk"):
                        put("l:" + short(r) + tail, JOINED)
            return forms
        main = texts[0]
        written = next((s for s in texts if s.han and self._parts(s)), None)
        if written is not None:
            sur, given = self._parts(written)
            self._written(put, sur, given)
        elif main.han and main.solid:
            put("h:" + main.solid, FULL)
            put("s:" + main.solid, PART)
        if not main.han:
            self._spelled(put, main, written is not None)
        for s in texts[1:]:
            if not s.han and not s.firm and len(s.words) == 2 and all(len(w.strip(".")) > 1 for w in s.words) and written is None and not main.han:
                self._spelled(put, s, True)
        return forms

    def _written(self, put, sur: str, given: str) -> None:
        put("h:" + sur + given, FULL)
        put("s:" + sur, PART)
        for g in self._latin_of(given):
            put("g:" + sur + "|" + g, FULL)
        for s in self._latin_of(sur):
            put("p:" + s, PART)
            for g in self._latin_of(given):
                put("l:" + s + g, FULL), put("l:" + g + s, FULL)
                put("y:" + sound_key(syllables(s + g)), FULL)
                put("i:" + g[0] + "|" + s, INITIAL)

    def _spelled(self, put, s: Spelling, minor: bool) -> None:
        words = [short(romaji(w)) if s.kana else _latin(w) for w in s.words]
        if not all(words) or not words:
            return
        if s.kana or len(words) == 1:
            words = [short(w) for w in words]
            put("l:" + "".join(words), FULL)
            if len(words) == 2:
                put("l:" + words[1] + words[0], FULL)
            if len(words) == 1 and len(words[0]) <= 10:
                put("p:" + words[0], PART)
            return
        if len(words) > 2:
            words = [words[0], words[-1]] if len(words[1]) == 1 else [words[0], "".join(words[1:])]
        first, last = words if not s.comma else words[::-1]
        if s.words[0].isupper() and len(first) > 2 and not s.words[1].isupper():
            first, last = last, first
        for f, l in ((first, last),):
            put("l:" + f + l, FULL), put("l:" + l + f, FULL)
            put("l:" + short(f) + short(l), FULL), put("l:" + short(l) + short(f), FULL)
            if len(f) > 1 and not (s.words[0].endswith(".")):
                put("i:" + f[0] + "|" + l, INITIAL)
                for n in range(2, min(5, len(f))):
                    put("a:" + f[:n] + "|" + l, SHORTENED)
                for n in NICKNAMES.get(f, "").split():
                    put("l:" + n + l, SHORTENED), put("a:" + n + "|" + l, SHORTENED)
            elif f:
                put(("i:" if len(f) <= 2 else "a:") + (f[0] if len(f) <= 2 else f) + "|" + l, INITIAL)
            put("p:" + l, PART)


def queries(text: str) -> list[tuple[str, float]]:
    """Forms under which a spelling may be found, with what they cost beside the form itself."""
    s = Spelling(text)
    if not s.solid:
        return []
    out: list[tuple[str, float]] = [("f:" + s.solid.casefold(), 0.0)]
    if s.han:
        if s.inside:
            return [("g:" + s.solid + "|" + s.inside, 0.0)]
        out += [("h:" + s.solid, 0.0), ("s:" + s.solid, 0.0)]
        for cut in range(1, len(s.solid)):
            # Another character of the same sound.
            for r in readings(s.solid[cut:]):
                out.append(("g:" + s.solid[:cut] + "|" + r, 1.5))
        return [*out, *(("l:" + r, 2.0) for r in sorted(readings(s.solid)))] if s.firm or len(s.solid) > 3 else out
    words = [short(romaji(w)) if s.kana else _latin(w) for w in s.words]
    words = [w for w in words if w]
    solid = "".join(words)
    if s.kana:
        runs = re.findall(r"[a-z]|[^a-z]+", s.solid.casefold())
        for spell in (short, str):  # a lost kana may leave two vowels that are no long one
            parts = [p for run in runs for p in ([run] if run.isascii() else syllables(spell(romaji(run))))]
            out.append(("y:" + sound_key(parts), 0.0))
    out += [("l:" + solid, 0.0), ("l:" + short(solid), 0.0)]
    if len(words) == 1:
        out += [("p:" + solid, 0.0), ("p:" + short(solid), 0.0)]
    if len(words) == 2 and not s.kana:
        for a, b in (words, words[::-1]):
            raw = s.words[0] if a == words[0] else s.words[1]
            if len(a) == 1 or len(a) == 2 and raw.isupper():
                out += [("i:" + a[0] + "|" + b, 0.2 * len(a)), ("i:" + a[0] + "|" + short(b), 0.2 * len(a))]
                out += [("m:" + a + "|" + b, 0.0)] if len(a) == 2 else []
            elif len(a) <= 5:
                out.append(("a:" + a + "|" + b, 0.0))
        out.append(("l:" + words[1] + words[0], 0.0))
    if len(words) == 3 and len(words[1]) == 1:
        out.append(("l:" + words[0] + words[2], 0.3))
    if len(words) == 3 and len(words[2]) == 1:
        out.append(("l:" + words[1] + words[0], 0.3))
    return out


def middle(text: str) -> str | None:
    """'m:fm|last' of First M. Last, None of anything else."""
    words = [_latin(w) for w in Spelling(text).words]
    return f"m:{words[0][0]}{words[1]}|{words[2]}" if len(words) == 3 and len(words[1]) == 1 and len(words[0]) > 1 and len(words[2]) > 1 else None


def _hashes(word: str, k: int) -> list[int]:
    return [xxhash.xxh64_intdigest(w) - (1 << 63) for w in deletions(word, k)]


def form_hashes(key: str) -> list[int]:
    """Keys under which mistyped spellings of a form are found; none for short forms."""
    if key[:2] in ("l:", "f:") and len(key) >= 8:
        return _hashes(key[2:], 2 if len(key) >= 10 else 1)
    if key[0] == "y" or key[0] == "h" and len(key) >= 5 or key[0] in "iap" and len(key) >= 8:
        return _hashes(key[2:], 1)
    return []


def query_hashes(key: str, written: bool) -> list[int]:
    """Keys under which a spelling looks for the forms that it may be an error of."""
    word = key[2:]
    if written and key[0] != "h" or key[0] not in "lfiapyh" or len(word) < (5 if key[0] in "lfiap" else 3):
        return []
    return _hashes(word, 2 if len(word) >= 8 else 1)


def errors(key: str, form: str) -> int | None:
    """How many errors lead from a form to what was written, None if more than the form allows."""
    if form[0] != key[0] and not (form[0] in "lf" and key[0] in "lf"):
        return None
    word, target = key[2:], form[2:]
    if form[0] in "ia" and word.find("|") < 4 and word.split("|")[0] != target.split("|")[0]:
        return None  # initials are not mistyped for others
    limit = 2 if len(word) >= 8 and form[0] in "lf" else 1
    # Of written characters only one too many or too few is an error: another one is another name.
    if form[0] == "h" and len(word) == len(target):
        return None
    d = distance(word, target, limit)
    return d if d <= limit else None


@lru_cache(maxsize=1 << 15)
def deletions(word: str, k: int) -> frozenset[str]:
    """All strings that arise from `word` by at most `k` deletions."""
    out = {word}
    for n in range(1, k + 1):
        for gone in combinations(range(len(word)), n):
            out.add("".join(c for i, c in enumerate(word) if i not in gone))
    return frozenset(out)


def distance(a: str, b: str, limit: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours from a to b; limit + 1 if there are more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return last[-1]


#: Forms whose costs differ by less than this fit a spelling alike.
ALIKE = 0.45
#: Occurrences that every registered person counts as having beside those seen.
PSEUDO = 8.0


def _rows(df: DataFrame, schema: str, make: Callable[..., Iterable[tuple]], *columns: str) -> DataFrame:
    """Rows made from each row of `df`, in batches, over as many tasks as shuffles have."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([out for row in zip(*(pdf[c] for c in columns)) for out in make(*row)], columns=names)

    return df.select(*columns).mapInPandas(run, schema)


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def registered_forms(people: DataFrame) -> DataFrame:
    """person_id, key, cost of every form of every registered row."""
    rows = _spread(people.where("person_id IS NOT NULL").select(F.col("person_id").cast("bigint").alias("person_id"), "display_name", "aliases").distinct(), "person_id")
    # What one row shows of a part of a name holds for all rows that have the part.
    shown = _rows(rows, "part string, reading string, given boolean, head string", lambda d, a: Row(d, a).shown(), "display_name", "aliases").distinct()
    told = shown.groupBy("part").agg(F.collect_set("reading").alias("readings"), F.max("given").alias("given"), (F.min("head") < F.max("head")).alias("several"))
    parts = _rows(rows, "person_id bigint, display_name string, aliases array<string>, part string", lambda i, d, a: ((i, d, a, p) for p in (Row(d, a).written() or [""])), "person_id", "display_name", "aliases")
    # Of one row: as many parts as its name has characters, twice.
    hinted = parts.join(told, "part", "left").groupBy("person_id", "display_name", "aliases").agg(F.collect_list(F.struct("part", "readings", "given", "several")).alias("known"))

    def forms(person, display, aliases, known):
        hints = [(k["part"], r) for k in known for r in (k["readings"] if k["readings"] is not None else ())] + [(k["part"], None) for k in known if k["given"]]
        row = Row(display, aliases, hints, [k["part"] for k in known if k["several"] and not k["given"]])
        return [(person, key, cost) for key, cost in row.forms().items()]

    return _rows(hinted, "person_id bigint, key string, cost double", forms, "person_id", "display_name", "aliases", "known").groupBy("person_id", "key").agg(F.min("cost").alias("cost"))


def _near(asked: DataFrame, forms: DataFrame, q: str) -> DataFrame:
    """`q`, form, d and extra of every form that a spelling may be an error of."""
    hashed = _rows(forms.select("key").distinct(), "form string, h bigint", lambda key: ((key, h) for h in form_hashes(key)), "key")
    met = asked.select(q, "key", "extra", F.explode("hashes").alias("h")).join(hashed, "h").select(q, "key", "extra", "form").distinct()
    return _rows(met, f"{q} {asked.schema[q].dataType.simpleString()}, form string, d int, extra double", lambda label, key, extra, form: [] if (d := errors(key, form)) is None else [(label, form, d, extra)], q, "key", "extra", "form")


def _decided(matches: DataFrame, q: str) -> DataFrame:
    """`q`, lo, hi and d: the least and greatest person of those that fit best; fewer errors come first.  Literal spellings (cost null) always count."""
    by = W.partitionBy(q)
    least = matches.withColumn("_d", F.min("d").over(by)).where("d = _d").withColumn("_c", F.min("cost").over(by))
    fit = least.where(F.col("cost").isNull() | (F.col("cost") < F.col("_c") + ALIKE))
    return fit.groupBy(q).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("d").alias("d"))


def _spelled(people: DataFrame) -> DataFrame:
    """person_id, own, label, whole: display names (own) and aliases, and whether one may show that its row repeats another.

    Aliases count for that only where they spell a whole name, and the display name is not in Chinese characters.
    """
    rows = people.where("person_id IS NOT NULL").select(F.col("person_id").cast("bigint").alias("person_id"), "display_name", "aliases")

    def each(person, display, aliases):
        latin = not _HAN.search(display or "")
        yield person, True, display, True
        for alias in aliases if aliases is not None else ():
            if alias:
                s = Spelling(alias)
                yield person, False, alias, latin and len(s.solid) > 6 and not s.firm

    made = _rows(_spread(rows.distinct(), "person_id"), "person_id bigint, own boolean, label string, whole boolean", each, "person_id", "display_name", "aliases")
    return made.where("trim(label) != ''").distinct()


def _roots(spelled: DataFrame, asked: DataFrame, near: DataFrame, forms: DataFrame) -> DataFrame:
    """person_id, root: the least row that registers the same person or firm; rows registered once are left out.

    A row repeats an earlier one if its display name, or else an alias that spells a whole name, fits that one only.
    """
    # The two least rows of each form tell whether one or several come before a row.
    rank = F.row_number().over(W.partitionBy("key", "cost").orderBy("person_id"))
    two = forms.withColumn("r", rank).where("r <= 2").groupBy("key", "cost").agg(F.min("person_id").alias("p1"), F.max("person_id").alias("p2"))
    who = spelled.where("whole").select("person_id", "own", "label")
    exact = who.join(asked.select("label", "key", "extra", F.lit(0).alias("d")), "label").where(F.col("own") | (F.col("extra") <= JOINED))
    mistyped = who.where("own").join(near.select("label", F.col("form").alias("key"), "extra", "d"), "label")
    met = exact.unionByName(mistyped).join(two, "key").where("p1 < person_id").withColumn("cost", F.col("cost") + F.col("extra")).where(F.col("own") | (F.col("cost") <= JOINED))
    fits = met.select(F.struct("person_id", "own", "label").alias("q"), "d", "cost", F.col("p1").alias("lo"), F.when(F.col("p2") < F.col("person_id"), F.col("p2")).otherwise(F.col("p1")).alias("hi"))
    best = _decided(fits, "q").groupBy("q.person_id").agg(F.min(F.struct(~F.col("q.own"), "d", "lo", "hi")).alias("x"))
    links = cut_lineage(best.select("person_id", "x.lo", "x.hi"))
    up = links.select(F.col("person_id").alias("hi"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"))
    # Two that come before are one if the later of them repeats the earlier.
    roots = cut_lineage(links.join(up, "hi", "left").where("lo = hi OR (up_lo = lo AND up_hi = lo)").select("person_id", F.col("lo").alias("root")))
    while True:  # a row may repeat one that repeats another
        above = roots.select(F.col("person_id").alias("root"), F.col("root").alias("top"))
        if roots.join(above, "root", "left_semi").isEmpty():
            return roots
        roots = cut_lineage(roots.join(above, "root", "left").select("person_id", F.coalesce("top", "root").alias("root")))


def _summed(forms: DataFrame) -> DataFrame:
    """key, cost, lo, hi: the least and greatest person of each form."""
    return forms.groupBy("key", "cost").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))


def attached(labels: DataFrame, people: DataFrame) -> DataFrame:
    """label, person_id and exact (whether without a typing error) of every label and registered spelling that denotes one person.

    `labels` has label and n, how often it stands; each label once.  Blank and unnamed labels denote nobody.
    """
    forms = cut_lineage(registered_forms(people))
    spelled = cut_lineage(_spelled(people))
    every = labels.unionByName(spelled.select("label", F.lit(0).cast("bigint").alias("n"))).groupBy("label").agg(F.sum("n").alias("n"))

    def ask(label, n):
        found = queries(label)
        written = any(key[0] == "h" for key, _ in found)
        named = lettered(label) is None
        return [(label, n, named, "=" + cleaned(label).casefold(), 0.0, [])] + [(label, n, named, key, extra, query_hashes(key, written)) for key, extra in found]

    asked = cut_lineage(_rows(_spread(every, "label"), "label string, n bigint, named boolean, key string, extra double, hashes array<bigint>", ask, "label", "n"))
    # Registered spellings may be errors of others; of the labels only those that are no known form.
    fitting = asked.join(forms, "key", "left_semi").select("label").distinct()
    unknown = asked.where("named AND size(hashes) > 0").join(fitting, "label", "left_anti")
    own = asked.where("size(hashes) > 0").join(spelled.where("own").select("label").distinct(), "label", "left_semi")
    near = cut_lineage(_near(unknown.unionByName(own), forms, "label").distinct())
    roots = _roots(spelled, asked, near, forms)
    to_root = lambda df: df.join(roots, "person_id", "left").withColumn("root", F.coalesce("root", "person_id"))
    # A row that repeats another adds whole forms to it, but no parts of names.  Literal spellings have no cost.
    literal = _rows(spelled, "person_id bigint, key string", lambda i, t: [(i, "=" + cleaned(t).casefold())], "person_id", "label").withColumn("cost", F.lit(None).cast("double"))
    of_root = to_root(forms.unionByName(literal.select(forms.columns))).where("cost IS NULL OR root = person_id OR cost < " + str(PART))
    known = cut_lineage(_summed(of_root))
    named = asked.where("named").select("label", "n", "key", "extra")
    fit = lambda table: named.join(table, "key").select("label", F.lit(0).alias("d"), (F.col("cost") + F.col("extra")).alias("cost"), "lo", "hi")
    matches = cut_lineage(fit(known))
    # Middle initials of whole names tell persons of one initial apart.
    middles = _rows(_decided(matches, "label").where("lo = hi"), "key string, root bigint", lambda t, p: [(m, p)] if (m := middle(t)) else [], "label", "lo").distinct().withColumn("cost", F.lit(INITIAL - 1.0))
    exact = cut_lineage(_decided(matches.unionByName(fit(_summed(middles))), "label"))
    sums = every.join(exact.where("lo = hi"), "label").groupBy("lo").agg(F.sum("n").alias("prior"))
    # The rest may be mistyped.  A spelling that stands often enough to have variants is a candidate of its own.
    rest = unknown.where("n > 0").join(exact, "label", "left_anti")
    person = _decided(near.join(known.withColumnRenamed("key", "form"), "form").select("label", "d", (F.col("cost") + F.col("extra")).alias("cost"), "lo", "hi"), "label").where("lo = hi")
    share = float(ERROR_SHARE)
    frequent = rest.where((F.col("n") > 1 / share) & (F.col("extra") == 0) & F.col("key").rlike("^[lfhy]:")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("x"))
    other = _near(rest, frequent, "label").join(frequent.withColumnRenamed("key", "form"), "form").where("x.label != label").groupBy("label").agg(F.max(F.log("x.n") + F.col("d") * F.log(F.lit(share))).alias("other"))
    scored = person.join(rest.select("label", "n").distinct(), "label").join(sums, "lo", "left").join(other, "label", "left")
    posterior = F.log(F.coalesce("prior", F.lit(0)) + PSEUDO) + F.col("d") * F.log(F.lit(share)) + F.log(F.lit(2.0))
    mistyped = scored.where(posterior > F.greatest(F.log("n"), F.coalesce("other", F.lit(-99.0)))).select("label", F.col("lo").alias("person_id"), F.lit(False).alias("exact"))
    return exact.where("lo = hi").select("label", F.col("lo").alias("person_id"), F.lit(True).alias("exact")).unionByName(mistyped)


def _counted(utterances: DataFrame) -> DataFrame:
    return utterances.where("speaker IS NOT NULL AND speaker != ''").groupBy(F.col("speaker").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def linked_names(utterances: DataFrame, people: DataFrame) -> DataFrame:
    """job_id, spelling, person_id: every label of a job, and (job_id 0) every registered spelling, that denotes one registered person.

    person_id is the least of that person's rows.  Null, empty and unnamed labels, unregistered names and
    spellings that fit two registered people give no row.
    """
    known = cut_lineage(attached(_counted(utterances), people))
    of_jobs = utterances.select("job_id", F.col("speaker").alias("label")).where("label IS NOT NULL").distinct().join(known.select("label", "person_id"), "label")
    spelled = people.select(F.explode(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("label")).where("label IS NOT NULL AND label != ''").distinct()
    registered = spelled.join(known.where("exact").select("label", "person_id"), "label").withColumn("job_id", F.lit(0).cast("bigint"))
    both = of_jobs.unionByName(registered.select(of_jobs.columns))
    return both.select("job_id", F.col("label").alias("spelling"), "person_id").distinct()
