"""Clean, ordered speaker turns of transcripts.

One Aho-Corasick automaton holds the labels, the fillers and the words of sound notes.  What it finds in
a text are candidates; rules of context decide (a sound word counts inside brackets, a filler only as a
word of its own, a label only at the head before its mark).  The accepted spans and the clock stamps are
subtracted from the text as intervals.  The labels, those of the utterances and those at the heads of texts, are
told apart once each and joined back by their spelling.  Labels too many for the automaton are met at the heads of texts
by a join, with the same result: the longest label that begins there and stands before a mark.  Turns are runs of one speaker, made by windows over time slots
of a job and a window over the slots' first and last runs, so that no task orders a whole large job.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from talkgrid.llm.names import attached, cleaned, lettered
from talkgrid.operators.durable import cut_lineage
from talkgrid.operators.intervals import IntervalMap, milliseconds

SLOT_MS = 10 * 60 * 1000
#: Distinct labels that may be broadcast and may enter the automaton, after they are counted: some 8 MB.  More are joined; the turns are the same.
LABELS = 1 << 17

# Hesitations, by language.
FILLERS = (
    "えー", "えーと", "えーっと", "ええと", "ええっと", "えっと", "えっとー", "えと", "あー", "あのー", "あのう", "うー", "うーん", "うーんと", "んー", "んーと", "そのー", "まあー", "ん…",
    "um", "umm", "uhm", "uh", "uhh", "er", "erm", "hm", "hmm", "mm", "mmm", "ah", "eh", "em", "este", "eeh", "äh", "ähm", "öh", "öhm", "hm-hm",
    "呃", "嗯", "啊", "那个…", "额", "อืม", "เอ่อ", "อ่า", "เออ", "अं", "उम्", "उम", "अँ", "हम्म",
)
#: Fillers that are also words; they need a mark of hesitation after them.
NEED_MARK = {"este", "em", "er", "ah", "eh", "啊", "mm", "えと", "उम", "額"}
# Words that tell of sounds, in any bracket.
SOUNDS = (
    "笑", "笑い", "笑い声", "拍手", "雑音", "聞き取れず", "聞き取り不能", "ため息", "咳", "咳払い", "音楽", "無音", "沈黙", "間", "物音", "ノイズ", "♪", "♪♪", "noise", "noises", "laughs", "laughter", "laughing", "coughs", "cough", "coughing", "sighs", "sigh", "applause",
    "crosstalk", "inaudible", "blank_audio", "blank audio", "music", "silence", "unintelligible", "background noise", "clears throat", "pause", "lachen", "lacht", "husten", "rauschen", "beifall", "risas", "ruido", "tos", "aplausos", "inaudible.", "笑声", "掌声", "噪音", "听不清", "หัวเราะ", "เสียงรบกวน", "हँसी", "शोर",
)
# Words that label unnamed speakers.
UNNAMED = ("話者", "speaker", "unknown", "不明")
_OPEN, _CLOSE = "(（[［【〈<＜*｛{♪", ")）]］】〉>＞*｝}♪"
_MARKS = ",、，…。.؟?？!！ー~〜"
STAMP = re.compile(r"[\[(（<＜【〈]\s*(?:\d{1,2}[:：])?\d{1,3}(?:[:：]\d{2}(?:[.,]\d+)?|\.\d+)\s*[\])）>＞】〉]\s*|(?<![\d:])\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?\s+[-–—]\s+|^\s*\d{1,2}:\d{2}(?::\d{2})?\s+[-–—]\s+")
_HAS_DIGIT = re.compile(r"\d[:：.]\d")
_HEAD = re.compile(r"^\s*(?:\[[^\]]{1,40}\]|【[^】]{1,40}】|[^:：>＞。！？!?\n]{1,48}?)\s*[:：>＞]\s*")
_NAME_LIKE = re.compile(r"^(?:[A-ZÀ-Þ][\w'’.-]*(?:\s+(?:[A-ZÀ-Þ][\w'’.-]*|de|van|von|der|la)){1,3}|[一-鿿々ノヶケ]{1,5}[\s　]?[一-鿿々ぁ-んァ-ヺー]{1,5}|[ァ-ヺー]{2,10}[・\s][ァ-ヺー]{2,10})$")


def automaton(labels: list[str] = ()) -> ahocorasick.Automaton:
    """Fillers, sound words and labels; values are (kind, pattern), in lower case."""
    found = ahocorasick.Automaton()
    for kind, words in (("label", [*labels, *UNNAMED]), ("sound", SOUNDS), ("filler", FILLERS)):
        for word in words:
            word = _lower(word)
            kinds = found.get(word, ())
            found.add_word(word, tuple(dict.fromkeys((*kinds, (kind, word)))))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    """Lower case, every character by itself and without changing their number, so that parts of a text and labels come out alike."""
    low = text.lower()
    return (low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)).replace("ς", "σ")


def _joins(a: str, b: str) -> bool:
    """Whether two neighbours belong to one word."""
    if not a or not b:
        return False
    if unicodedata.category(b)[0] == "M":
        return True
    latin = lambda c: c.isalnum() and ord(c) < 0x0900
    indic = lambda c: 0x0900 <= ord(c) < 0x0E00 and unicodedata.category(c)[0] in "LM"
    return latin(a) and latin(b) or indic(a) and indic(b)


_AFTER_LABEL = re.compile(r"\s*[\]】]?\s*[:：>＞]\s*")
_BEFORE_LABEL = re.compile(r"\s*[\[【]?\s*")
_MARK = re.compile("[:：>＞]")
_OTHERS = pa.list_(pa.struct([("n", pa.int32()), ("label", pa.string()), ("left", pa.int32()), ("looks", pa.string()), ("certain", pa.bool_())]))


def _after_stamps(text: str, marks: list[tuple[int, int, str]]) -> int:
    """Where the clock stamps at the head end."""
    at = 0
    for s, e, kind in marks:
        if kind == "stamp" and not text[at:s].strip():
            at = e
    return at


def _head_start(text: str, marks: list[tuple[int, int, str]]) -> int:
    """Where a label at the head would begin: after clock stamps and an opening bracket."""
    return _BEFORE_LABEL.match(text, _after_stamps(text, marks)).end()


def scanned(text: str, found: ahocorasick.Automaton) -> tuple[list[tuple[int, int, str]], dict[int, list[int]]]:
    """(start, end, kind) of clock stamps, sound notes and fillers, in order, and the ends of the labels that begin at the head, by its place."""
    out = [(m.start(), m.end(), "stamp") for m in STAMP.finditer(text)] if _HAS_DIGIT.search(text) else []
    low = _lower(text)
    hits: dict[tuple[str, int], int] = {}
    labels: dict[int, list[int]] = {}
    head = _head_start(text, out)
    for end, values in found.iter(low):
        for kind, word in values:
            start = end + 1 - len(word)
            if kind == "label":
                if start == head:
                    labels.setdefault(start, []).append(end + 1)
            else:
                hits[kind, start] = max(end + 1, hits.get((kind, start), 0))  # the longest that begins here
    for (kind, start), end in sorted(hits.items(), key=lambda x: x[0][1]):
        if kind == "sound":
            a, b = start, end
            while a > 0 and text[a - 1] == " ":
                a -= 1
            while b < len(text) and text[b] == " ":
                b += 1
            if a > 0 and b < len(text) and text[a - 1] in _OPEN and text[b] in _CLOSE:
                while a > 0 and text[a - 1] in _OPEN:
                    a -= 1
                while b < len(text) and text[b] in _CLOSE:
                    b += 1
                out.append((a, b, "sound"))
        elif kind == "filler":
            if any(s <= start < e for s, e, _ in out):
                continue
            before, after = text[start - 1 : start], text[end : end + 1]
            word = low[start:end]
            if _joins(before, text[start]) or _joins(text[end - 1], after):
                continue
            if "ぁ" <= word[0] <= "ん" and (before and ("ぁ" <= before <= "ヺ" or before == "ー") or after == "ー"):
                continue
            if word in NEED_MARK and after not in _MARKS and not (end == len(text) and start == 0):
                continue
            b = end
            while b < len(text) and text[b] in "ー~〜…、，,." and not (text[b] == "." and text[b + 1 : b + 2].isdigit()):
                b += 1
            out.append((start, b, "filler"))
    out.sort()
    kept: list[tuple[int, int, str]] = []
    for s, e, kind in out:
        if kept and s < kept[-1][1]:
            if kept[-1][2] == "filler" and kind != "filler":
                kept[-1] = (min(s, kept[-1][0]), max(e, kept[-1][1]), kind)
            continue
        kept.append((s, e, kind))
    return kept, labels


def spans(text: str, found: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of clock stamps, sound notes and fillers, in order; kinds are stamp, sound, filler."""
    return scanned(text, found)[0]


def subtracted(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the intervals, white space made single."""
    held = IntervalMap()
    for s, e in gone:
        held.insert(s, e)
    out, at = [], 0
    for s, e in held.periods():
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return re.sub(r"\s+", " ", " ".join(p for p in (x.strip() for x in out) if p)).strip()


def head_label(text: str, marks: list[tuple[int, int, str]], labels: dict[int, list[int]] | None = None) -> tuple[int, str] | None:
    """(end, label) of what may name a speaker at the head of a text, after clock stamps and before a colon or angle.

    The longest label of the automaton that stands there is taken; where none does, whatever stands before the mark.
    """
    at = _after_stamps(text, marks)
    start = _head_start(text, marks)
    for end in sorted((labels or {}).get(start, ()), reverse=True):
        mark = _AFTER_LABEL.match(text, end)
        if mark:
            return mark.end(), text[start:end]
    m = _HEAD.match(text[at:])
    if not m:
        return None
    label = re.sub(r"\s*[:：>＞]\s*$", "", m.group()).strip()
    return (at + m.end(), label) if label else None


def possible_ends(text: str, start: int, lengths: frozenset[int]) -> list[int]:
    """Where a label of one of these lengths that begins at `start` may end, the longest first: all places where `_AFTER_LABEL` fits."""
    ends, longest = [], max(lengths, default=0)
    for mark in _MARK.finditer(text, start):
        end, bracket, here = mark.start(), False, []
        while end > start:
            if end - start in lengths:
                here.append(end)
            c = text[end - 1]
            if not c.isspace() and (bracket or c not in "]】"):
                break
            bracket = bracket or not c.isspace()
            end -= 1
        if end - start > longest:
            break
        ends += here[::-1]
    return ends[::-1]


def head_key(label: str) -> tuple[str | None, bool]:
    """The key of a speaker by the looks of a label, and whether it is certain; None if only a register can tell."""
    letter = lettered(label)
    if letter is not None:
        return "#" + letter if letter else "unknown", True
    name = cleaned(label)
    return "n:" + name.casefold() if _NAME_LIKE.match(name) else None, False


def head_speaker(text: str, marks: list[tuple[int, int, str]]) -> tuple[int, str] | None:
    """(end, key) of the lettered speaker or the name at the head of a text."""
    head = head_label(text, marks)
    key = head_key(head[1])[0] if head is not None else None
    return (head[0], key) if key is not None else None


def _cleared(text: str, marks: list[tuple[int, int, str]], head: int) -> str:
    rest = subtracted(text, [(s, e) for s, e, _ in marks] + ([(0, head)] if head else []))
    return rest if any(unicodedata.category(c)[0] in "LNS" for c in rest) else ""


def analysed(text: str | None, found: ahocorasick.Automaton) -> tuple[str, str | None, str | None, str | None, bool]:
    """The clean text with what stands at its head (unless that is certain to be a label), the same without it, the label there, its key by its looks, and whether that is certain.

    A clean text is '' if only hesitations and sound notes are left; the others are None where nothing stands at the head.
    """
    return _analysed(text, found, frozenset())[:5]


def _analysed(text: str | None, found: ahocorasick.Automaton, lengths: frozenset[int]) -> tuple[str, str | None, str | None, str | None, bool, str | None, list[dict] | None]:
    """`analysed`, and what else may be the label at the head if there are labels of these lengths that the automaton does not hold.

    That is the text from the head's begin to the end of the longest, and of each its length, itself in lower case, how many
    characters of the clean text come after it, its key and whether that is certain; None where it makes no difference.
    The clean text then has what stands at its head in any case.
    """
    if text is None or not text.strip():
        return "", None, None, None, False, None, None
    marks, labels = scanned(text, found)
    head = head_label(text, marks, labels)
    start = _head_start(text, marks)
    ends = possible_ends(text, start, lengths) if lengths else []
    if ends:
        held = max((e for e in labels.get(start, ()) if _AFTER_LABEL.match(text, e)), default=start)
        ends = [e for e in ends if e > held]
        if ends and head == (_AFTER_LABEL.match(text, ends[-1]).end(), text[start : ends[-1]]):
            ends.pop()  # the same head, a label or not
    if head is None and not ends:
        return _cleared(text, marks, 0), None, None, None, False, None, None
    key, certain = head_key(head[1]) if head is not None else (None, False)
    cut = _cleared(text, marks, head[0]) if head is not None else None
    whole = cut if certain and not ends else _cleared(text, marks, 0)
    if not ends:
        return whole, cut, head[1], key, certain, None, None
    others = []
    for end in ends:
        looks, sure = head_key(text[start:end])
        left = len(_cleared(text, marks, _AFTER_LABEL.match(text, end).end()))
        others.append({"n": end - start, "label": _lower(text[start:end]), "left": left, "looks": looks, "certain": sure})
    return whole, cut, head[1] if head is not None else None, key, certain, text[start : ends[0]], others


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The key of the speaker that each label names; null if it names nobody."""
    for pdf in batches:
        own = []
        for label, person in zip(pdf["label"], pdf["person_id"]):
            letter = lettered(label)
            if pd.notna(person):
                own.append(f"p{int(person)}")
            elif letter is not None:
                own.append("#" + letter if letter else None)
            else:
                own.append("n:" + cleaned(label).casefold())
        yield pd.DataFrame({"label": pdf["label"], "key": pd.array(own, dtype="object")})


def _with_keys(rows: DataFrame, column: str, keys: DataFrame, few: bool, name: str) -> DataFrame:
    """`rows` with the key of the label in `column`; rows without a label meet none, a popular label is split at run time."""
    table = keys.select(F.col("label").alias(column), F.col("key").alias(name))
    if few:
        return rows.join(F.broadcast(table), column, "left")
    none = rows.where(F.col(column).isNull()).withColumn(name, F.lit(None).cast("string"))
    return rows.where(F.col(column).isNotNull()).join(table, column, "left").unionByName(none)


def _lowered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"label": pd.array([_lower(x) for x in pdf["label"]], dtype="object")})


def _longest_labels(read: DataFrame, own: DataFrame) -> DataFrame:
    """`read` with the longest label of `own` at the head where one stands there, as an automaton of them all would find it."""
    read = cut_lineage(read)
    spelled = own.select("label").mapInPandas(_lowered, "label string").distinct()
    some = read.where("front IS NOT NULL")
    met = some.select("front", F.explode("others").alias("x")).select("front", "x.n", "x.label").distinct().join(spelled, "label", "left_semi").groupBy("front").agg(F.collect_set("n").alias("met"))
    best = F.array_max(F.filter("others", lambda x: F.array_contains("met", x["n"])))  # n comes first in it
    told = some.join(met, "front", "left").withColumn("best", best)
    instead = lambda value, name: F.when(F.col("best").isNotNull(), value).otherwise(F.col(name)).alias(name)
    same = [n for n in read.columns if n not in ("cut", "head", "looks", "certain")]
    # A clean text without its head is the end of the text with it.
    told = told.select(*same, instead(F.right("whole", F.col("best.left")), "cut"), instead(F.left("front", F.col("best.n")), "head"), instead(F.col("best.looks"), "looks"), instead(F.col("best.certain"), "certain"))
    told = told.withColumn("whole", F.when(F.col("certain"), F.col("cut")).otherwise(F.col("whole")))
    return read.where("front IS NULL").unionByName(told)


def speaker_turns(utterances: DataFrame, people: DataFrame, slot_ms: int = SLOT_MS, with_text: bool = True) -> DataFrame:
    """job_id, first_utt_id, last_utt_id, speaker, start_ms, end_ms and text of every turn.

    Utterances delivered more than once count once.  A null start sorts first.  Utterances with nothing to
    say break no turn and belong to none.  end_ms is null where no utterance of the turn has an end.
    """
    own = cut_lineage(utterances.where("speaker IS NOT NULL AND speaker != ''").groupBy(F.col("speaker").alias("label")).agg(F.count(F.lit(1)).alias("n")))
    few = own.count() <= LABELS
    # With more labels than that the automaton holds none of them; whatever is as long as one and stands before a mark is joined to them.
    lengths = frozenset() if few else frozenset(r.n for r in own.select(F.length("label").alias("n")).distinct().collect())
    shared = utterances.sparkSession.sparkContext.broadcast((automaton([r.label for r in own.select("label").collect()] if few else []), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, lengths = shared.value
        for batch in batches:
            made = [_analysed(text, found, lengths) for text in batch.column("text").to_pylist()]
            columns = list(zip(*made)) if made else [()] * 7
            if not with_text:  # only whether anything is left
                columns[:2] = [["x" if t else t for t in c] for c in columns[:2]]
            i = batch.schema.get_field_index("text")
            arrays = [pa.array(c, {4: pa.bool_(), 6: _OTHERS}.get(k, pa.string())) for k, c in enumerate(columns)]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != i), *arrays], names=[*names, "whole", "cut", "head", "looks", "certain", "front", "others"])

    rows = utterances.select("utt_id", "job_id", "utt_idx", milliseconds(F.col("start")).alias("ms"), milliseconds(F.col("end")).alias("end_ms"), "speaker", "text")
    read = rows.mapInArrow(run, "utt_id bigint, job_id bigint, utt_idx int, ms bigint, end_ms bigint, speaker string, whole string, cut string, head string, looks string, certain boolean, front string, others array<struct<n:int,label:string,left:int,looks:string,certain:boolean>>")
    read = (read if few else _longest_labels(read, own)).drop("front", "others").where("whole != ''")
    once = cut_lineage(read.dropDuplicates(["utt_id"]))
    heads = once.where("head IS NOT NULL AND NOT certain").groupBy(F.col("head").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    labels = own.unionByName(heads).groupBy("label").agg(F.sum("n").alias("n"))
    persons = cut_lineage(attached(labels, people).select("label", "person_id"))
    keys = cut_lineage(own.join(persons, "label", "left").mapInPandas(_keyed, "label string, key string"))
    known = persons.join(heads, "label", "left_semi").select("label", F.concat(F.lit("p"), "person_id").alias("key"))
    placed = _with_keys(_with_keys(once, "speaker", keys, few, "own"), "head", known, few and known.count() <= LABELS, "person")
    # What stands at the head is a speaker if it is a lettered one, somebody registered, or looks like a name.
    at_head = F.when(F.col("certain"), F.col("looks")).otherwise(F.coalesce("person", "looks"))
    named = placed.withColumn("who", F.coalesce("own", at_head, F.lit("unknown"))).withColumn("text", F.when(at_head.isNotNull(), F.col("cut")).otherwise(F.col("whole"))).where("text != ''")
    named = named.select("utt_id", "job_id", "utt_idx", "ms", "end_ms", "who", *(["text"] if with_text else []))
    # Runs inside a slot of a job.
    order = F.struct(F.coalesce("ms", F.lit(-(1 << 62))).alias("ms"), "utt_idx", "utt_id")
    placed = named.withColumn("slot", F.floor(F.coalesce("ms", F.lit(0)) / F.lit(slot_ms))).withColumn("o", order)
    inside = W.partitionBy("job_id", "slot").orderBy("o")
    before = F.lag("who").over(inside)
    runs = placed.withColumn("new", F.when(before.isNull() | (before != F.col("who")), 1).otherwise(0)).withColumn("run", F.sum("new").over(inside))
    parts = [F.min("o").alias("first"), F.max("o").alias("last"), F.first("who").alias("who"), F.min("ms").alias("start_ms"), F.max("end_ms").alias("end_ms")]
    if with_text:
        parts.append(F.array_sort(F.collect_list(F.struct("o", "text"))).alias("texts"))
    made = runs.groupBy("job_id", "slot", "run").agg(*parts)
    ends = made.withColumn("edge", (F.col("run") == 1) | (F.col("run") == F.max("run").over(W.partitionBy("job_id", "slot"))))
    ends = cut_lineage(ends)
    # A slot's first run may go on from the last run before it; only these rows of a job meet in one window.
    across = W.partitionBy("job_id").orderBy("first")
    goes_on = (F.lag("who").over(across) == F.col("who")) & (F.lag("slot").over(across) != F.col("slot"))
    edges = ends.where("edge").withColumn("turn", F.sum(F.when(goes_on, 0).otherwise(1)).over(across))
    merged = edges.groupBy("job_id", "turn").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.first("who").alias("who"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        *([F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "texts"))), lambda x: x["texts"])).alias("texts")] if with_text else []),
    )
    columns = ["job_id", "first", "last", "who", "start_ms", "end_ms", *(["texts"] if with_text else [])]
    turns = merged.select(columns).unionByName(ends.where("NOT edge").select(columns))
    text = [F.array_join(F.transform("texts", lambda x: x["text"]), " ").alias("text")] if with_text else []
    return turns.select("job_id", F.col("first.utt_id").alias("first_utt_id"), F.col("last.utt_id").alias("last_utt_id"), F.col("who").alias("speaker"), "start_ms", "end_ms", *text)
