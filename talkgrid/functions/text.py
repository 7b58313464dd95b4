"""Text expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# How doubtful stretches are marked, and how unnamed speakers are labelled.
RED_OPEN, RED_CLOSE = '<span style="color:red">', "</span>"
SENTENCE_MARKS = "。？！?!"
UNNAMED = r"^(?:話者|Speaker|SPEAKER|speaker)[ _]?.{0,2}$|^(?:不明|unknown|\?)$"


def strip_marks(marked: Column) -> Column:
    """The text without red tags; '' for null."""
    return F.regexp_replace(F.coalesce(marked, F.lit("")), f"{RED_OPEN}(.*?){RED_CLOSE}", "$1")


def to_uncertain(marked: Column) -> Column:
    """Red tags as brackets that a text generator keeps."""
    return F.replace(F.replace(marked, F.lit(RED_OPEN), F.lit("⟦")), F.lit(RED_CLOSE), F.lit("⟧"))


def from_uncertain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("⟦"), F.lit(RED_OPEN)), F.lit("⟧"), F.lit(RED_CLOSE))


def escape_keep_red(marked: Column) -> Column:
    """Escaped for HTML, with the red tags alone left as tags."""
    out = marked
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    escaped = RED_OPEN.replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    return F.replace(F.replace(out, F.lit(escaped), F.lit(RED_OPEN)), F.lit("&lt;/span&gt;"), F.lit(RED_CLOSE))


def needs_review(marked: Column, pending: Column) -> Column:
    """Whether a stretch is doubtful or a proofreading is pending; null flags count as false."""
    return F.coalesce(F.contains(marked, F.lit(RED_OPEN)), F.lit(False)) | F.coalesce(pending, F.lit(False))


def is_named(speaker: Column) -> Column:
    """Whether a label names somebody."""
    return F.coalesce((F.trim(speaker) != "") & ~F.trim(speaker).rlike(UNNAMED), F.lit(False))


def occurrences(text: Column, needle: str) -> Column:
    """Occurrences of a stretch that do not overlap; 0 for null."""
    if not needle:
        return F.lit(0).cast("bigint")
    lost = F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))
    return F.coalesce(lost / len(needle), F.lit(0)).cast("bigint")


def replaced(text: Column, marked: Column, wrong: str, right: str) -> tuple[Column, Column]:
    """text and marked with one stretch replaced; marks that it crosses are dropped."""
    new = F.replace(text, F.lit(wrong), F.lit(right))
    red = F.replace(F.coalesce(marked, text), F.lit(wrong), F.lit(right))
    return new, F.replace(F.when(strip_marks(red) != new, new).otherwise(red), F.lit(RED_OPEN + RED_CLOSE), F.lit(""))


def for_compare(text: Column) -> Column:
    """Without white space and punctuation."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s　、。？！?!，,]", "")


# Words that are keywords of no item, and phrases that recognisers make up out of silence.
STOPWORDS = ("根拠", "担当", "期限", "未定", "確認", "必要", "事項")
MADE_UP = r"ご視聴ありがとうございました|チャンネル登録|高評価|字幕(は|を|作成|提供)|最後まで(ご覧|見て)|次回もお楽しみに|^(ん|う|あ)+[。、]?$"
#: Words by which a speaker tells of their own doings.
FIRST_PERSON = r"私(?:が|は|も)|私たち(?:が|は)|こちら(?:で|が)"


def keywords(text: Column) -> Column:
    """Runs of two or more Chinese characters, katakana, or Latin letters and digits, each once, without words that say nothing of an item."""
    found = F.regexp_extract_all(strip_marks(text), F.lit(r"[一-鿿々]{2,}|[ァ-ヺー]{2,}|[A-Za-z0-9０-９]{2,}"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def made_up(text: Column, silent: Column, logprob: Column, compression: Column, most: float = 2.6) -> Column:
    """Whether a text was made up rather than heard: empty, silent and doubtful, repeating itself, or a stock phrase that is short and one of both."""
    plain = F.trim(text)
    stock = plain.rlike(MADE_UP) & (F.char_length(plain) <= 30) & ((silent > 0.3) | (logprob < -0.7))
    return (F.coalesce(plain, F.lit("")) == "") | ((silent > 0.6) & (logprob < -1.0)) | (compression > most) | stock


def char_class(c: Column) -> Column:
    """hira, kata, kanji, digit, alpha or other."""
    kinds = (("hira", "^[\u3040-\u309f]"), ("kata", "^[\u30a0-\u30ffー]"), ("kanji", "^[\u4e00-\u9fff々〆]"), ("digit", "^[0-9０-９]"), ("alpha", "^[A-Za-z]"))
    out = F.lit("other")
    for name, pattern in reversed(kinds):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def best_split(text: Column, most: int) -> Column:
    """Where to part a text into two lines of `most` characters: near the middle, behind a mark or particle, not inside a word.

    The number of characters of the first line; of equal places the first, and the middle where none will do.
    """
    n = F.char_length(text)

    def score(i: Column) -> Column:
        a, b = F.substr(text, i, F.lit(1)), F.substr(text, i + 1, F.lit(1))
        head, rest = F.char_length(F.trim(F.substr(text, F.lit(1), i))), F.char_length(F.trim(F.substr(text, i + 1)))
        over = F.greatest(F.lit(0), head - most) + F.greatest(F.lit(0), rest - most)
        ka, kb = char_class(a), char_class(b)
        inside = F.when((ka == kb) & ka.isin("kata", "digit", "alpha"), 8).when((ka == kb) & (ka == "kanji"), 3).when(a.rlike("^[をはがでにとへもや]") & (kb != "hira"), -3).otherwise(0)
        mark = F.when(b.rlike("^[　 ]"), -8).when(a.rlike("^[。？！?!]"), -10).when(a.rlike("^[、，,]"), -6).when(a.rlike("^[　 ]"), -4).otherwise(0)
        total = F.abs(i - n / 2) + over * 3 + inside + mark
        return F.when((head <= most + 4) & (rest <= most + 4), F.struct(total.alias("score"), i.alias("i")))

    scored = F.array_compact(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), score))
    return F.coalesce(F.array_min(scored)["i"], F.floor(n / 2).cast("int"))


def wrapped(text: Column, most: int) -> Column:
    """In two lines where the text is longer than one."""
    plain = F.trim(text)
    at = best_split(plain, most)
    return F.when(F.char_length(plain) <= most, plain).otherwise(F.concat(F.trim(F.substr(plain, F.lit(1), at)), F.lit("\n"), F.trim(F.substr(plain, at + 1))))


def input_budget(system_chars: Column, window: Column, reserve: int = 6144, per_char: float = 0.8) -> Column:
    """Characters that a generator's window leaves for the input, after the system's text and the answer's reserve."""
    return F.greatest(F.lit(0), F.floor((window - reserve - F.floor(system_chars * per_char) - 64) / per_char)).cast("bigint")


def window_size(chars: Column, limit: int = 65_536, reserve: int = 6144, least: int = 16_384, per_char: float = 0.8) -> Column:
    """The window for an input: the least one, doubled until it holds the input and the reserve, at most the limit."""
    need = F.floor(chars * per_char) + reserve
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(need / least)))
    return F.least(F.lit(limit), F.lit(least) * F.pow(F.lit(2), doublings)).cast("bigint")


def snippet(text: Column, words: Sequence[str], around: int = 30) -> Column:
    """The surroundings of the first of `words`, in their order, that the text holds."""
    plain = F.replace(strip_marks(text), F.lit("**"), F.lit(""))
    at = F.coalesce(*[F.nullif(F.instr(F.lower(plain), w.lower()), F.lit(0)) for w in words], F.lit(1))
    found = F.coalesce(*[F.when(F.contains(F.lower(plain), F.lit(w.lower())), F.lit(len(w))) for w in words], F.lit(0))
    start, stop = F.greatest(at - 1 - around, F.lit(0)), F.least(at - 1 + found + around, F.char_length(plain))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substr(plain, start + 1, stop - start), F.when(stop < F.char_length(plain), "…").otherwise(""))


def safe_name(text: Column, most: int = 60) -> Column:
    """Usable as a file name."""
    return F.substring(F.trim(F.regexp_replace(text, r'[\\/:*?"<>|\r\n\t]', "_")), 1, most)


def learnable(wrong: Column, right: Column) -> Column:
    """Whether a correction is short, one line, and without punctuation."""
    one = lambda c: (F.char_length(c) >= 2) & (F.char_length(c) <= 12) & ~c.rlike(r"[\n、。？！?!，,.]")
    return F.coalesce(one(wrong) & one(right) & (wrong != right), F.lit(False))


def applied_corrections(text: Column, pairs: Sequence[tuple[str, str, int]], least: int = 2) -> Column:
    """Every pair that was seen `least` times, one after the other in the given order."""
    for wrong, right, count in pairs:
        if count >= least and len(wrong) >= 2 and wrong != right and not re.search(r"[\n、。？！?!，,.]", wrong + right):
            text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def token_estimate(chars: Column, per_char: float = 0.8) -> Column:
    """Tokens to budget for a number of characters."""
    return F.ceil(chars * per_char).cast("bigint")
