"""What two texts have in common, character by character: steps that need a full alignment, one pair of texts at a time."""

from __future__ import annotations

import difflib
import html
import re
from itertools import pairwise

# Hesitations that a correction may drop, clock times, and notes on evidence that many items share.
DROPPED = re.compile(r"^[、。\s]*(えー+|えっと|あのー*|あー+|うーん|まあ|その|なんか)[、。\s]*$")
CLOCK = re.compile(r"\d{1,2}:\d{2}(?::\d{2})?")
NOTE = re.compile(r"[（(]\s*根拠[^）)]*[）)]|\s+")


def steps(old: str, new: str) -> list[tuple[str, str, str]]:
    """(equal, replace, delete or insert; what stood; what stands) from one text to the other."""
    return [(tag, old[a:b], new[c:d]) for tag, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()]


def likeness(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def drops_content(old: str | None, new: str | None) -> bool:
    """Whether a correction leaves out six characters or more that say something, or cuts ten or more down to less than four tenths."""
    gone = lambda a: len(a.strip("、。 　")) >= 6 and not DROPPED.match(a)
    return any(tag == "delete" and gone(a) or tag == "replace" and len(a) >= 10 and len(b) < 0.4 * len(a) for tag, a, b in steps(old or "", new or ""))


def worth_keeping(before: str | None, after: str | None) -> bool:
    """Whether a correction is kept with its context: both short, different, and half alike."""
    return bool(before and after) and before != after and max(len(before), len(after)) <= 300 and likeness(before, after) >= 0.5


def acceptable_fix(old: str, new: str, others: tuple[str, ...] = (), least: float = 0.5) -> bool:
    """Whether a rewritten item may take the place of the old one: of the same form, near in length, with all its times, more like it than any other item."""
    old, new = old.strip(), new.strip()
    rows = [t.count("|") if t.startswith("|") else -1 for t in (old, new)]
    times = [set(CLOCK.findall(t)) for t in (old, new)]
    if len(new) < 2 or rows[0] != rows[1] or not 0.3 <= len(new) / max(1, len(old)) <= 3 or times[0] - times[1]:
        return False
    said = NOTE.sub("", new)
    own = likeness(NOTE.sub("", old), said)
    return own >= least and all(likeness(NOTE.sub("", o.strip()), said) <= own for o in others if o.strip() != old)


def aligned(words: list[dict], text: str | None, s: int | None, e: int | None) -> list[tuple[str, float | None, float | None]]:
    """(word, start, end): the words as they are if the text is what they say, else the text's characters with the times of those they come from.

    A character's time is its part of its word; characters that are new share the time of what they stand for, or
    the moment at which they come in.  Without words the whole text has the utterance's time.
    """
    text, said = (text or "").strip(), [w for w in words if w["word"]]
    if not said:
        return [(text, s, e)] if text else []
    whole = "".join(w["word"] for w in said)
    if whole.strip() == text:
        return [(w["word"], w["s"], w["e"]) for w in said]
    # Where every character of the words begins; one more for the last end.
    marks = [w["s"] + (w["e"] - w["s"]) * k / len(w["word"]) for w in said for k in range(len(w["word"]))]
    ends = [w["s"] + (w["e"] - w["s"]) * (k + 1) / len(w["word"]) for w in said for k in range(len(w["word"]))]
    out, at = [], 0
    for tag, a, b in steps(whole, text):
        if tag == "equal":
            out += [(c, marks[at + k], ends[at + k]) for k, c in enumerate(b)]
        elif b:
            lo, hi = (marks[at], ends[at + len(a) - 1]) if a else (ends[at - 1],) * 2 if at else (marks[0],) * 2
            places = [lo + (hi - lo) * k / len(b) for k in range(len(b) + 1)]
            out += [(c, x, y) for c, (x, y) in zip(b, pairwise(places))]
        at += len(a)
    return out


def delta_html(old: str | None, new: str | None) -> str:
    """The new text with what went and what came in tags, escaped."""
    tagged = lambda name, t: f"<{name}>{html.escape(t)}</{name}>" if t else ""
    return "".join(html.escape(a) if tag == "equal" else tagged("del", a) + tagged("ins", b) for tag, a, b in steps(old or "", new or ""))
