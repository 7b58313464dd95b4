"""Checkpoints of a recognition: whether one can be trusted, what it tells, and where to go on."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkgrid.functions import clock

# The phases in their order, and what they are called.
PHASES = {"prepared": "開始前", "main": "音声認識", "main_complete": "音声認識の終わり", "recovery": "抜けの補完", "postprocess": "整形前"}
_WHOLE = ("main_complete", "recovery", "postprocess")


def valid(phase: Column, total: Column, done: Column, segments: Column, spans: Column, next_index: Column) -> Column:
    """Whether what was kept is consistent (milliseconds; segments and spans are arrays of s and e; null spans are none yet).

    The phase is known and the position inside the recording; from the end of the main phase on it is the end; before
    the beginning there is nothing; segments lie in the recording, and up to the main phase before the position, give
    or take a second; spans to fill in lie inside and the next of them exists.
    """
    at = (total > 0) & done.between(0, total) & (~phase.isin(*_WHOLE) | (done == total)) & ((phase != "prepared") | (done == 0) & (F.size(segments) == 0))
    inside = F.forall(segments, lambda x: (x["s"] >= 0) & (x["s"] <= x["e"]) & (x["e"] <= total + 1000))
    before = ~phase.isin("main", "prepared") | F.forall(segments, lambda x: x["e"] <= done + 1000)
    plan = spans.isNull() | (next_index.between(0, F.size(spans)) & F.forall(spans, lambda x: (x["s"] >= 0) & (x["s"] < x["e"]) & (x["e"] <= total)))
    return F.coalesce(phase.isin(*PHASES) & at & inside & before & plan, F.lit(False))


def notice(phase: Column, total: Column, done: Column) -> Column:
    """What a reader of an unfinished job is told."""
    name = F.lit("音声認識")
    for key, value in PHASES.items():
        name = F.when(phase == key, value).otherwise(name)
    return F.concat(F.lit("途中保存・全編未完了 — "), name, F.lit(" / 処理位置 "), clock.hms(done), F.lit(" / 音声全体 "), clock.hms(total))


def resume_at(phase: Column, total: Column, done: Column, spans: Column, next_index: Column) -> Column:
    """Where to go on, in milliseconds: at the position, or in recovery at the next span that is to be filled in."""
    following = F.try_element_at(spans, (next_index + 1).cast("int"))["s"]
    return F.when(phase == "recovery", F.coalesce(following, total)).when(phase.isin(*_WHOLE), total).when(phase == "main", done).otherwise(F.lit(0))
