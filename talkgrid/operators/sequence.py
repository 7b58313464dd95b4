"""Spans, runs, sessions and as-of assignments over time, all per job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkgrid.operators.intervals import periods_and_gaps
from talkgrid.operators.scan import Machine, ordered_scan


#: Milliseconds of a slot that a job is spread over.
SLOT_MS = 15 * 60 * 1000


def merged_spans(rows: DataFrame, keys: Sequence[str], tolerance: int = 0) -> DataFrame:
    """keys, s, e: spans joined where the next begins at most `tolerance` after the end of all before it; for keys of few spans, each in one task."""
    w = W.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("s") - reach > tolerance), 1).otherwise(0)
    islands = rows.withColumn("_f", fresh).withColumn("_n", F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_n").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_n")


def merged_in_slots(rows: DataFrame, keys: Sequence[str], tolerance: int = 0, slot_ms: int = SLOT_MS) -> DataFrame:
    """The same for keys of any number of spans: they are spread over slots of time, and spans that are `tolerance` longer touch."""
    longer = rows.where("e > s").select(*keys, "s", (F.col("e") + tolerance).alias("e"))
    found = periods_and_gaps(longer, keys, "s", "e", slot_ms).where("kind = 'period'")
    return found.select(*keys, F.col("from_ms").alias("s"), (F.col("to_ms") - tolerance).alias("e"))


def uncovered(wanted: DataFrame, cover: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, s, e: the parts of `wanted` spans that no span of `cover` holds, by a sweep over all ends."""
    def edges(df: DataFrame, on: int, of: int) -> DataFrame:
        one = F.array(F.struct(F.col("s").alias("t"), F.lit(on).alias("a"), F.lit(of).alias("b")), F.struct(F.col("e").alias("t"), F.lit(-on).alias("a"), F.lit(-of).alias("b")))
        return df.where("e > s").select(*keys, F.explode(one).alias("x")).select(*keys, "x.*")

    deltas = edges(wanted, 1, 0).unionByName(edges(cover, 0, 1)).groupBy(*keys, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = W.partitionBy(*keys).orderBy("t")
    held = deltas.select(*keys, F.col("t").alias("s"), F.lead("t").over(w).alias("e"), F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"))
    return held.where("a > 0 AND b = 0 AND e IS NOT NULL").select(*keys, "s", "e")


def nearest_turn(points: DataFrame, turns: DataFrame, keys: Sequence[str], slot_ms: int = SLOT_MS) -> DataFrame:
    """keys, id, speaker: for each point in time `t` the turn (s, e, speaker) that holds it, else the nearer neighbour by its edge.

    Both tables are brought into one order within slots of time, and the neighbours carried along by windows; no
    point meets all turns.  What reaches a slot from others is one turn on each side.  Of turns that begin before
    the point the last counts; ties go to the earlier.
    """
    p = points.select(*keys, F.col("t"), F.lit(1).alias("kind"), "id", F.lit(None).cast("struct<s:bigint,e:bigint,speaker:string>").alias("turn"))
    q = turns.where("speaker IS NOT NULL AND speaker != ''").select(*keys, F.col("s").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("id"), F.struct("s", "e", "speaker").alias("turn"))
    both = p.unionByName(q).withColumn("_slot", F.floor(F.col("t") / slot_ms))
    order = [F.col("t"), F.col("kind"), F.col("turn.e"), F.col("turn.speaker"), F.col("id")]
    inside = W.partitionBy(*keys, "_slot").orderBy(*order)
    # One row per slot: its first and last turn, carried over the slots without any.
    of_turns = F.when(F.col("turn").isNotNull(), F.struct("t", "turn.e", "turn.speaker", "turn"))
    edges = both.groupBy(*keys, "_slot").agg(F.min(of_turns).alias("_lo"), F.max(of_turns).alias("_hi"))
    across = W.partitionBy(*keys).orderBy("_slot")
    carried = edges.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_slot").alias("_at"),
        F.last("_hi", ignorenulls=True).over(across.rowsBetween(W.unboundedPreceding, -1))["turn"].alias("_before"), F.first("_lo", ignorenulls=True).over(across.rowsBetween(1, W.unboundedFollowing))["turn"].alias("_after"),
    )
    near = both.withColumns({"_b": F.last("turn", ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), "_a": F.first("turn", ignorenulls=True).over(inside.rowsBetween(0, W.unboundedFollowing))}).where("kind = 1")
    met = near.join(carried, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_slot").eqNullSafe(F.col("_at"))])
    placed = met.withColumns({"b": F.coalesce("_b", "_before"), "a": F.coalesce("_a", "_after")})
    gap_b, gap_a = F.greatest(F.col("t") - F.col("b.e"), F.lit(0)), F.col("a.s") - F.col("t")
    who = F.when(F.col("b").isNull(), F.col("a.speaker")).when(F.col("a").isNull() | (gap_b <= gap_a), F.col("b.speaker")).otherwise(F.col("a.speaker"))
    return placed.select(*keys, "id", who.alias("speaker"))


def in_windows(points: DataFrame, windows: DataFrame, keys: Sequence[str], bucket: int) -> DataFrame:
    """Every point (t) with every window (s <= t < e) that holds it: an equi-join on buckets of time, then the bounds."""
    w = windows.where("e > s").withColumn("_b", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor((F.col("e") - 1) / bucket))))
    return points.withColumn("_b", F.floor(F.col("t") / bucket)).join(w, [*keys, "_b"]).where("t >= s AND t < e").drop("_b")


def sliding_windows(regions: DataFrame, keys: Sequence[str], width: int = 1500, hop: int = 750, least: int = 500) -> DataFrame:
    """keys, s, e: windows inside each region; one window for a short region, none for one under `least`, and a last one where much is left."""
    size = F.col("e") - F.col("s")
    whole = regions.where(size >= least)
    n = F.floor((size - width) / hop)
    starts = F.when(size <= width, F.array(F.col("s"))).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint")), lambda i: F.col("s") + i * hop))
    last = F.col("s") + n * hop + width
    tail = F.when((size > width) & (F.col("e") - last > hop / 2), F.array((F.col("e") - width).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    at = F.explode(F.concat(starts, tail)).alias("_s")
    return whole.select(*keys, F.col("e").alias("_e"), at).select(*keys, F.col("_s").alias("s"), F.least(F.col("_s") + width, F.col("_e")).alias("e"))


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """keys, run, label, n, s, e: stretches of one label (null is a label)."""
    w = W.partitionBy(*keys).orderBy(*order)
    changed = F.when(~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(F.lit(1)).over(w).isNull(), 1).otherwise(0)
    numbered = rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run", label).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"), F.max("e").alias("e"))


def majority(rows: DataFrame, keys: Sequence[str], label: str, weight: Column, order: str) -> DataFrame:
    """keys, label: the label of greatest weight; ties go to the one seen first."""
    total = rows.groupBy(*keys, label).agg(F.sum(weight).alias("_w"), F.min(order).alias("_f"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_w"), "_f", label))
    return total.withColumn("_r", rank).where("_r = 1").select(*keys, label)


class Sessions(Machine):
    """Utterances of words: a new one at another speaker, after a long silence, or at a sentence's end once it is long."""

    def __init__(self, longest: int = 45_000, silence: int = 8_000, marks: str = "。？！?!"):
        self.longest, self.silence, self.marks = longest, silence, marks
        self.first = self.last = None
        self.number, self.n = 0, 0

    def _out(self) -> list[tuple]:
        return [(self.number, self.first["speaker"], self.first["s"], self.last["e"], self.n)] if self.n else []

    def step(self, row: dict) -> list[tuple]:
        out: list[tuple] = []
        if self.n:
            ended = (self.last["word"] or "").strip()[-1:] in self.marks and (self.last["word"] or "").strip() != ""
            if row["speaker"] != self.first["speaker"] or row["s"] - self.last["e"] > self.silence or ended and row["s"] - self.first["s"] > self.longest:
                out = self._out()
                self.number, self.n = self.number + 1, 0
        if not self.n:
            self.first = row
        self.last, self.n = row, self.n + 1
        return out

    def close(self) -> list[tuple]:
        return self._out()


def built_utterances(words: DataFrame, longest: int = 45_000, silence: int = 8_000, slot_ms: int = SLOT_MS) -> DataFrame:
    """job_id, no, speaker, s, e, n of the utterances that the words (s, e, speaker, word) of each job make.

    Another speaker and a long silence end an utterance whatever came before, so a job falls into segments there; only
    inside a segment the words are read one after the other.  What tells whether a word begins a segment is found
    within slots of time, with the last word of earlier slots carried along.
    """
    placed = words.select("job_id", "s", "e", "speaker", "word", "utt_id", "word_idx", F.floor(F.col("s") / slot_ms).alias("_slot"), F.struct("s", "utt_id", "word_idx").alias("_o"))
    inside, across = W.partitionBy("job_id", "_slot").orderBy("_o"), W.partitionBy("job_id").orderBy("_slot")
    parts = lambda before, speaker, s: (~before["speaker"].eqNullSafe(speaker) | (s - before["e"] > silence)).cast("int")
    before = F.lag(F.struct("speaker", "e")).over(inside)
    flagged = placed.withColumn("_cut", F.coalesce(parts(before, F.col("speaker"), F.col("s")), F.lit(0))).withColumn("_n", F.sum("_cut").over(inside))
    # One row per slot: its first and last word and how many segments begin inside it.
    slots = flagged.groupBy("job_id", "_slot").agg(F.min(F.struct("_o", "speaker", "s")).alias("_first"), F.max(F.struct("_o", "speaker", "e")).alias("_last"), F.sum("_cut").alias("_c"))
    opened = slots.withColumn("_opens", F.coalesce(parts(F.lag("_last").over(across), F.col("_first.speaker"), F.col("_first.s")), F.lit(1)))
    past = F.coalesce(F.sum(F.col("_opens") + F.col("_c")).over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = opened.select(F.col("job_id").alias("_j"), F.col("_slot").alias("_k"), (past + F.col("_opens")).alias("_base"))
    met = flagged.join(base, [F.col("job_id").eqNullSafe(F.col("_j")), F.col("_slot").eqNullSafe(F.col("_k"))])
    rows = met.select("job_id", (F.col("_base") + F.col("_n")).alias("segment"), "s", "e", "speaker", "word", "utt_id", "word_idx")
    made = ordered_scan(rows, ["job_id", "segment"], ["s", "utt_id", "word_idx"], lambda: Sessions(longest, silence), "no bigint, speaker string, s bigint, e bigint, n bigint")
    no = F.row_number().over(W.partitionBy("job_id").orderBy("segment", "no")) - 1
    return made.select("job_id", no.cast("bigint").alias("no"), "speaker", "s", "e", "n")


class MergedCues(Machine):
    """Cues of which short neighbours of one speaker are one, as long as it fits."""

    def __init__(self, chars: int = 40, least: int = 1_000, longest: int = 6_000, gap: int = 1_000, marks: str = "。？！?!、，,"):
        self.chars, self.least, self.longest, self.gap, self.marks = chars, least, longest, gap, marks
        self.cue: tuple | None = None

    def step(self, row: dict) -> list[tuple]:
        s, e, speaker, text = row["s"], row["e"], row["speaker"], row["text"] or ""
        if self.cue is not None:
            s0, e0, who, before = self.cue
            short = e0 - s0 < self.least or e - s < self.least
            fits = len((before + text).strip()) <= self.chars and e - s0 <= self.longest * 1.3
            if short and fits and who == speaker and s - e0 < self.gap:
                self.cue = s0, e, who, before + ("" if before[-1:] and before[-1:] in self.marks else "　") + text
                return []
        out = self.close()
        self.cue = s, e, speaker, text
        return out

    def close(self) -> list[tuple]:
        return [self.cue] if self.cue is not None else []


def merged_cues(cues: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, s, e, speaker, text of cues in which short neighbours of one speaker are one."""
    return ordered_scan(cues, keys, order, MergedCues, "s bigint, e bigint, speaker string, text string")


class CappedSpans(Machine):
    """Spans joined where they touch, as long as the whole stays within a size."""

    def __init__(self, most: int):
        self.most, self.s, self.e = most, None, None

    def step(self, row: dict) -> list[tuple]:
        if self.s is not None and row["s"] <= self.e and row["e"] - self.s <= self.most:
            self.e = max(self.e, row["e"])
            return []
        out = self.close()
        self.s, self.e = row["s"], row["e"]
        return out

    def close(self) -> list[tuple]:
        return [(self.s, self.e)] if self.s is not None else []


class Packed(Machine):
    """Numbers chunks of items: a chunk is closed before an item that would pass the limit, or after one that reached it."""

    def __init__(self, limit: int, after: bool = False, most: int | None = None):
        self.limit, self.after, self.most = limit, after, most
        self.chunk, self.size, self.n = 0, 0, 0

    def step(self, row: dict) -> list[tuple]:
        full = self.size >= self.limit if self.after else self.n and self.size + row["size"] > self.limit
        if self.n and (full or self.most is not None and self.n >= self.most):
            self.chunk, self.size, self.n = self.chunk + 1, 0, 0
        self.size, self.n = self.size + row["size"], self.n + 1
        return [(row["id"], self.chunk)]


def packed(items: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int, after: bool = False, most: int | None = None) -> DataFrame:
    """keys, id, chunk: items (id, size) of each key in chunks, in order."""
    return ordered_scan(items, keys, order, lambda: Packed(limit, after, most), "id bigint, chunk bigint")


class Throttle(Machine):
    """Rows that are let through: the first, any `every` after the last one let through, and every change of phase."""

    def __init__(self, every: int):
        self.every, self.at, self.phase = every, None, None

    def step(self, row: dict) -> list[tuple]:
        if self.at is None or row["t"] - self.at >= self.every or row["phase"] != self.phase:
            self.at, self.phase = row["t"], row["phase"]
            return [(row["id"],)]
        return []


def throttled(rows: DataFrame, keys: Sequence[str], every: int) -> DataFrame:
    """keys, id of the rows (id, t, phase) that are let through."""
    return ordered_scan(rows, keys, ["t", "id"], lambda: Throttle(every), "id bigint")
