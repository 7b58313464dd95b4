"""Long exact spans that stand in more than one record.

Tokens are content-defined anchors: the character grams of least hash in every window of WINDOW grams
(winnowing), so two records that share a run of `least` characters pick the same anchors inside it.
A token k-mer, an edge of the de Bruijn graph, reaches from an anchor to the first anchor that ends at
least `reach` characters later, and carries a hash of all its characters.  With reach = least + 4 - 4 *
WINDOW, every shared run of `least` characters holds at least one whole edge.

Edges that stand in two records or more are kept.  Where such an edge is always followed by one and the
same edge, as often as either stands, the two are one nonbranching path; paths compact through joins
on the pair counts.  The occurrences of a compacted path are compared at their source coordinates, in
the texts themselves: with the characters on both sides that two of them share, they are a span if it
is long enough.  A path that stands in very many records is not compared in pairs: its occurrences
are grouped by every window of `least` characters that covers it, which is exact and linear.  What they share
around it, and over all of a longer path, comes from the windows too, with one other record for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from talkgrid.operators.durable import cut_lineage

GRAM = 20
WINDOW = 30
#: Occurrences of one path that are compared with each other in one block; above it the windows decide.
BLOCK = 64
#: Ids that may be broadcast, after they are counted: some 2 MB.
SMALL = 1 << 18

#: Repeated edges that may be broadcast, after they are counted: some 40 MB.
REPEATED = 1 << 20

_SHIFT = np.uint64(29)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", np.uint64(pow(int(self.base), -1, 1 << 64)))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers(np.uint64(0x9E3779B97F4A7C15)), _Powers(np.uint64(0xC2B2AE3D27D4EB4F))


class _Hashes:
    """Hashes of any stretches of an array of code points, by prefix sums of polynomials modulo 2^64."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        value = _mix(points.astype(np.uint64) + np.uint64(0x51ED2701))
        self.sums, self.down = [], []
        for powers in _POWERS:
            up, down = powers(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(value * up[:n], dtype=np.uint64, out=total[1:])
            self.sums.append(total)
            self.down.append(down)

    def grams(self, size: int) -> np.ndarray:
        """One hash for each place where `size` characters begin."""
        total = self.sums[0]
        n = len(total) - size
        return _mix((total[size:] - total[:n]) * self.down[0][:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = ((total[end] - total[start]) * down[start] for total, down in zip(self.sums, self.down))
        return _mix(_mix(one) + two)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of every `width` neighbours, in steps that double."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = best(values[:-step], values[step:])
        have += step
    return values


def text_edges(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash, start and end of every edge of the texts, each text by itself."""
    reach = _reach(least)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size) - size
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < least:
        return (np.zeros(0, np.int64),) * 4
    hashes = _Hashes(points)
    grams = hashes.grams(GRAM)
    lows = _sliding(grams, WINDOW, np.minimum)
    # A window that crosses from one text into the next picks nothing.
    for at in first[1:]:
        lows[max(0, at - WINDOW - GRAM + 2) : at] = 0
    edge = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, lows, edge]), WINDOW, np.maximum) == grams)
    follow = np.searchsorted(at, at + reach - GRAM)
    whole = follow < len(at)
    start, end = at[whole], at[follow[whole]] + GRAM
    number = np.searchsorted(first, start, side="right") - 1
    # A text that is empty shares its first place with the next; the last of such texts owns it.
    inside = end <= first[number] + size[number]
    number, start, end = number[inside], start[inside], end[inside]
    h = hashes.of(start, end).view(np.int64)
    kept = _thinned(number, h, start, reach)
    return number[kept], h[kept], (start - first[number])[kept], (end - first[number])[kept]


def _thinned(number: np.ndarray, h: np.ndarray, start: np.ndarray, reach: int) -> np.ndarray:
    """Which edges stay: of one that follows itself, as in a row of dashes, the first two, the last two and some between.

    Such edges stand one period apart.  Two repetitions of unequal length meet at their starts, at their ends or
    one period off, so the outer edges decide every pair; those between, counted from both ends and less than
    `reach` apart, carry what is shared over the whole length.  As at least two stay, the counts part the path here.
    """
    if not len(h):
        return np.zeros(0, bool)
    new = np.append(True, (h[1:] != h[:-1]) | (number[1:] != number[:-1]))
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(h)))
    rank = np.arange(len(h)) - np.repeat(begin, length)
    back = np.repeat(length, length) - 1 - rank
    second = np.minimum(begin + 1, len(h) - 1)
    period = np.where(length > 1, start[second] - start[begin], 1)
    step = np.repeat(np.maximum(1, reach // (2 * period)), length)
    return (rank < 2) | (back < 2) | (rank % step == 0) | (back % step == 0)


def _edge_batches(least: int, limit: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit)))
                number, h, s, e = text_edges(texts[at:stop], least)
                starts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1]) if len(number) else np.zeros(0, np.int64)
                i = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
                columns = docs[at:stop][number], i.astype(np.int32), h, s.astype(np.int32), e.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "i", "h", "s", "e"])
                at = stop

    return run


def repeated_paths(docs: DataFrame, least: int) -> DataFrame:
    """doc, path (a hash), s, e, n: occurrences of compacted paths; n is how often the path stands."""
    edges = docs.select("doc", "text").mapInArrow(_edge_batches(least), "doc bigint, i int, h bigint, s int, e int")
    # Counts are summed up before they are shuffled, so that an edge of very many records is a few rows.
    counted = edges.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    again = cut_lineage(counted.where("lo < hi").select("h", "n"))
    # Where few edges stand again, they are broadcast and no edge is shuffled; otherwise both sides are, and skew is split at run time.
    found = edges.join(F.broadcast(again) if again.count() <= REPEATED else again, "h")
    held = cut_lineage(found.select("doc", "i", "h", "s", "e", "n").dropDuplicates(["doc", "i"]))
    in_doc = W.partitionBy("doc").orderBy("i")
    near = held.withColumn("p", F.lag(F.struct("i", "h", "n")).over(in_doc))
    near = near.select("doc", "i", "h", "s", "e", "n", F.when(F.col("p.i") == F.col("i") - 1, F.col("p.h")).alias("ph"), F.col("p.n").alias("pn"))
    links = near.where("ph IS NOT NULL AND pn = n").groupBy("ph", "h").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n")).where("c = n").select("ph", "h", F.lit(True).alias("inner"))
    joined = near.join(links, ["ph", "h"], "left")
    runs = joined.withColumn("head", F.when(F.col("inner").isNull(), F.col("h"))).withColumn("no", F.sum(F.when(F.col("inner").isNull(), 1).otherwise(0)).over(in_doc))
    paths = runs.groupBy("doc", "no").agg(F.max("head").alias("path"), F.min("s").alias("s"), F.max("e").alias("e"), F.first("n").alias("n"))
    return paths.select("doc", "path", "s", "e", "n")


def _flanks(least: int):
    """Characters of the path (the first and last `least` of a long one) and on both sides of it, from the record's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, spots in zip(pdf["doc"], pdf["text"], pdf["spots"]):
                for spot in spots:
                    s, e = spot["s"], spot["e"]
                    rows.append((doc, spot["path"], s, e, text[max(0, s - least) : s], text[s : min(e, s + least)] + text[max(s + least, e - least) : e], text[e : e + least]))
            yield pd.DataFrame(rows, columns=["doc", "path", "s", "e", "left", "mid", "right"])

    return run


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    lo = 0
    step = 1 << max(0, n.bit_length() - 1)
    while step:  # the largest lo with a[:lo] == b[:lo]
        if lo + step <= n and a[lo : lo + step] == b[lo : lo + step]:
            lo += step
        step >>= 1
    return lo


def _compare(least: int):
    """All pairs of one block of a path's occurrences whose common stretch is long enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for spots in pdf["spots"]:
                spots = [(x["doc"], x["s"], x["e"], x["left"][::-1], x["mid"], x["right"]) for x in spots]
                for j, b in enumerate(spots):
                    for a in spots[:j]:
                        if a[0] == b[0] or a[4] != b[4] or a[2] - a[1] != b[2] - b[1]:
                            continue
                        lcs, lcp = _shared(a[3], b[3]), _shared(a[5], b[5])
                        if lcs + (a[2] - a[1]) + lcp >= least:
                            x, y = (a, b) if a[0] < b[0] else (b, a)
                            rows.append((x[0], y[0], x[1] - lcs, x[2] + lcp, y[1] - lcs, y[2] + lcp))
            yield pd.DataFrame(rows, columns=["doc_a", "doc_b", "from_a", "to_a", "from_b", "to_b"])

    return run


def _windows(least: int, cover: bool):
    """Windows of `least` characters over a path, as hashes, and where they stand; k counts from the path's start.

    Those that decide pairs cover the path whole; a path that is longer itself is one such row of its own length.
    `prev` is the hash of the deciding window one place before: two records that share it have met there already.
    With `cover` come all others that may hold an edge of the path: they tell how far what is shared reaches beyond it.
    """
    beyond = least - _reach(least) if cover else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, counts, parts = [], [], []
            for doc, path, s, e, left, mid, right in zip(pdf["doc"], pdf["path"], pdf["s"], pdf["e"], pdf["left"], pdf["mid"], pdf["right"]):
                long = e - s >= least
                # Stretches of text, the place in each that counts as its path's start, and the first and last k.
                if long:
                    stretches = [(left + mid[:least], len(left), -beyond, -1), (mid[-least:] + right, s - e + least, e - s - least + 1, e - s - least + beyond)]
                else:
                    low, high = (-beyond, e - s - least + beyond) if cover else (e - s - least, 0)
                    stretches = [(left + mid + right, len(left), low, high)]
                found = [(np.zeros(1, np.int64), np.zeros(1, np.int64), e - s, np.ones(1, bool))] if long else []
                for text, zero, low, high in stretches:
                    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                    k = np.arange(max(low, -zero), min(high, len(points) - least - zero) + 1)
                    if len(k):
                        h = _Hashes(points).of(k + zero, k + zero + least).view(np.int64)
                        found.append((k, h, least, (not long) & (k >= e - s - least) & (k <= 0)))
                for k, h, n, pair in found:
                    docs.append((doc, path)), counts.append(len(k))
                    parts.append((k, h, s + k, np.full(len(k), n), pair, np.append(0, h[:-1]), np.append(False, pair[:-1])))
            if parts:
                k, w, at, n, pair, prev, met = (np.concatenate(x) for x in zip(*parts))
                of = np.repeat(np.array(docs, np.int64), counts, axis=0)
                yield pd.DataFrame({"doc": of[:, 0], "path": of[:, 1], "k": k, "w": w, "at": at, "n": n, "pair": pair, "prev": pd.Series(prev, dtype="Int64").where(met)})

    return run


def _reach(least: int) -> int:
    return least + 4 - 4 * WINDOW


_PAIRS = "doc_a bigint, doc_b bigint, from_a bigint, to_a bigint, from_b bigint, to_b bigint"


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200, block: int = BLOCK, pairs: bool = True, cover: bool = True) -> DataFrame:
    """doc_a < doc_b and where a span of `least` characters or more stands in each (from inclusive, to exclusive).

    Spans are found once or more for every pair that shares one; a pair's longest spans are reported whole
    up to `least` characters beyond the compacted path.  Null, empty and shorter texts share nothing; rows
    of one key that repeat each other count once; a null key is left out.  Without `cover` every pair is
    found, but of a path that stands in very many records not every place and not its whole extent.  Without
    `pairs` all that is shared is covered, with one other record for each stretch of such a path: as many rows
    as its occurrences have windows, and not one for every two of its records.
    """
    docs = documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= least))
    paths = cut_lineage(repeated_paths(docs, least))
    flank = "doc bigint, path bigint, s int, e int, left string, mid string, right string"

    def sides(chosen: DataFrame) -> DataFrame:
        of_doc = chosen.groupBy("doc").agg(F.collect_list(F.struct("path", "s", "e")).alias("spots"))  # of one document
        ids = chosen.select("doc").distinct()
        # Only texts that are needed are shuffled: by a broadcast of their ids where these are known to be few.
        needed = docs.join(F.broadcast(ids), "doc", "left_semi") if ids.count() <= SMALL else docs
        return needed.join(of_doc, "doc").mapInPandas(_flanks(least), flank)

    small, hot = paths.where(F.col("n") <= block), paths.where(F.col("n") > block)
    groups = sides(small).groupBy("path").agg(F.collect_list(F.struct("doc", "s", "e", "left", "mid", "right")).alias("spots"))
    found = groups.where(F.size("spots") > 1).mapInPandas(_compare(least), _PAIRS)
    if hot.isEmpty():
        return found
    windows = sides(hot).mapInPandas(_windows(least, cover), "doc bigint, path bigint, k bigint, w bigint, at bigint, n bigint, pair boolean, prev bigint")
    windows = cut_lineage(windows) if cover else windows
    found = found.unionByName(_met(windows, block)) if pairs else found
    return found.unionByName(_extents(windows)) if cover else found


def _met(windows: DataFrame, block: int) -> DataFrame:
    """The pairs of records that share a window which decides; each pair at the first of its neighbouring windows only.

    What two records share around a path is one stretch, so the windows they share follow one another.
    """
    chosen = cut_lineage(windows.where("pair").groupBy("path", "k", "w", "doc", "prev").agg(F.min("at").alias("at"), F.min("n").alias("size")))
    group = ["path", "k", "w"]
    # Where all came by one and the same window, all have met before.
    count = chosen.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("prev").isNotNull()).alias("came"), F.min("prev").alias("p"), F.max("prev").alias("q")).where("n > 1 AND NOT (came AND p = q)").select(*group, "n")
    # Members of one window group, in blocks, so that no task holds a group: block i meets every block j >= i.
    numbered = chosen.join(count, group).withColumn("b", F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / block)))
    blocks = numbered.groupBy(*group, "b").agg(F.collect_list(F.struct("doc", "at", "size", "prev")).alias("m"))
    met = blocks.join(blocks.select(*group, F.col("b").alias("b2"), F.col("m").alias("m2")), group).where("b <= b2")
    x = met.select("b", "b2", F.explode("m").alias("x"), "m2").select("b", "b2", "x", F.explode("m2").alias("y")).where("(b < b2 OR x.doc < y.doc) AND (x.prev IS NULL OR y.prev IS NULL OR x.prev != y.prev)")
    return _ordered(x.select(F.col("x.doc").alias("doc"), F.col("x.at").alias("s"), F.col("y.doc").alias("other"), F.col("y.at").alias("t"), F.col("x.size").alias("size")))


def _ordered(met: DataFrame) -> DataFrame:
    """Spans of doc (from s) and other (from t), `size` characters long, with the lesser document first."""
    swap = F.col("doc") > F.col("other")
    low = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    met = met.select(low("doc", "other").alias("doc_a"), low("other", "doc").alias("doc_b"), low("s", "t").alias("from_a"), low("t", "s").alias("from_b"), "size")
    return met.select("doc_a", "doc_b", "from_a", (F.col("from_a") + F.col("size")).alias("to_a"), "from_b", (F.col("from_b") + F.col("size")).alias("to_b"))


def _extents(windows: DataFrame) -> DataFrame:
    """What is shared around every occurrence of a path, with one other record for each window: as many rows as windows at most.

    Windows that an occurrence shares with one and the same other occurrence are one span: they all overlap the path.
    """
    group = ["path", "k", "w"]
    ends = windows.groupBy(*group).agg(F.min(F.struct("doc", "at")).alias("lo"), F.max(F.struct("doc", "at")).alias("hi")).where("lo.doc < hi.doc")
    met = windows.join(ends, group).withColumn("o", F.when(F.col("doc") == F.col("lo.doc"), F.col("hi")).otherwise(F.col("lo")))
    one = met.groupBy("path", "doc", (F.col("at") - F.col("k")).alias("p"), F.col("o.doc").alias("other"), (F.col("o.at") - F.col("at")).alias("shift")).agg(F.min("at").alias("s"), F.max(F.col("at") + F.col("n")).alias("e"))
    return _ordered(one.select("doc", "s", "other", (F.col("s") + F.col("shift")).alias("t"), (F.col("e") - F.col("s")).alias("size")))


def shared_parts(documents: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_chars, shared_chars, shared_part of every document; 0 for an empty and null for a null text."""
    ends = F.explode(F.array(F.struct(F.col("doc_a").alias("doc"), F.col("from_a").alias("s"), F.col("to_a").alias("e")), F.struct(F.col("doc_b").alias("doc"), F.col("from_b").alias("s"), F.col("to_b").alias("e")))).alias("x")
    one = spans.select(ends).select("x.*").distinct()
    before = F.max("e").over(W.partitionBy("doc").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1))
    fresh = one.withColumn("b", F.coalesce(before, F.lit(0))).select("doc", F.greatest(F.lit(0), F.col("e") - F.greatest("s", "b")).alias("c"))
    total = fresh.groupBy("doc").agg(F.sum("c").alias("shared_chars"))
    size = documents.select(F.col(key).cast("bigint").alias(key), F.length(text).cast("bigint").alias("n_chars")).dropDuplicates([key])
    part = F.when(F.col("n_chars") > 0, F.coalesce(F.col("shared_chars"), F.lit(0)) / F.col("n_chars")).when(F.col("n_chars") == 0, F.lit(0.0))
    return size.join(total, F.col(key) == F.col("doc"), "left").select(key, "n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce("shared_chars", F.lit(0))).cast("bigint").alias("shared_chars"), part.alias("shared_part"))
