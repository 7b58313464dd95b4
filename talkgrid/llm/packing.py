"""Filling containers of fixed capacity with items of varying length.

Hierarchical packing of several lengths.  Items are routed to tiers by the context window that they need: the
capacity, a half of it, a quarter, and so on.  Each tier is packed by itself, longest tier first: its longest
item opens a window of the tier's size, and the gap is filled from the shorter tiers, longest first.  A window
whose gap cannot be filled that way is widened to the window of the next longer tier and filled again, so
that room is lost nowhere but in windows of the whole capacity.  Windows are then laid into containers, the wide
ones first: as each is a half, a quarter ... of a container, none lies across two.  Containers are
dealt to step groups so that the groups carry like loads.

The plan is made on the histogram of lengths alone, which has at most as many entries as the capacity,
whatever the number of items; every distinct filling is used as often as the counts allow.  Then each item
finds its place by its rank among the items of its length.  Ranks come from counts per length and bucket, so
no length, however frequent, is ordered in one task.

An item longer than the capacity is the only one that is divided: into full containers and a rest.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from talkgrid.operators.durable import cut_lineage

#: Largest capacity; the plan's tables grow with the capacity and not with the data.
CAPACITY_LIMIT = 1 << 20


#: Tiers below the capacity at most.
TIERS = 7
#: Part of a window that may stay empty before the window is widened.
SLACK = 256


def tiers_of(capacity: int) -> int:
    """How many tiers there are below the whole capacity."""
    return min(TIERS, capacity.bit_length() - 1)


def tier_of(size: int, capacity: int) -> int:
    """0 for the window of the whole capacity, 1 for half of it, and so on."""
    tier = 0
    while tier < tiers_of(capacity) and size <= capacity >> (tier + 1):
        tier += 1
    return tier


Filling = tuple[tuple[int, int], ...]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, Filling, int]]:
    """(tier of the window, filling, how often it is used); a filling is ((length, pieces of that length), ...).

    Every piece of the histogram is used, and no filling is above its window.
    """
    left = {s: n for s, n in sorted(histogram.items()) if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("a length outside 1..capacity")
    sizes = sorted(left)
    out: list[tuple[int, Filling, int]] = []
    for tier in range(tiers_of(capacity) + 1):
        shortest = 0 if tier == tiers_of(capacity) else capacity >> (tier + 1)
        while sizes and sizes[-1] > shortest:
            window, filling, used = tier, {sizes[-1]: 1}, sizes[-1]
            while True:
                # The gap is filled from this tier and the shorter ones, as far as they reach.
                k = bisect_right(sizes, (capacity >> window) - used) - 1
                while k >= 0:
                    size, room = sizes[k], (capacity >> window) - used
                    take = min(room // size, left[size] - filling.get(size, 0))
                    if take > 0:
                        filling[size] = filling.get(size, 0) + take
                        used += take * size
                    k = min(k, bisect_right(sizes, (capacity >> window) - used)) - 1
                if not window or (capacity >> window) - used <= (capacity >> window) // SLACK:
                    break
                window -= 1
            times = min(left[s] // n for s, n in filling.items())
            out.append((window, tuple(filling.items()), times))
            for size, n in filling.items():
                left[size] -= n * times
                if not left[size]:
                    del left[size]
                    sizes.pop(bisect_right(sizes, size) - 1)
    return out


class Places:
    """Where the items of each length go, by rank; and the window and step group."""

    def __init__(self, fillings: list[tuple[int, Filling, int]], capacity: int, group: int):
        self.units = 1 << tiers_of(capacity)  # of a container; a window of tier t takes units >> t of them
        total = -(-sum(times * (self.units >> tier) for tier, _, times in fillings) // self.units)
        per: dict[int, list[tuple[int, ...]]] = {}
        seen: dict[int, int] = {}
        first = 0
        # Wide windows first; containers of like load follow one another, so dealing them in turn balances the groups.
        for tier, filling, times in sorted(fillings, key=lambda f: (f[0], -sum(s * s * n for s, n in f[1]), f)):
            offset = 0
            for size, n in filling:
                per.setdefault(size, []).append((seen.get(size, 0), n, first, offset, tier))
                seen[size] = seen.get(size, 0) + n * times
                offset += size * n
            first += times * (self.units >> tier)
        self.groups, self.capacity = max(1, -(-total // group)), capacity
        self.by_size = {s: tuple(np.array(c, np.int64) for c in zip(*rows)) for s, rows in per.items()}

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Container, offset in it, tier of the window, where the window begins, and step group."""
        container, offset, tier, window = (np.zeros(len(size), np.int64) for _ in range(4))
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            start, n, first, begin, tiers = self.by_size[int(s)]
            k = np.searchsorted(start, rank[at], side="right") - 1
            inside = rank[at] - start[k]
            t = tiers[k]
            unit = first[k] + inside // n[k] * (self.units >> t)
            container[at], tier[at] = unit // self.units, t
            window[at] = unit % self.units // (self.units >> t) * (self.capacity >> t)
            offset[at] = window[at] + begin[k] + (inside % n[k]) * s
        turn, pos = container // self.groups, container % self.groups
        return container, offset, tier, window, np.where(turn % 2 == 0, pos, self.groups - 1 - pos)


def pack(items: DataFrame, key: str, size: str, capacity: int, group: int = 64) -> DataFrame:
    """`key`, piece_no, item_from, size, container, offset, tier, window_from, window_tier and step_group of every piece.

    `tier` is the window that the piece needs, `window_tier` the window that it lies in, from `window_from` on.

    Sizes are whole numbers; items of null, zero or negative size need no room and give no row.  Ties are
    placed by key.  An item above the capacity gives full pieces of `capacity` and one rest.
    """
    if not 0 < capacity <= CAPACITY_LIMIT:
        raise ValueError(f"capacity must be from 1 to {CAPACITY_LIMIT}")
    positive = items.select(F.col(key).alias("_key"), F.col(size).cast("bigint").alias("_size")).where("_size > 0")
    pieces = positive.select("_key", "_size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_size") / capacity).cast("int") - 1)).alias("piece_no"))
    cut = pieces.select("_key", "piece_no", (F.col("piece_no") * F.lit(capacity)).cast("bigint").alias("item_from"), F.least(F.lit(capacity), F.col("_size") - F.col("piece_no") * F.lit(capacity)).cast("int").alias("s"))
    # Buckets are spread by hash, so that equal lengths meet in small groups only.
    held = cut_lineage(cut.withColumn("b", F.pmod(F.xxhash64("_key", "piece_no"), F.lit(4096)).cast("int")))
    counts = held.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.s: r.n for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    shared = items.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity), capacity, group))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1))).select("s", "b", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = held.withColumn("r", F.row_number().over(W.partitionBy("s", "b").orderBy("_key", "piece_no")) - 1).join(before, ["s", "b"])
    tiers = [tier_of(s, capacity) for s in range(capacity + 1)]
    tier_table = np.array(tiers, np.int32)
    key_type = held.schema["_key"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, r = batch.column("s").to_numpy().astype(np.int64), batch.column("r").to_numpy()
            container, offset, window_tier, window, step = shared.value.find(s, r)
            keep = [batch.column(n) for n in ("_key", "piece_no", "item_from")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(s), pa.array(container), pa.array(offset), pa.array(tier_table[s]), pa.array(window), pa.array(window_tier.astype(np.int32)), pa.array(step)],
                names=[key, "piece_no", "item_from", "size", "container", "offset", "tier", "window_from", "window_tier", "step_group"],
            )

    chosen = ranked.select("_key", "piece_no", "item_from", "s", (F.col("r") + F.col("before")).cast("bigint").alias("r"))
    return chosen.mapInArrow(place, f"`{key}` {key_type}, piece_no int, item_from bigint, size bigint, container bigint, offset bigint, tier int, window_from bigint, window_tier int, step_group bigint")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """containers, used, room and filled (a share) of all containers."""
    n = F.countDistinct("container")
    used = F.coalesce(F.sum("size"), F.lit(0))
    return packed.agg(n.alias("containers"), used.alias("used"), (n * capacity).alias("room"), F.when(n > 0, used / (n * capacity)).alias("filled"))


def tier_report(packed: DataFrame, capacity: int) -> DataFrame:
    """window_tier, windows, pieces, from_shorter (pieces of shorter tiers), used, room and filled of the windows of every tier."""
    windows = packed.groupBy("window_tier", "container", "window_from").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"), F.sum((F.col("tier") > F.col("window_tier")).cast("int")).alias("m"))
    room = F.count(F.lit(1)) * F.floor(F.lit(capacity) / F.pow(F.lit(2), F.col("window_tier"))).cast("bigint")
    return windows.groupBy("window_tier").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("n").alias("pieces"), F.sum("m").alias("from_shorter"), F.sum("used").alias("used"), room.alias("room"), (F.sum("used") / room).alias("filled")
    )
