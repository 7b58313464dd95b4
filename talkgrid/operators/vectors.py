"""Unit vectors of voices: means, similarities, matching and assignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows of the smaller side of a similarity search that are broadcast; above it both sides meet in blocks.
SMALL_SIDE = 20_000


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """The array at length one; a zero array stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def mean_unit(rows: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """keys, mean: the normalised mean of the normalised vectors of each group."""
    parts = rows.select(*keys, F.posexplode(unit(F.col(vector))).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"))
    lists = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_l"))
    return lists.select(*keys, unit(F.transform("_l", lambda p: p["_m"])).alias("mean"))


def similarities(probes: DataFrame, people: DataFrame) -> DataFrame:
    """probe, person, score of every probe (id, embedding) against every person (person, embedding), the best of a person's vectors.

    Where `people` has a column `own`, a vector is not compared with the probe of that id.

    The people's side is broadcast if it is counted to be small; otherwise it is spread over blocks that
    every probe visits, and the best of each block are brought together.
    """
    p = probes.select("probe", unit(F.col("embedding")).alias("a"))
    own = F.col("own") if "own" in people.columns else F.lit(None).cast(probes.schema["probe"].dataType)
    q = people.select("person", unit(F.col("embedding")).alias("b"), own.alias("own"))
    n = q.count()
    if n <= SMALL_SIDE:
        met = p.join(F.broadcast(q))
    else:
        blocks = n // SMALL_SIDE + 1
        spread = q.withColumn("_k", F.pmod(F.xxhash64("person", "b"), F.lit(blocks)).cast("int"))
        met = p.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(spread, "_k")
    scored = met.where(~F.col("own").eqNullSafe(F.col("probe")))
    return scored.groupBy("probe", "person").agg(F.max(dot(F.col("a"), F.col("b"))).alias("score"))


def best(scores: DataFrame, k: int | None, key: str = "probe", digits: int = 4) -> DataFrame:
    """key, person, score, rank: the k most similar people, or all of them for None; ties by name."""
    rounded = scores.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "person"))
    ranked = rounded.withColumn("rank", rank.cast("bigint"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def assign_names(scores: DataFrame, threshold: float = 0.5, margin: float = 0.08, floor: float = 0.30) -> DataFrame:
    """job, cluster, person: clusters named one to one, from the greatest score down.

    A score from `threshold` on names a cluster if no other free person is within `margin`; a weaker one,
    from max(floor, threshold - 0.2) on, only if the two are each other's best.  Other clusters are lettered in their order.
    """
    weak = max(floor, threshold - 0.2)

    def one_job(pdf: pd.DataFrame) -> pd.DataFrame:
        table = {(r.cluster, r.person): r.score for r in pdf.itertuples() if r.person is not None}
        clusters = sorted(pdf["cluster"].unique())
        named: dict = {}
        taken: set = set()
        for (cluster, person), score in sorted(table.items(), key=lambda x: (-x[1], x[0])):
            if cluster in named or person in taken or score < weak:
                continue
            rivals = [s for (c, p), s in table.items() if c == cluster and p != person and p not in taken]
            if rivals and score - max(rivals) < margin:
                continue
            if score < threshold and score < max(s for (c, p), s in table.items() if p == person):
                continue
            named[cluster] = person
            taken.add(person)
        free = iter(range(10**9))
        letters = lambda n: ("" if n < 26 else chr(64 + n // 26)) + chr(65 + n % 26)
        return pd.DataFrame({"job": pdf["job"].iloc[0], "cluster": clusters, "person": [named.get(c) or "話者" + letters(next(free)) for c in clusters]})

    return scores.groupBy("job").applyInPandas(one_job, "job bigint, cluster bigint, person string")


def kept_by_percentile(rows: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """Rows whose value is at least the group's percentile (linear between ranks)."""
    limit = F.percentile(value, F.lit(share)).over(W.partitionBy(*keys))
    return rows.withColumn("_l", limit).where(F.col(value) >= F.col("_l")).drop("_l")


def capped_profile(rows: DataFrame, most: int = 400) -> DataFrame:
    """person, tag, sample: samples of each person within a cap; the oldest of jobs go first, then other learned ones, enrolled ones last."""
    rank = F.when(F.col("tag").startswith("job:"), 0).when(F.col("tag") != "enroll", 1).otherwise(2)
    keep = F.row_number().over(W.partitionBy("person").orderBy(F.desc(rank), F.desc("sample")))
    return rows.withColumn("_k", keep).where(F.col("_k") <= most).drop("_k")


def refined_runs(runs: DataFrame, people: DataFrame, own: DataFrame, threshold: float = 0.5, margin: float = 0.10, shortest: int = 2_500, least_runs: int | None = 2, least_ms: int = 6_000) -> DataFrame:
    """run, person: the new label of every run of speech that is clearly a known person's and not its label's.

    `runs` has run, label, ms and embedding; `people` person and embedding; `own` label and embedding, the centre of
    each label's cluster.  The best person must pass the threshold by 0.05 and be better by the margin than the label
    itself (than the second person where the label is nobody known) and than the label's own centre.  A change of one
    label to one person needs several runs and some seconds in all (all proposals, with label and ms, for None).  Runs shorter than `shortest` ms stay as they are.
    """
    long = runs.where(F.col("ms") >= shortest)
    scores = similarities(long.select(F.col("run").alias("probe"), "embedding"), people)
    ranked = scores.withColumn("r", F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score"), "person")))
    labels = long.select(F.col("run").alias("probe"), "label", "ms", "embedding")
    met = ranked.join(labels.select("probe", "label"), "probe")
    of = met.groupBy("probe").agg(
        F.max(F.when(F.col("r") == 1, F.col("person"))).alias("best"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("x"),
        F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("person") == F.col("label"), F.col("score"))).alias("mine"),
    )
    centre = own.select("label", unit(F.col("embedding")).alias("c"))
    judged = of.join(labels, "probe").join(centre, "label", "left").withColumn("centre", dot(unit(F.col("embedding")), F.col("c")))
    rival = F.coalesce("mine", "second", F.lit(-1.0))
    clear = (F.col("x") >= threshold + 0.05) & ~F.col("best").eqNullSafe(F.col("label")) & (F.col("x") - rival >= margin) & (F.col("x") - F.coalesce("centre", F.lit(-1.0)) >= margin)
    proposed = judged.where(clear).select(F.col("probe").alias("run"), "label", F.col("best").alias("person"), "ms")
    return proposed if least_runs is None else _often_enough(proposed, least_runs, least_ms)


def _often_enough(proposed: DataFrame, least_runs: int, least_ms: int) -> DataFrame:
    pair = W.partitionBy("label", "person")
    whole = proposed.withColumns({"_n": F.count(F.lit(1)).over(pair), "_ms": F.sum("ms").over(pair)})
    return whole.where((F.col("_n") >= least_runs) & (F.col("_ms") >= least_ms)).select("run", "person")


def loud_enough(clips: DataFrame, key: str, order: str, share: float = 0.5, least: int = 3, most: int = 150) -> DataFrame:
    """Clips (rms) of at least a share of the median loudness of all, of keys that have `least` of them; `most` of each key, evenly apart."""
    limit = clips.agg((F.percentile("rms", F.lit(0.5)) * share).alias("_l"))  # one row
    loud = clips.join(F.broadcast(limit)).where(F.col("rms") >= F.col("_l")).drop("_l")
    w = W.partitionBy(key)
    placed = loud.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)}).where(F.col("_n") >= least)
    # Row i is kept if it is the one at floor(j * n / most) for the j it falls to.
    j = F.ceil(F.col("_i") * most / F.col("_n"))
    kept = (F.col("_n") <= most) | ((j < most) & (F.floor(j * F.col("_n") / most) == F.col("_i")))
    return placed.where(kept).drop("_i", "_n")


def enrolled(windows: DataFrame, key: str, loud: float = 0.9, share: float = 0.3, outliers: float = 0.2) -> DataFrame:
    """Windows (rms, embedding) of at least a share of a loud one's level, without those least like the mean of the rest; fewer than four all stay."""
    w = W.partitionBy(key)
    heard = windows.withColumn("_l", F.percentile("rms", F.lit(loud)).over(w) * share).where(F.col("rms") >= F.col("_l")).drop("_l")
    means = heard.select(F.col(key).alias("_k"), F.posexplode("embedding").alias("_i", "_x")).groupBy("_k", "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m")).groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda p: p["_m"]).alias("_mean"))
    scored = heard.join(means, F.col(key) == F.col("_k")).withColumn("_s", F.round(dot(F.col("embedding"), F.col("_mean")) / F.sqrt(dot(F.col("_mean"), F.col("_mean"))), 6))
    limits = scored.withColumns({"_l": F.percentile("_s", F.lit(outliers)).over(w), "_n": F.count(F.lit(1)).over(w)})
    return limits.where("_n < 4 OR _s >= _l").drop("_k", "_mean", "_s", "_l", "_n")


def without_tiny(rows: DataFrame, key: str, least_ms: int = 2_000, share: float = 0.005) -> DataFrame:
    """`key`, person: clusters (person) of less speech (ms) than `least_ms` or a share of all go, vector by vector, to the nearest of the others; if all are so small, none does.

    One pass is enough: every small cluster is gone after it, and the others have only grown.
    """
    size = rows.groupBy("person").agg(F.sum("ms").alias("_ms"))
    total = size.agg(F.greatest(F.lit(float(least_ms)), F.sum("_ms") * share).alias("_least"))  # one row
    judged = size.join(F.broadcast(total)).select("person", (F.col("_ms") < F.col("_least")).alias("_tiny"))
    marked = rows.join(judged, "person")
    large = marked.where(~F.col("_tiny"))
    means = large.select("person", F.posexplode("embedding").alias("_i", "_x")).groupBy("person", "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m")).groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda p: p["_m"]).alias("embedding"))
    moved = best(similarities(marked.where("_tiny").select(F.col(key).alias("probe"), "embedding"), means), 1, digits=12)
    return rows.select(key, "person").join(moved.select(F.col("probe").alias(key), F.col("person").alias("_new")), key, "left").select(key, F.coalesce("_new", "person").alias("person"))
