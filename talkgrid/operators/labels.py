"""Speaker labels of words put right by the runs they stand in; windows only, one utterance after the other.

Words have utt_id, word_idx, s, e (milliseconds), word and label; a run is a stretch of words of one label.  A null
label counts as an empty one, and an empty label is never given to other words.  Every function returns utt_id,
word_idx and the new label of every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: What ends a phrase.
MARKS = "。？！?!、，,"

def _utt():
    return W.partitionBy("utt_id")


def runs(words: DataFrame, apart: Column | None = None) -> DataFrame:
    """utt_id, r (from 1), label, n, idx (its words), lo and hi (first start, last end), low and high (least start, greatest end) of every run; it also begins anew where `apart` holds."""
    order = _utt().orderBy("word_idx")
    label = F.coalesce("label", F.lit(""))
    change = F.lag(label).over(order).isNull() | (F.lag(label).over(order) != label)
    new = (change | apart) if apart is not None else change
    numbered = words.withColumn("_r", F.sum(new.cast("int")).over(order))
    return numbered.groupBy("utt_id", F.col("_r").alias("r")).agg(
        F.first(label).alias("label"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("word_idx")).alias("idx"),
        F.min_by("s", "word_idx").alias("lo"), F.max_by("e", "word_idx").alias("hi"), F.min("s").alias("low"), F.max("e").alias("high"),
    )


def _words(relabelled: DataFrame, label: Column) -> DataFrame:
    return relabelled.select("utt_id", F.explode("idx").alias("word_idx"), label.alias("label"))


def _full(label: Column) -> Column:
    return F.when(label != "", label)


def without_flicker(words: DataFrame, most: int = 2, shorter: int = 600) -> DataFrame:
    """Runs of at most `most` words and less than `shorter` ms take the label before them, and at the beginning the one after.

    Short runs that follow one another share what the first of them gets: what a longer run before them has, else
    the label of the run after the first of them.
    """
    order = _utt().orderBy("r")
    short = (F.col("n") <= most) & (F.col("hi") - F.col("lo") < shorter)
    marked = runs(words).withColumns({"short": F.coalesce(short, F.lit(False)), "after": F.lead("label").over(order)})
    chained = marked.withColumn("chain", F.sum((~F.col("short")).cast("int")).over(order))
    chain = W.partitionBy("utt_id", "chain").orderBy("r").rowsBetween(W.unboundedPreceding, W.currentRow)
    longer = F.first(F.when(~F.col("short"), _full(F.col("label"))), ignorenulls=True).over(chain)
    first = F.first(F.when(F.col("short"), F.coalesce(_full(F.col("after")), F.col("label"))), ignorenulls=True).over(chain)
    return _words(chained.withColumn("new", F.when(F.col("short"), F.coalesce(longer, first)).otherwise(F.col("label"))), F.col("new"))


def without_single_windows(words: DataFrame) -> DataFrame:
    """A single word between two runs of one other label takes that label; of several in a row every second one, as the first gives way."""
    order = _utt().orderBy("r")
    alone = (F.col("n") == 1) & (F.lag("label").over(order) == F.lead("label").over(order))
    marked = runs(words).withColumns({"alone": F.coalesce(alone, F.lit(False)), "before": F.lag("label").over(order)})
    streak = marked.withColumn("streak", F.sum((~F.col("alone")).cast("int")).over(order))
    place = F.sum(F.col("alone").cast("int")).over(W.partitionBy("utt_id", "streak").orderBy("r"))
    return _words(streak.withColumn("new", F.when(F.col("alone") & (place % 2 == 1), F.col("before")).otherwise(F.col("label"))), F.col("new"))


def snapped_edges(words: DataFrame, most: int = 2, shorter: int = 800, share: float = 0.6) -> DataFrame:
    """A short run at the head of an utterance, and then one at its tail, takes the label next to it if most words have that one.

    Utterances of fewer than four words stay as they are.
    """
    every = _utt().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    inside = every.orderBy("r")
    of = runs(words).withColumns({"total": F.sum("n").over(every), "last": F.max("r").over(every), "next": F.lead("label").over(_utt().orderBy("r")), "before": F.lag("label").over(_utt().orderBy("r"))})
    small = (F.col("total") >= 4) & (F.col("n") <= most) & (F.col("high") - F.col("low") < shorter) & (F.col("last") > 1)
    has = lambda label, frame: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).over(frame)
    neighbour = of.withColumn("body", F.first(F.when(F.col("r") == 1, F.col("next")), ignorenulls=True).over(inside))
    counted = neighbour.withColumn("bodies", has(F.col("body"), every))
    head = F.first(F.when(F.col("r") == 1, small & (F.col("bodies") >= share * F.col("total"))), ignorenulls=True).over(inside)
    snapped = counted.withColumn("head", F.coalesce(head, F.lit(False))).withColumn("label", F.when((F.col("r") == 1) & F.col("head"), F.col("body")).otherwise(F.col("label")))
    # Two runs of which the head has given way are one: it has no tail.
    tail = F.last(F.when(F.col("r") == F.col("last"), F.when(F.col("last") == 2, F.when(~F.col("head"), F.col("before"))).otherwise(F.col("before"))), ignorenulls=True).over(inside)
    behind = snapped.withColumn("tail", tail).withColumn("tails", has(F.col("tail"), every))
    gives = (F.col("r") == F.col("last")) & small & (F.col("tails") >= share * F.col("total"))
    return _words(behind.withColumn("new", F.when(gives, F.col("tail")).otherwise(F.col("label"))), F.col("new"))


def voted_phrases(words: DataFrame, gap: int = 300, keep: int = 1500) -> DataFrame:
    """Every phrase (up to a mark or a pause) gets its main speaker, by time; runs of `keep` ms or more stay. Of equals the first speaks."""
    order = _utt().orderBy("word_idx")
    ends = F.rtrim("word").rlike(f"[{MARKS}]$") | (F.lead("s").over(order) - F.col("e") >= gap)
    marked = words.withColumn("_ends", F.coalesce(ends, F.lit(False)))
    marked = marked.withColumn("_apart", F.coalesce(F.lag("_ends").over(order), F.lit(False)))
    parts = runs(marked, F.col("_apart"))
    begins = marked.where("_apart").select("utt_id", F.col("word_idx").alias("_first"))
    # A run begins a phrase if its first word follows a mark or a pause.
    phrase = parts.withColumn("_first", F.col("idx")[0]).join(begins.withColumn("_new", F.lit(1)), ["utt_id", "_first"], "left").withColumn("p", F.sum(F.coalesce("_new", F.lit(0))).over(_utt().orderBy("r"))).withColumn("long", F.col("hi") - F.col("lo"))
    weighed = phrase.withColumn("weight", F.sum("long").over(W.partitionBy("utt_id", "p", "label"))).withColumn("since", F.min("r").over(W.partitionBy("utt_id", "p", "label")))
    main = F.first("label").over(W.partitionBy("utt_id", "p").orderBy(F.desc("weight"), "since"))
    return _words(weighed.withColumn("main", main).withColumn("new", F.when(F.col("long") < keep, F.col("main")).otherwise(F.col("label"))), F.col("new"))
