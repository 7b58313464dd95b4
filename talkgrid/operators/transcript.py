"""Operators on utterances: statistics, review, renaming, replacing, rendering."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkgrid.functions import clock, text as X


def speaker_stats(utts: DataFrame) -> DataFrame:
    """job_id, speaker, ms, n: time and number of utterances of every named label; a negative length counts as none."""
    return utts.where("speaker IS NOT NULL AND speaker != ''").groupBy("job_id", "speaker").agg(F.sum(F.greatest(F.coalesce(F.col("e") - F.col("s"), F.lit(0)), F.lit(0))).alias("ms"), F.count(F.lit(1)).alias("n"))


def speaker_share(stats: DataFrame) -> DataFrame:
    """pct: each speaker's part of the job's time in whole percent; 0 where nobody spoke."""
    total = F.sum("ms").over(W.partitionBy("job_id"))
    return stats.select("job_id", "speaker", F.when(total > 0, F.bround(100 * F.col("ms") / total, 0)).otherwise(0).cast("bigint").alias("pct"))


def first_seen(utts: DataFrame, colours: int = 10) -> DataFrame:
    """job_id, speaker, rank (from 0), colour: labels by their first utterance."""
    seen = utts.where("speaker IS NOT NULL AND speaker != ''").groupBy("job_id", "speaker").agg(F.min("utt_idx").alias("i"))
    rank = F.row_number().over(W.partitionBy("job_id").orderBy("i", "speaker")) - 1
    return seen.select("job_id", "speaker", rank.cast("bigint").alias("rank")).withColumn("colour", F.col("rank") % colours)


def count_text(utts: DataFrame, needle: str) -> DataFrame:
    """job_id, hits (utterances that hold the stretch), total (occurrences)."""
    n = X.occurrences(F.col("text"), needle)
    return utts.groupBy("job_id").agg(F.sum(F.when(n > 0, 1).otherwise(0)).alias("hits"), F.sum(n).alias("total"))


def replace_text(utts: DataFrame, wrong: str, right: str) -> DataFrame:
    """utt_id, text, marked of the utterances that a replacement changes."""
    text, marked = X.replaced(F.col("text"), F.col("marked"), wrong, right)
    return utts.where(F.contains("text", F.lit(wrong)) & F.lit(wrong != right)).select("utt_id", text.alias("text"), marked.alias("marked"))


def preview_replace(utts: DataFrame, wrong: str, most: int = 4, around: int = 18) -> DataFrame:
    """The first `most` utterances of each job that hold a stretch, with its surroundings."""
    rank = F.row_number().over(W.partitionBy("job_id").orderBy("utt_idx", "utt_id"))
    hit = utts.where(F.contains("text", F.lit(wrong))).withColumn("n", rank).where(F.col("n") <= most)
    at = F.instr("text", wrong)
    start = F.greatest(at - 1 - around, F.lit(0))
    return hit.select("job_id", "utt_id", F.substr("text", start + 1, at - 1 + len(wrong) + around - start).alias("example"))


def next_review(utts: DataFrame) -> DataFrame:
    """job_id, utt_idx, next_idx: the next utterance to review after each, from the start again behind the last; null if there is none."""
    flag = F.when(X.needs_review(F.col("marked"), F.col("proofread_pending")), F.col("utt_idx"))
    later = W.partitionBy("job_id").orderBy("utt_idx").rowsBetween(1, W.unboundedFollowing)
    return utts.select("job_id", "utt_idx", F.coalesce(F.min(flag).over(later), F.min(flag).over(W.partitionBy("job_id"))).alias("next_idx"))


def renamed(utts: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """utt_id, speaker with all renamings made at once, so that two names may be swapped."""
    if not names:
        return utts.select("utt_id", "speaker")
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return utts.select("utt_id", F.coalesce(F.element_at(table, F.col("speaker")), F.col("speaker")).alias("speaker"))


def neighbours(utts: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """job_id, utt_idx, context: the texts around each utterance, itself included, one a line."""
    w = W.partitionBy("job_id").orderBy("utt_idx").rowsBetween(-before, after)
    return utts.select("job_id", "utt_idx", F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), "\n").alias("context"))


def llm_lines(utts: DataFrame, unnamed: str = "話者") -> Column:
    """[HH:MM:SS] speaker: marked, for a text generator."""
    who = F.when(F.coalesce(F.col("speaker"), F.lit("")) == "", F.lit(unnamed)).otherwise(F.col("speaker"))
    return F.concat(F.lit("["), clock.hms(F.col("s")), F.lit("] "), who, F.lit(": "), F.coalesce("marked", "text", F.lit("")))


def joined_by_job(rows: DataFrame, order: list[str], piece: Column, sep: str, name: str) -> DataFrame:
    """job_id and one text: the pieces of each job in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, piece.alias("_piece"))))
    return rows.groupBy("job_id").agg(F.array_join(F.transform(parts, lambda x: x["_piece"]), sep).alias(name))


def cue_block(cues: DataFrame, kind: str) -> Column:
    """A numbered block of an SRT or VTT file; columns no, s, e, speaker, text."""
    mark = "," if kind == "srt" else "."
    times = F.concat(clock.cue_time(F.col("s"), mark), F.lit(" --> "), clock.cue_time(F.col("e"), mark))
    named = F.coalesce(F.col("speaker"), F.lit("")) != ""
    if kind == "srt":
        body = F.when(named, F.concat(F.lit("（"), "speaker", F.lit("）"), "text")).otherwise(F.col("text"))
    else:
        body = F.when(named, F.concat(F.lit("<v "), "speaker", F.lit(">"), "text")).otherwise(F.col("text"))
    return F.concat(F.col("no").cast("string"), F.lit("\n"), times, F.lit("\n"), body, F.lit("\n"))
