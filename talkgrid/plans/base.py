"""Adapters from the test tables to the shapes that operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkgrid.functions.clock import ms_of
from talkgrid.functions.text import RED_OPEN
from talkgrid.sources.tables import table

#: u: utterances counted once; w: words counted once; seg: one segment per utterance with times in milliseconds.
CTE = """
WITH u AS (
  SELECT DISTINCT utt_id, job_id, series_id, utt_idx, CAST(round_even(start * 1000, 0) AS BIGINT) AS s, CAST(round_even("end" * 1000, 0) AS BIGINT) AS e,
    speaker, text, marked, memo, human, proofread, proofread_pending FROM utterances
), w AS (
  SELECT DISTINCT job_id, utt_id, word_idx, CAST(round_even(start * 1000, 0) AS BIGINT) AS s, CAST(round_even("end" * 1000, 0) AS BIGINT) AS e, word, prob FROM words
)
"""


def utts(spark: SparkSession, d: str) -> DataFrame:
    """Utterances counted once, with s and e in milliseconds."""
    t = table(spark, d, "utterances")
    return t.select(
        "utt_id", "job_id", "series_id", "utt_idx", ms_of(F.col("start")).alias("s"), ms_of(F.col("end")).alias("e"), "speaker", "text", "marked", "memo", "human", "proofread", "proofread_pending"
    ).dropDuplicates(["utt_id"])


def words(spark: SparkSession, d: str) -> DataFrame:
    """Words counted once, with s and e in milliseconds."""
    t = table(spark, d, "words")
    return t.select("job_id", "utt_id", "word_idx", ms_of(F.col("start")).alias("s"), ms_of(F.col("end")).alias("e"), "word", "prob").dropDuplicates(["utt_id", "word_idx"])


RED = RED_OPEN.replace("'", "''")
