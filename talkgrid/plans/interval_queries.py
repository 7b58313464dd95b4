"""p2: continuous periods and gaps."""

from __future__ import annotations

from talkgrid.operators.intervals import layers, periods_and_gaps
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import table

REGISTRY = Registry()

_P2 = """
WITH every AS (
  SELECT 'utterances' AS layer, job_id, CAST(round_even(start * 1000, 0) AS BIGINT) AS s, CAST(round_even("end" * 1000, 0) AS BIGINT) AS e FROM utterances
  UNION ALL
  SELECT 'words', job_id, CAST(round_even(start * 1000, 0) AS BIGINT), CAST(round_even("end" * 1000, 0) AS BIGINT) FROM words
), reach AS (
  SELECT *, max(e) OVER (PARTITION BY layer, job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM every WHERE e > s
), island AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY layer, job_id ORDER BY s, e) AS n FROM reach
), period AS (
  SELECT layer, job_id, n, min(s) AS a, max(e) AS b FROM island GROUP BY ALL
), follow AS (
  SELECT *, lead(a) OVER (PARTITION BY layer, job_id ORDER BY a) AS next_a FROM period
)
SELECT layer, job_id, 'period' AS kind, a AS from_ms, b AS to_ms FROM period
UNION ALL
SELECT layer, job_id, 'gap', b, next_a FROM follow WHERE next_a IS NOT NULL
"""


@REGISTRY.add("p2_found", _P2)
def p2_found(spark, sf_dir):
    """Periods and gaps of utterances and of words, per job, in milliseconds."""
    return periods_and_gaps(layers(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "words")), ["layer", "job_id"], "s", "e")
