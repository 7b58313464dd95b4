"""Queries on time and order."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from talkgrid.operators import sequence as O
from talkgrid.plans.base import CTE, utts, words
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import table

# Fixed value: one short stretch that follows itself three times or more.
REPEATED = r"(\S{1,8}?)(?:\s*\1){3,}"
REGISTRY = Registry()
add = REGISTRY.add

_SPANS = """, v AS (SELECT job_id, s, e FROM {0} WHERE e > s), r AS (SELECT *, max(e) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > {1} THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM r),
m AS (SELECT job_id, n, min(s) AS s, max(e) AS e FROM i GROUP BY ALL)"""


@add("merge_spans", CTE + _SPANS.format("u", 2000) + "SELECT job_id, s, e FROM m")
def merge_spans(spark, d):
    return O.merged_in_slots(utts(spark, d).select("job_id", "s", "e"), ["job_id"], 2000)


@add("speech_regions", CTE + _SPANS.format("w", 600) + "SELECT job_id, s, e FROM m")
def speech_regions(spark, d):
    return O.merged_in_slots(words(spark, d).select("job_id", "s", "e"), ["job_id"], 600)


_MISSED = """, j AS (SELECT DISTINCT job_id, s, e FROM u WHERE e > s), c AS (SELECT job_id, s - 1000 AS s, e + 1000 AS e FROM w WHERE e > s),
x AS (SELECT job_id, t, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM (SELECT job_id, s AS t, 1 AS a, 0 AS b FROM j UNION ALL SELECT job_id, e, -1, 0 FROM j UNION ALL SELECT job_id, s, 0, 1 FROM c UNION ALL SELECT job_id, e, 0, -1 FROM c) GROUP BY ALL),
h AS (SELECT job_id, t AS s, lead(t) OVER (PARTITION BY job_id ORDER BY t) AS e, sum(a) OVER (PARTITION BY job_id ORDER BY t) AS a, sum(b) OVER (PARTITION BY job_id ORDER BY t) AS b FROM x),
miss AS (SELECT job_id, s, e FROM h WHERE a > 0 AND b = 0 AND e IS NOT NULL), r AS (SELECT *, max(e) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM miss),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM r),
miss2 AS (SELECT job_id, greatest(min(s), 0) AS s, CASE WHEN total > 0 THEN least(max(e), total) ELSE max(e) END AS e, CAST(sum(e - s) AS BIGINT) AS voiced FROM i JOIN (SELECT job_id, CAST(round_even(coalesce(duration, 0) * 1000, 0) AS BIGINT) AS total FROM jobs) USING (job_id) GROUP BY job_id, n, total HAVING sum(e - s) >= 3000)
"""


@add("missed_spans", CTE + _MISSED + "SELECT * FROM miss2")
def missed_spans(spark, d):
    """Speech without words: spans of utterances minus padded words; pieces two seconds apart count together, from three seconds of voice on, inside the recording."""
    speech = utts(spark, d).where("e > s").select("job_id", "s", "e").distinct()
    cover = words(spark, d).where("e > s").select("job_id", (F.col("s") - 1000).alias("s"), (F.col("e") + 1000).alias("e"))
    miss = O.uncovered(speech, cover, ["job_id"])
    w = W.partitionBy("job_id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    n = miss.withColumn("f", F.when(reach.isNull() | (F.col("s") - reach > 2000), 1).otherwise(0)).withColumn("n", F.sum("f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = n.groupBy("job_id", "n").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum(F.col("e") - F.col("s")).alias("voiced")).where("voiced >= 3000")
    total = table(spark, d, "jobs").select("job_id", F.bround(F.coalesce("duration", F.lit(0.0)) * 1000).cast("bigint").alias("total"))
    end = F.when(F.col("total") > 0, F.least("e", "total")).otherwise(F.col("e"))
    return found.join(total, "job_id").select("job_id", F.greatest("s", F.lit(0)).alias("s"), end.alias("e"), "voiced")


@add("missed_spans_fallback", CTE + _SPANS.format("w", 0) + """, t AS (SELECT job_id, CAST(round_even(coalesce(duration, 0) * 1000, 0) AS BIGINT) AS total FROM jobs), b AS (SELECT job_id, s, e FROM m UNION ALL SELECT job_id, total, total FROM t),
g AS (SELECT job_id, coalesce(max(e) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, s AS z FROM b) SELECT job_id, a AS s, z AS e FROM g WHERE z - a >= 20000""")
def missed_spans_fallback(spark, d):
    """Stretches of twenty seconds or more without any word, up to the recording's end."""
    cover = O.merged_in_slots(words(spark, d).select("job_id", "s", "e"), ["job_id"])
    total = F.bround(F.coalesce("duration", F.lit(0.0)) * 1000).cast("bigint")
    both = cover.unionByName(table(spark, d, "jobs").select("job_id", total.alias("s"), total.alias("e")))
    before = F.coalesce(F.max("e").over(W.partitionBy("job_id").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return both.select("job_id", before.alias("a"), F.col("s").alias("z")).where("z - a >= 20000").select("job_id", F.col("a").alias("s"), F.col("z").alias("e"))


_WINDOWS = """, g AS (SELECT job_id, s, e, (e - s - 1500) // 750 AS k FROM m WHERE e - s >= 500), z AS (
SELECT job_id, s, e FROM g WHERE e - s <= 1500 UNION ALL
SELECT job_id, s + i * 750, least(s + i * 750 + 1500, e) FROM (SELECT job_id, s, e, unnest(range(0, k + 1)) AS i FROM g WHERE e - s > 1500) UNION ALL
SELECT job_id, e - 1500, e FROM g WHERE e - s > 1500 AND e - (s + k * 750 + 1500) > 375)"""


@add("sliding_windows", CTE + _SPANS.format("w", 600) + _WINDOWS + "SELECT * FROM z")
def sliding_windows(spark, d):
    return O.sliding_windows(speech_regions(spark, d), ["job_id"])


@add("chunk_windows", CTE + _SPANS.format("w", 600) + _WINDOWS + """, b AS (SELECT *, lag(e) OVER (PARTITION BY job_id ORDER BY s, e) AS before FROM z), c AS (SELECT *, sum(CASE WHEN before IS NULL OR s - before > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM b),
k AS (SELECT *, (row_number() OVER (PARTITION BY job_id, isle ORDER BY s, e) - 1) // 3 AS part FROM c) SELECT job_id, min(s) AS s, max(e) AS e, count(*) AS n FROM k GROUP BY job_id, isle, part""")
def chunk_windows(spark, d):
    w = W.partitionBy("job_id").orderBy("s", "e")
    z = sliding_windows(spark, d).withColumn("b", F.lag("e").over(w))
    isle = z.withColumn("f", F.when(F.col("b").isNull() | (F.col("s") - F.col("b") > 500), 1).otherwise(0)).withColumn("isle", F.sum("f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    part = F.floor((F.row_number().over(W.partitionBy("job_id", "isle").orderBy("s", "e")) - 1) / 3)
    return isle.withColumn("part", part).groupBy("job_id", "isle", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n")).select("job_id", "s", "e", "n")


@add("speaker_runs", CTE + """, x AS (SELECT *, lag(speaker) OVER (PARTITION BY job_id ORDER BY utt_idx) AS before, row_number() OVER (PARTITION BY job_id ORDER BY utt_idx) AS rn FROM u), y AS (
SELECT *, sum(CASE WHEN rn = 1 OR speaker IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY utt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM x)
SELECT job_id, CAST(run AS BIGINT) AS run, speaker, count(*) AS n, min(s) AS s, max(e) AS e FROM y GROUP BY ALL""")
def speaker_runs(spark, d):
    return O.runs(utts(spark, d), ["job_id"], ["utt_idx"], "speaker")


_SPOKEN = CTE + """, sp AS (SELECT w.job_id, w.utt_id, w.word_idx, w.s, w.e, w.word, w.prob, coalesce(u.speaker, '') AS speaker FROM w JOIN u USING (utt_id) WHERE w.s IS NOT NULL AND w.e IS NOT NULL)"""


def _spoken(spark, d):
    u = utts(spark, d).select("utt_id", F.coalesce("speaker", F.lit("")).alias("speaker"))
    return words(spark, d).join(u, "utt_id").where("s IS NOT NULL AND e IS NOT NULL")


@add("build_utterances", """WITH RECURSIVE """ + _SPOKEN[len("\nWITH "):] + """, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY s, utt_id, word_idx) AS rn FROM sp), f AS (
SELECT job_id, rn, s, e, word, speaker, s AS first_s, 0 AS no FROM o WHERE rn = 1 UNION ALL
SELECT o.job_id, o.rn, o.s, o.e, o.word, o.speaker, CASE WHEN o.speaker <> f.speaker OR o.s - f.e > 8000 OR (o.s - f.first_s > 45000 AND trim(f.word) <> '' AND contains('。？！?!', right(trim(f.word), 1))) THEN o.s ELSE f.first_s END,
  CASE WHEN o.speaker <> f.speaker OR o.s - f.e > 8000 OR (o.s - f.first_s > 45000 AND trim(f.word) <> '' AND contains('。？！?!', right(trim(f.word), 1))) THEN f.no + 1 ELSE f.no END FROM f JOIN o ON o.job_id = f.job_id AND o.rn = f.rn + 1)
SELECT job_id, CAST(no AS BIGINT) AS no, min(speaker) AS speaker, arg_min(s, rn) AS s, arg_max(e, rn) AS e, count(*) AS n FROM f GROUP BY job_id, no""")
def build_utterances(spark, d):
    return O.built_utterances(_spoken(spark, d))


@add("majority_label", _SPOKEN + """, k AS (SELECT utt_id, CASE WHEN word_idx % 3 = 0 THEN 'a' WHEN word_idx % 3 = 1 THEN 'b' ELSE 'c' END AS label, greatest(e - s, 10) AS d, word_idx FROM sp), t AS (SELECT utt_id, label, sum(d) AS d, min(word_idx) AS f FROM k GROUP BY ALL)
SELECT utt_id, label FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY d DESC, f, label) AS r FROM t) WHERE r = 1""")
def majority_label(spark, d):
    m = F.col("word_idx") % 3
    k = _spoken(spark, d).withColumn("label", F.when(m == 0, "a").when(m == 1, "b").otherwise("c"))
    return O.majority(k, ["utt_id"], "label", F.greatest(F.col("e") - F.col("s"), F.lit(10)), "word_idx")


_TURNS = CTE + """, turn AS (SELECT job_id, s, e, speaker FROM u WHERE e > s AND utt_idx % 2 = 0 AND speaker <> ''), point AS (SELECT DISTINCT job_id, utt_id AS id, (s + e) // 2 AS t FROM u WHERE e > s AND utt_idx % 2 = 1)"""


@add("assign_words_turns", _TURNS + """, b AS (SELECT p.job_id, p.id, p.t, x.s, x.e, x.speaker, row_number() OVER (PARTITION BY p.id ORDER BY x.s DESC, x.e DESC, x.speaker DESC) AS r FROM point p JOIN turn x ON x.job_id = p.job_id AND x.s <= p.t),
a AS (SELECT p.id, p.t, x.s, x.speaker, row_number() OVER (PARTITION BY p.id ORDER BY x.s, x.e, x.speaker) AS r FROM point p JOIN turn x ON x.job_id = p.job_id AND x.s > p.t)
SELECT p.job_id, p.id, CASE WHEN b.id IS NULL THEN a.speaker WHEN a.id IS NULL OR greatest(p.t - b.e, 0) <= a.s - p.t THEN b.speaker ELSE a.speaker END AS speaker
FROM point p LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON b.id = p.id LEFT JOIN (SELECT * FROM a WHERE r = 1) a ON a.id = p.id""")
def assign_words_turns(spark, d):
    u = utts(spark, d).where("e > s")
    turns = u.where("utt_idx % 2 = 0").select("job_id", "s", "e", "speaker")
    points = u.where("utt_idx % 2 = 1").select("job_id", F.col("utt_id").alias("id"), F.floor((F.col("s") + F.col("e")) / 2).alias("t"))
    return O.nearest_turn(points, turns, ["job_id"])


@add("words_in_window", CTE + """, c AS (SELECT DISTINCT job_id, clip_id, CAST(round_even(start * 1000, 0) AS BIGINT) AS a, CAST(round_even("end" * 1000, 0) AS BIGINT) AS b FROM clips)
SELECT c.clip_id, count(*) AS n, min(w.s) AS first_s FROM c JOIN w ON w.job_id = c.job_id AND (w.s + w.e) // 2 >= c.a AND (w.s + w.e) // 2 < c.b GROUP BY c.clip_id""")
def words_in_window(spark, d):
    """Words whose middle lies in a clip."""
    clips = table(spark, d, "clips").select("job_id", "clip_id", F.bround(F.col("start") * 1000).cast("bigint").alias("s"), F.bround(F.col("end") * 1000).cast("bigint").alias("e")).dropDuplicates(["clip_id"])
    points = words(spark, d).select("job_id", F.col("s").alias("ws"), F.floor((F.col("s") + F.col("e")) / 2).alias("t")).where("t IS NOT NULL")
    return O.in_windows(points, clips, ["job_id"], 30_000).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.min("ws").alias("first_s"))


@add("resume_boundary", CTE + _SPANS.format("u", -1) + """, b AS (SELECT job_id, max(e) // 2 - 2000 AS t FROM u WHERE e > s GROUP BY job_id)
SELECT b.job_id, greatest(coalesce(min(CASE WHEN m.s < b.t AND b.t < m.e THEN m.s END), b.t), 0) AS boundary FROM b LEFT JOIN m ON m.job_id = b.job_id GROUP BY b.job_id, b.t""")
def resume_boundary(spark, d):
    """Two seconds before the middle of each recording, moved back to where no utterance crosses it."""
    u = utts(spark, d).where("e > s")
    isles = O.merged_spans(u.select("job_id", "s", "e"), ["job_id"], -1)
    at = u.groupBy("job_id").agg((F.floor(F.max("e") / 2) - 2000).alias("t"))
    crossing = F.min(F.when((F.col("s") < F.col("t")) & (F.col("t") < F.col("e")), F.col("s")))
    return at.join(isles, "job_id", "left").groupBy("job_id", "t").agg(crossing.alias("c")).select("job_id", F.greatest(F.coalesce("c", "t"), F.lit(0)).alias("boundary"))


@add("select_candidate_clips", """WITH RECURSIVE """ + (CTE + _MISSED)[len("\nWITH "):] + """, pb AS (SELECT utt_id, count(prob) AS n, sum(CASE WHEN prob < 0.5 THEN 1 ELSE 0 END) AS low FROM w GROUP BY utt_id),
ps AS (SELECT utt_id, text, unnest(range(1, length(text) + 1)) AS i FROM u WHERE length(text) >= 4), un AS (SELECT utt_id, substr(text, i, k) AS unit, substr(text, i + k) AS rest FROM ps, range(1, 9) t(k)), rp AS (SELECT DISTINCT utt_id FROM un WHERE NOT regexp_matches(unit, '[\\s\\x0B]') AND length(rest) >= 3 * length(unit) AND starts_with(regexp_replace(rest, '^[\\s\\x0B]+', ''), unit)
AND regexp_matches(rest, '^([\\s\\x0B]*' || regexp_escape(unit) || '){3}')), tg AS (SELECT job_id, s, e, 0 AS o FROM miss2 UNION ALL SELECT u.job_id, u.s, u.e, u.utt_id FROM u LEFT JOIN pb USING (utt_id) WHERE utt_id IN (SELECT utt_id FROM rp) OR (pb.n >= 3 AND pb.low * 2 >= pb.n)),
xx AS (SELECT job_id, greatest(s - 2000, 0) AS s, e + 2000 AS e, row_number() OVER (PARTITION BY job_id ORDER BY s, e, o) AS rn FROM tg WHERE e > s),
f AS (SELECT job_id, rn, s, e, 0 AS no FROM xx x WHERE rn = 1 UNION ALL SELECT x.job_id, x.rn, CASE WHEN x.s <= f.e AND x.e - f.s <= 30000 THEN f.s ELSE x.s END, CASE WHEN x.s <= f.e AND x.e - f.s <= 30000 THEN greatest(f.e, x.e) ELSE x.e END, CASE WHEN x.s <= f.e AND x.e - f.s <= 30000 THEN f.no ELSE f.no + 1 END
FROM f JOIN xx x ON x.job_id = f.job_id AND x.rn = f.rn + 1), m AS (SELECT job_id, no, arg_max(s, rn) AS s, arg_max(e, rn) AS e FROM f GROUP BY ALL)
SELECT job_id, s + i * 30000 AS s, least(s + (i + 1) * 30000, e) AS e FROM (SELECT job_id, s, e, unnest(range(0, (e - s + 29999) // 30000)) AS i FROM m)""")
def select_candidate_clips(spark, d):
    """Speech without words, texts that repeat themselves and words of low probability, with two seconds around them, joined up to thirty seconds, cut into pieces of thirty."""
    from talkgrid.operators.scan import ordered_scan

    p = words(spark, d).groupBy("utt_id").agg(F.count("prob").alias("n"), F.sum((F.col("prob") < 0.5).cast("int")).alias("low"))
    u = utts(spark, d).join(p, "utt_id", "left")
    loops = F.coalesce(F.col("text").rlike(REPEATED), F.lit(False))
    doubtful = F.coalesce((F.col("n") >= 3) & (F.col("low") * 2 >= F.col("n")), F.lit(False))
    targets = u.where(loops | doubtful).select("job_id", "s", "e", F.col("utt_id").alias("o")).unionByName(missed_spans(spark, d).select("job_id", "s", "e", F.lit(0).cast("bigint").alias("o")))
    x = targets.where("e > s").select("job_id", F.col("s").alias("_s"), F.col("e").alias("_e"), "o", F.greatest(F.col("s") - 2000, F.lit(0)).alias("s"), (F.col("e") + 2000).alias("e"))
    spans = ordered_scan(x, ["job_id"], ["_s", "_e", "o"], lambda: O.CappedSpans(30_000), "s bigint, e bigint")
    cut = spans.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("e") - F.col("s") + 29_999) / 30_000) - 1)))
    return cut.select("job_id", (F.col("s") + F.col("i") * 30_000).alias("s"), F.least(F.col("s") + (F.col("i") + 1) * 30_000, F.col("e")).alias("e"))


_FOLD = """WITH RECURSIVE """ + CTE[len("\nWITH "):] + """, x AS (SELECT job_id, utt_id AS id, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY job_id ORDER BY utt_idx, utt_id) AS rn FROM u),
f AS (SELECT job_id, id, rn, size AS total, 1 AS n, 0 AS chunk FROM x WHERE rn = 1 UNION ALL SELECT x.job_id, x.id, x.rn, CASE WHEN {0} THEN x.size ELSE f.total + x.size END, CASE WHEN {0} THEN 1 ELSE f.n + 1 END, CASE WHEN {0} THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN x ON x.job_id = f.job_id AND x.rn = f.rn + 1)
SELECT job_id, id, CAST(chunk AS BIGINT) AS chunk FROM f"""


def _sized(spark, d):
    return utts(spark, d).select("job_id", F.col("utt_id").alias("id"), "utt_idx", F.coalesce(F.char_length("text"), F.lit(0)).alias("size"))


@add("chunk_by_chars", _FOLD.format("f.total + x.size > 600"))
def chunk_by_chars(spark, d):
    return O.packed(_sized(spark, d), ["job_id"], ["utt_idx", "id"], 600)


@add("proofread_chunks", _FOLD.format("f.total >= 500"))
def proofread_chunks(spark, d):
    return O.packed(_sized(spark, d), ["job_id"], ["utt_idx", "id"], 500, after=True)


@add("batch_items", _FOLD.format("(f.total + x.size > 400 OR f.n >= 6)"))
def batch_items(spark, d):
    return O.packed(_sized(spark, d), ["job_id"], ["utt_idx", "id"], 400, most=6)


@add("overlap_tail", CTE + """, x AS (SELECT job_id, utt_idx, coalesce(text, '') AS line, row_number() OVER (PARTITION BY job_id ORDER BY utt_idx DESC) AS rn, sum(length(coalesce(text, ''))) OVER (PARTITION BY job_id ORDER BY utt_idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM u)
SELECT job_id, string_agg(line, chr(10) ORDER BY utt_idx) AS tail FROM x WHERE rn <= 3 AND (rn = 1 OR total <= 200) GROUP BY job_id""")
def overlap_tail(spark, d):
    back = W.partitionBy("job_id").orderBy(F.desc("utt_idx"))
    x = utts(spark, d).select("job_id", "utt_idx", F.coalesce("text", F.lit("")).alias("line"))
    x = x.withColumns({"rn": F.row_number().over(back), "total": F.sum(F.char_length("line")).over(back.rowsBetween(W.unboundedPreceding, 0))})
    parts = F.array_sort(F.collect_list(F.struct("utt_idx", "line")))
    return x.where("rn <= 3 AND (rn = 1 OR total <= 200)").groupBy("job_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("tail"))


@add("checkpoint_throttle", """WITH RECURSIVE x AS (SELECT user_id, event_id AS id, (epoch_us(ts) // 1000) AS t, event_type AS phase, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS rn FROM events WHERE event_type IN ('view', 'click')),
f AS (SELECT user_id, id, rn, t AS at, phase, true AS saved FROM x WHERE rn = 1 UNION ALL SELECT x.user_id, x.id, x.rn, CASE WHEN x.t - f.at >= 3600000 OR x.phase <> f.phase THEN x.t ELSE f.at END, CASE WHEN x.t - f.at >= 3600000 OR x.phase <> f.phase THEN x.phase ELSE f.phase END, x.t - f.at >= 3600000 OR x.phase <> f.phase
FROM f JOIN x ON x.user_id = f.user_id AND x.rn = f.rn + 1) SELECT user_id, id FROM f WHERE saved""")
def checkpoint_throttle(spark, d):
    e = table(spark, d, "events").where("event_type IN ('view', 'click')").select("user_id", F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("phase"))
    return O.throttled(e, ["user_id"], 3_600_000)


@add("tumbling_30s", CTE + "SELECT job_id, s // 30000 * 30000 AS window_s, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM u WHERE s IS NOT NULL GROUP BY ALL")
def tumbling_30s(spark, d):
    return utts(spark, d).where("s IS NOT NULL").groupBy("job_id", (F.floor(F.col("s") / 30_000) * 30_000).alias("window_s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"))


@add("block_halo_plan", """WITH j AS (SELECT job_id, CAST(round_even(coalesce(duration, 0) * 1000, 0) AS BIGINT) AS total FROM jobs), k AS (SELECT job_id, total, unnest(range(0, (total + 29999) // 30000)) AS i FROM j)
SELECT job_id, i AS block, i * 30000 AS s, least((i + 1) * 30000, total) AS e, greatest(i * 30000 - 2000, 0) AS read_s, least((i + 1) * 30000 + 2000, total) AS read_e FROM k""")
def block_halo_plan(spark, d):
    j = table(spark, d, "jobs").select("job_id", F.bround(F.coalesce("duration", F.lit(0.0)) * 1000).cast("bigint").alias("total")).where("total > 0")
    k = j.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") + 29_999) / 30_000) - 1)))
    s = F.col("i") * 30_000
    return k.select("job_id", F.col("i").alias("block"), s.alias("s"), F.least(s + 30_000, F.col("total")).alias("e"), F.greatest(s - 2000, F.lit(0)).alias("read_s"), F.least(s + 32_000, F.col("total")).alias("read_e"))


@add("audio_tail", CTE + "SELECT utt_id, s - 60000 AS tail_s, (s - 60000) + 60000 AS s FROM u WHERE s >= 60000")
def audio_tail(spark, d):
    """Rows after a resume point, by their time in the rest of the recording and in the whole."""
    return utts(spark, d).where("s >= 60000").select("utt_id", (F.col("s") - 60_000).alias("tail_s")).withColumn("s", F.col("tail_s") + 60_000)
