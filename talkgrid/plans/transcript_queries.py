"""Queries on utterances."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from talkgrid.functions import clock, text as X
from talkgrid.operators import transcript as O
from talkgrid.plans.base import CTE, RED, utts, words
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import table

REGISTRY = Registry()
add = REGISTRY.add

_PIECE = "fill the gaps"
_STRIP = f"""regexp_replace(coalesce({{0}}, ''), '{RED}(.*?)</span>', '\\1', 'gs')"""
_REVIEW = f"(coalesce(contains(marked, '{RED}'), false) OR coalesce(proofread_pending, false))"
_STATS = CTE + """, st AS (SELECT job_id, speaker, CAST(sum(greatest(coalesce(e - s, 0), 0)) AS BIGINT) AS ms, count(*) AS n FROM u WHERE speaker IS NOT NULL AND speaker <> '' GROUP BY ALL)"""


@add("speaker_stats", _STATS + "SELECT * FROM st")
def speaker_stats(spark, d):
    return O.speaker_stats(utts(spark, d))


@add("speaker_share", _STATS + "SELECT job_id, speaker, CAST(CASE WHEN sum(ms) OVER (PARTITION BY job_id) > 0 THEN round_even(100.0 * ms / sum(ms) OVER (PARTITION BY job_id), 0) ELSE 0 END AS BIGINT) AS pct FROM st")
def speaker_share(spark, d):
    return O.speaker_share(O.speaker_stats(utts(spark, d)))


@add("speaker_first_seen", CTE + """, f AS (SELECT job_id, speaker, min(utt_idx) AS i FROM u WHERE speaker <> '' GROUP BY ALL)
SELECT job_id, speaker, row_number() OVER (PARTITION BY job_id ORDER BY i, speaker) - 1 AS rank, (row_number() OVER (PARTITION BY job_id ORDER BY i, speaker) - 1) % 10 AS colour FROM f""")
def speaker_first_seen(spark, d):
    return O.first_seen(utts(spark, d))


@add("count_text", CTE + """, c AS (SELECT job_id, coalesce((length(text) - length(replace(text, 'です', ''))) // 2, 0) AS n FROM u)
SELECT job_id, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL""")
def count_text(spark, d):
    return O.count_text(utts(spark, d), "です")


@add("replace_text", CTE + f""", r AS (SELECT utt_id, replace(text, '確認', '点検') AS t, replace(coalesce(marked, text), '確認', '点検') AS m FROM u WHERE contains(text, '確認'))
SELECT utt_id, t AS text, replace(CASE WHEN {_STRIP.format('m')} <> t THEN t ELSE m END, '{RED}</span>', '') AS marked FROM r""")
def replace_text(spark, d):
    return O.replace_text(utts(spark, d), "確認", "点検")


@add("preview_replace", CTE + """, h AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY utt_idx, utt_id) AS n, instr(text, '確認') AS pos FROM u WHERE contains(text, '確認'))
SELECT job_id, utt_id, substr(text, greatest(pos - 19, 0) + 1, pos - 1 + 2 + 18 - greatest(pos - 19, 0)) AS example FROM h WHERE n <= 4""")
def preview_replace(spark, d):
    return O.preview_replace(utts(spark, d), "確認")


@add("needs_review", CTE + f"SELECT utt_id, {_REVIEW} AS review FROM u")
def needs_review(spark, d):
    return utts(spark, d).select("utt_id", X.needs_review(F.col("marked"), F.col("proofread_pending")).alias("review"))


@add("next_review", CTE + f""", f AS (SELECT job_id, utt_idx, CASE WHEN {_REVIEW} THEN utt_idx END AS k FROM u)
SELECT job_id, utt_idx, coalesce(min(k) OVER (PARTITION BY job_id ORDER BY utt_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(k) OVER (PARTITION BY job_id)) AS next_idx FROM f""")
def next_review(spark, d):
    return O.next_review(utts(spark, d))


@add("is_named_speaker", CTE + f"SELECT utt_id, coalesce(trim(speaker) <> '' AND NOT regexp_matches(trim(speaker), '{X.UNNAMED}'), false) AS named FROM u")
def is_named_speaker(spark, d):
    return utts(spark, d).select("utt_id", X.is_named(F.col("speaker")).alias("named"))


@add("speaker_rename_map", CTE + "SELECT utt_id, CASE speaker WHEN '話者A' THEN '話者B' WHEN '話者B' THEN '話者A' WHEN '不明' THEN 'unknown' ELSE speaker END AS speaker FROM u")
def speaker_rename_map(spark, d):
    return O.renamed(utts(spark, d), {"話者A": "話者B", "話者B": "話者A", "不明": "unknown"})


@add("context_window", CTE + "SELECT job_id, utt_idx, string_agg(coalesce(text, ''), chr(10)) OVER (PARTITION BY job_id ORDER BY utt_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM u")
def context_window(spark, d):
    return O.neighbours(utts(spark, d))


_HMS = "lpad(CAST(greatest({0}, 0) // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(greatest({0}, 0) // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(greatest({0}, 0) // 1000 % 60 AS VARCHAR), 2, '0')"
_CUE = _HMS + " || '{1}' || lpad(CAST(greatest({0}, 0) % 1000 AS VARCHAR), 3, '0')"


@add("format_times", CTE + f"""SELECT utt_id, {_HMS.format('s')} AS hms, {_CUE.format('s', ',')} AS srt, {_CUE.format('e', '.')} AS vtt,
CASE WHEN s // 3600000 > 0 THEN (s // 3600000) || '時間' || (s // 60000 % 60) || '分' || (s // 1000 % 60) || '秒' WHEN s // 60000 > 0 THEN (s // 60000) || '分' || (s // 1000 % 60) || '秒' ELSE (s // 1000) || '秒' END AS dur FROM u""")
def format_times(spark, d):
    s, e = F.col("s"), F.col("e")
    return utts(spark, d).select("utt_id", clock.hms(s).alias("hms"), clock.cue_time(s).alias("srt"), clock.cue_time(e, ".").alias("vtt"), clock.duration_text(s).alias("dur"))


@add("parse_time", CTE + f""", t AS (SELECT utt_id, s, CASE utt_id % 4 WHEN 0 THEN {_CUE.format('s', ',')} WHEN 1 THEN CAST(s // 60000 AS VARCHAR) || ':' || lpad(CAST(s // 1000 % 60 AS VARCHAR), 2, '0') WHEN 2 THEN CAST(s // 1000 AS VARCHAR) ELSE 'x' || s END AS shown FROM u)
SELECT utt_id, shown, CAST(CASE utt_id % 4 WHEN 0 THEN greatest(s, 0) WHEN 3 THEN NULL ELSE s // 1000 * 1000 END AS BIGINT) AS ms FROM t""")
def parse_time(spark, d):
    s = F.col("s")
    m = F.pmod("utt_id", F.lit(4))
    whole = F.floor(s / 1000).cast("bigint")
    shown = F.when(m == 0, clock.cue_time(s)).when(m == 1, F.concat(F.floor(s / 60000).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))).when(m == 2, whole.cast("string")).otherwise(F.concat(F.lit("x"), s.cast("string")))
    return utts(spark, d).select("utt_id", shown.alias("shown")).select("utt_id", "shown", clock.ms_of(clock.parse_seconds(F.col("shown"))).alias("ms"))


@add("meeting_date_from_name", """SELECT job_id, CAST(try_cast(regexp_extract(meeting_date, '(20\\d{2})[-_.年](\\d{1,2})[-_.月](\\d{1,2})', 1) || '-' || lpad(regexp_extract(meeting_date, '(20\\d{2})[-_.年](\\d{1,2})[-_.月](\\d{1,2})', 2), 2, '0') || '-' ||
lpad(regexp_extract(meeting_date, '(20\\d{2})[-_.年](\\d{1,2})[-_.月](\\d{1,2})', 3), 2, '0') AS DATE) AS VARCHAR) AS day FROM jobs""")
def meeting_date_from_name(spark, d):
    return table(spark, d, "jobs").select("job_id", clock.name_date(F.col("meeting_date")).alias("day"))


@add("transcript_for_llm", CTE + f"SELECT job_id, string_agg('[' || {_HMS.format('s')} || '] ' || CASE WHEN coalesce(speaker, '') = '' THEN '話者' ELSE speaker END || ': ' || coalesce(marked, text, ''), chr(10) ORDER BY s, utt_idx) AS transcript FROM u GROUP BY job_id")
def transcript_for_llm(spark, d):
    u = utts(spark, d)
    return O.joined_by_job(u, ["s", "utt_idx"], O.llm_lines(u), "\n", "transcript")


_CUES = CTE + ", c AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY s, utt_idx) AS no, s, e, speaker, text FROM u WHERE e > s AND trim(text) <> '')"


def _cues(spark, d):
    u = utts(spark, d).where("e > s AND trim(text) != ''")
    return u.select("job_id", F.row_number().over(W.partitionBy("job_id").orderBy("s", "utt_idx")).cast("bigint").alias("no"), "s", "e", "speaker", "text")


@add("render_srt", _CUES + f"SELECT job_id, string_agg(no || chr(10) || {_CUE.format('s', ',')} || ' --> ' || {_CUE.format('e', ',')} || chr(10) || CASE WHEN coalesce(speaker, '') <> '' THEN '（' || speaker || '）' || text ELSE text END || chr(10), chr(10) ORDER BY no) AS srt FROM c GROUP BY job_id")
def render_srt(spark, d):
    c = _cues(spark, d)
    return O.joined_by_job(c, ["no"], O.cue_block(c, "srt"), "\n", "srt")


@add("render_vtt", _CUES + f"SELECT job_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(no || chr(10) || {_CUE.format('s', '.')} || ' --> ' || {_CUE.format('e', '.')} || chr(10) || CASE WHEN coalesce(speaker, '') <> '' THEN '<v ' || speaker || '>' || text ELSE text END || chr(10), chr(10) ORDER BY no) AS vtt FROM c GROUP BY job_id")
def render_vtt(spark, d):
    c = _cues(spark, d)
    return O.joined_by_job(c, ["no"], O.cue_block(c, "vtt"), "\n", "vtt").select("job_id", F.concat(F.lit("WEBVTT\n\n"), "vtt").alias("vtt"))


@add("validate_cues", _CUES + """, x AS (SELECT *, lead(s) OVER (PARTITION BY job_id ORDER BY no) AS next_s FROM c), y AS (
SELECT job_id, no, unnest([CASE WHEN length(text) > 12.0 * (e - s) / 1000 THEN 'fast' END, CASE WHEN length(text) > 40 THEN 'long' END, CASE WHEN length(text) - length(replace(text, chr(10), '')) > 1 THEN 'lines' END, CASE WHEN next_s < e THEN 'overlap' END]) AS warning FROM x)
SELECT * FROM y WHERE warning IS NOT NULL""")
def validate_cues(spark, d):
    c = _cues(spark, d).withColumn("next_s", F.lead("s").over(W.partitionBy("job_id").orderBy("no")))
    n = F.char_length("text")
    warnings = F.array(
        F.when(n > 12.0 * (F.col("e") - F.col("s")) / 1000, "fast"), F.when(n > 40, "long"), F.when(X.occurrences(F.col("text"), "\n") > 1, "lines"), F.when(F.col("next_s") < F.col("e"), "overlap")
    )
    return c.select("job_id", "no", F.explode(F.array_compact(warnings)).alias("warning"))


@add("finalize_cues", _CUES + """, x AS (SELECT *, lead(s) OVER (PARTITION BY job_id ORDER BY no) AS next_s FROM c)
SELECT job_id, no, s, greatest(s + 1, least(greatest(e + 200, s + 1000), coalesce(next_s - 50, greatest(e + 200, s + 1000)))) AS e, rtrim(replace(text, '。', ' ')) AS text FROM x""")
def finalize_cues(spark, d):
    c = _cues(spark, d).withColumn("next_s", F.lead("s").over(W.partitionBy("job_id").orderBy("no")))
    want = F.greatest(F.col("e") + 200, F.col("s") + 1000)
    end = F.greatest(F.col("s") + 1, F.least(want, F.coalesce(F.col("next_s") - 50, want)))
    return c.select("job_id", "no", "s", end.alias("e"), F.rtrim(F.replace("text", F.lit("。"), F.lit(" "))).alias("text"))


@add("strip_marks", CTE + f"SELECT utt_id, {_STRIP.format('marked')} AS plain, replace(replace(marked, '{RED}', '⟦'), '</span>', '⟧') AS uncertain FROM u")
def strip_marks(spark, d):
    return utts(spark, d).select("utt_id", X.strip_marks(F.col("marked")).alias("plain"), X.to_uncertain(F.col("marked")).alias("uncertain"))


@add("marks_round_trip", CTE + "SELECT utt_id, marked FROM u")
def marks_round_trip(spark, d):
    return utts(spark, d).select("utt_id", X.from_uncertain(X.to_uncertain(F.col("marked"))).alias("marked"))


@add("escape_keep_red", CTE + f"""SELECT utt_id, replace(replace(replace(replace(replace(replace(marked, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '&lt;span style=&quot;color:red&quot;&gt;', '{RED}'), '&lt;/span&gt;', '</span>') AS html FROM u""")
def escape_keep_red(spark, d):
    return utts(spark, d).select("utt_id", X.escape_keep_red(F.col("marked")).alias("html"))


_KEYWORDS = "list_filter(list_distinct(regexp_extract_all(regexp_replace(coalesce(text, ''), '<span style=\"color:red\">(.*?)</span>', '\\1', 'g'), '[一-鿿々]{2,}|[ァ-ヺー]{2,}|[A-Za-z0-9０-９]{2,}')), lambda k: k NOT IN ('根拠', '担当', '期限', '未定', '確認', '必要', '事項'))"


@add("keywords", CTE + f"SELECT utt_id, list_sort({_KEYWORDS}) AS keywords FROM u WHERE text IS NOT NULL")
def keywords(spark, d):
    return utts(spark, d).where("text IS NOT NULL").select("utt_id", F.array_sort(X.keywords(F.col("text"))).alias("keywords"))


@add("normalize_for_compare", CTE + "SELECT utt_id, regexp_replace(coalesce(text, ''), '[\\s　、。？！?!，,]', '', 'g') AS plain FROM u")
def normalize_for_compare(spark, d):
    return utts(spark, d).select("utt_id", X.for_compare(F.col("text")).alias("plain"))


@add("count_edited", CTE + """, j AS (SELECT utt_id, string_agg(word, '' ORDER BY word_idx) AS joined FROM w GROUP BY utt_id)
SELECT job_id, CAST(sum(CASE WHEN regexp_replace(coalesce(text, ''), '[\\s　、。？！?!，,]', '', 'g') <> regexp_replace(joined, '[\\s　、。？！?!，,]', '', 'g') THEN 1 ELSE 0 END) AS BIGINT) AS edited FROM u JOIN j USING (utt_id) GROUP BY job_id""")
def count_edited(spark, d):
    parts = words(spark, d).groupBy("utt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), "").alias("joined"))
    both = utts(spark, d).join(parts, "utt_id")
    return both.groupBy("job_id").agg(F.sum(F.when(X.for_compare(F.col("text")) != X.for_compare(F.col("joined")), 1).otherwise(0)).alias("edited"))


@add("low_conf_ratio", CTE + "SELECT job_id, round_even(CAST(sum(CASE WHEN prob < 0.5 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 3) AS ratio FROM w GROUP BY job_id")
def low_conf_ratio(spark, d):
    return words(spark, d).groupBy("job_id").agg(F.bround(F.sum(F.when(F.col("prob") < 0.5, 1).otherwise(0)) / F.count(F.lit(1)), 3).alias("ratio"))


@add("unstretch_words", CTE + """SELECT utt_id, word_idx, CASE WHEN e - s > 300 * greatest(length(trim(word)), 1) + 800 THEN e - (180 * greatest(length(trim(word)), 1) + 300) ELSE s END AS s, e FROM w""")
def unstretch_words(spark, d):
    n = F.greatest(F.char_length(F.trim("word")), F.lit(1))
    start = F.when(F.col("e") - F.col("s") > 300 * n + 800, F.col("e") - (180 * n + 300)).otherwise(F.col("s"))
    return words(spark, d).select("utt_id", "word_idx", start.alias("s"), "e")


@add("mark_low_confidence", CTE + f""", f AS (SELECT *, coalesce(prob, 1.0) < 0.6 AS low FROM w), g AS (
SELECT *, lag(low) OVER (PARTITION BY utt_id ORDER BY word_idx) AS before, lead(low) OVER (PARTITION BY utt_id ORDER BY word_idx) AS after FROM f)
SELECT utt_id, trim(string_agg(CASE WHEN low AND NOT coalesce(before, false) THEN '{RED}' ELSE '' END || word || CASE WHEN low AND NOT coalesce(after, false) THEN '</span>' ELSE '' END, '' ORDER BY word_idx)) AS marked FROM g GROUP BY utt_id""")
def mark_low_confidence(spark, d):
    low = F.coalesce("prob", F.lit(1.0)) < 0.6
    w = W.partitionBy("utt_id").orderBy("word_idx")
    flagged = words(spark, d).withColumn("low", low).withColumns({"before": F.coalesce(F.lag("low").over(w), F.lit(False)), "after": F.coalesce(F.lead("low").over(w), F.lit(False))})
    piece = F.concat(F.when(F.col("low") & ~F.col("before"), X.RED_OPEN).otherwise(""), "word", F.when(F.col("low") & ~F.col("after"), X.RED_CLOSE).otherwise(""))
    parts = F.array_sort(F.collect_list(F.struct("word_idx", piece.alias("p"))))
    return flagged.groupBy("utt_id").agg(F.trim(F.array_join(F.transform(parts, lambda x: x["p"]), "")).alias("marked"))


@add("drop_repeated_neighbour", "WITH RECURSIVE " + CTE[len("\nWITH ") :] + """, x AS (SELECT job_id, utt_idx, trim(coalesce(text, '')) AS t, row_number() OVER (PARTITION BY job_id ORDER BY utt_idx, utt_id) AS k FROM u),
f AS (SELECT job_id, utt_idx, k, CASE WHEN t <> '' THEN t END AS prev, CASE WHEN t = '' THEN 1 ELSE 0 END AS bad, false AS over, t <> '' AS kept FROM x WHERE k = 1
UNION ALL SELECT x.job_id, x.utt_idx, x.k, CASE WHEN x.t = '' OR x.t = f.prev THEN f.prev ELSE x.t END, CASE WHEN x.t = '' OR x.t = f.prev THEN f.bad + 1 ELSE 0 END, f.over OR f.bad >= 2, NOT (f.over OR f.bad >= 2) AND x.t <> '' AND x.t IS DISTINCT FROM f.prev FROM f JOIN x ON x.job_id = f.job_id AND x.k = f.k + 1)
SELECT job_id, utt_idx FROM f WHERE kept""")
def drop_repeated_neighbour(spark, d):
    """Texts that are not blank and not the same as the last that was kept; two bad ones in a row end the job."""
    w = W.partitionBy("job_id").orderBy("utt_idx", "utt_id")
    x = utts(spark, d).withColumn("t", F.trim(F.coalesce("text", F.lit(""))))
    # A repeated text equals the last one kept, so the last that is not blank tells as much.
    before = F.last(F.when(F.col("t") != "", F.col("t")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    bad = x.withColumn("bad", (F.col("t") == "") | F.coalesce(F.col("t") == before, F.lit(False)))
    ended = bad.withColumn("twice", F.col("bad") & F.coalesce(F.lag("bad").over(w), F.lit(False)))
    over = F.coalesce(F.max("twice").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    return ended.withColumn("over", over).where("NOT over AND NOT bad").select("job_id", "utt_idx")


@add("repeat_loop_filter")
def repeat_loop_filter(spark, d):
    """Clips in which one short stretch follows itself four times or more."""
    return table(spark, d, "clips").where(F.col("whisper").rlike(r"(\S{1,8}?)(?:\s*\1){3,}")).select("clip_id").distinct()


@add("hallucination_filter", CTE + f"""SELECT utt_id FROM (SELECT utt_id, any_value(text) AS text, avg(ln(greatest(coalesce(prob, 1), 0.001))) AS logprob, 1 - avg(coalesce(prob, 1)) AS silent, CAST(length(any_value(text)) AS DOUBLE) / count(DISTINCT word) AS compression FROM u JOIN w USING (utt_id) GROUP BY utt_id)
WHERE coalesce(trim(text), '') = '' OR (silent > 0.6 AND logprob < -1) OR compression > 4 OR (regexp_matches(trim(text), '{X.MADE_UP}') AND length(trim(text)) <= 30 AND (silent > 0.3 OR logprob < -0.7))""")
def hallucination_filter(spark, d):
    """Utterances whose text was made up rather than heard, by figures of their words and stock phrases."""
    p = F.coalesce("prob", F.lit(1.0))
    figures = words(spark, d).groupBy("utt_id").agg(F.avg(F.log(F.greatest(p, F.lit(0.001)))).alias("logprob"), (1 - F.avg(p)).alias("silent"), F.countDistinct("word").alias("n"))
    c = utts(spark, d).join(figures, "utt_id").withColumn("compression", F.char_length("text") / F.col("n"))
    return c.where(X.made_up(F.col("text"), F.col("silent"), F.col("logprob"), F.col("compression"), 4.0)).select("utt_id")


@add("option_resolution", "SELECT job_id, coalesce(CASE WHEN job_id % 3 = 0 THEN 'fast' END, nullif(meta_line, ''), 'balanced') AS mode FROM jobs")
def option_resolution(spark, d):
    return table(spark, d, "jobs").select("job_id", F.coalesce(F.when(F.col("job_id") % 3 == 0, "fast"), F.nullif("meta_line", F.lit("")), F.lit("balanced")).alias("mode"))


@add("stable_time_sort", CTE + "SELECT job_id, utt_id, row_number() OVER (PARTITION BY job_id ORDER BY s NULLS FIRST, utt_idx) AS pos FROM u")
def stable_time_sort(spark, d):
    return utts(spark, d).select("job_id", "utt_id", F.row_number().over(W.partitionBy("job_id").orderBy("s", "utt_idx")).cast("bigint").alias("pos"))


@add("asr_job_stats", CTE + """SELECT job_id, CAST(sum(CASE WHEN coalesce(trim(text), '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS dropped, CAST(sum(CASE WHEN human THEN 1 ELSE 0 END) AS BIGINT) AS human, CAST(sum(CASE WHEN proofread THEN 1 ELSE 0 END) AS BIGINT) AS proofread,
CAST(sum(CASE WHEN proofread_pending IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown, CAST(max(e) - min(s) AS BIGINT) AS span FROM u GROUP BY job_id""")
def asr_job_stats(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return utts(spark, d).groupBy("job_id").agg(n(blank).alias("dropped"), n(F.col("human")).alias("human"), n(F.col("proofread")).alias("proofread"), n(F.col("proofread_pending").isNull()).alias("unknown"), (F.max("e") - F.min("s")).alias("span"))


@add("eta", "SELECT job_id, CAST(round_even(coalesce(duration, 0) * 1000 * (100 - job_id % 100) / greatest(job_id % 100, 1), 0) AS BIGINT) AS left_ms FROM jobs")
def eta(spark, d):
    done = F.col("job_id") % 100
    return table(spark, d, "jobs").select("job_id", F.bround(F.coalesce("duration", F.lit(0.0)) * 1000 * (100 - done) / F.greatest(done, F.lit(1)), 0).cast("bigint").alias("left_ms"))
