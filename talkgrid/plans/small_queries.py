"""Queries of single functions and small reports."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from talkgrid.functions import clock, text as X
from talkgrid.plans.base import CTE, RED, utts, words
from talkgrid.plans.document_queries import document_status, search_outputs
from talkgrid.plans.registry import Registry
from talkgrid.plans.transcript_queries import _CUE, _HMS, _REVIEW
from talkgrid.plans.vector_queries import _VP, _vp
from talkgrid.sources.tables import table

REGISTRY = Registry()
add = REGISTRY.add


@add("format_hms", CTE + f"SELECT utt_id, {_HMS.format('s')} AS shown FROM u WHERE s IS NOT NULL")
def format_hms(spark, d):
    return utts(spark, d).where("s IS NOT NULL").select("utt_id", clock.hms(F.col("s")).alias("shown"))


@add("format_srt_time", CTE + f"SELECT utt_id, {_CUE.format('e', ',')} AS shown FROM u WHERE e IS NOT NULL")
def format_srt_time(spark, d):
    return utts(spark, d).where("e IS NOT NULL").select("utt_id", clock.cue_time(F.col("e")).alias("shown"))


@add("fmt_dur", "SELECT job_id, CASE WHEN t // 3600 > 0 THEN (t // 3600) || '時間' || (t // 60 % 60) || '分' || (t % 60) || '秒' WHEN t // 60 > 0 THEN (t // 60) || '分' || (t % 60) || '秒' ELSE t || '秒' END AS shown FROM (SELECT job_id, CAST(floor(duration) AS BIGINT) AS t FROM jobs WHERE duration IS NOT NULL)")
def fmt_dur(spark, d):
    whole = F.floor("duration") * 1000
    return table(spark, d, "jobs").where("duration IS NOT NULL").select("job_id", clock.duration_text(whole).alias("shown"))


@add("parse_noise_seconds", CTE + """, x AS (SELECT utt_id, (s // 60000) || ':' || (s // 1000 % 60 + CASE WHEN utt_id % 3 = 0 THEN 60 ELSE 0 END) AS shown, s // 1000 AS want FROM u WHERE s >= 0) SELECT utt_id, shown, CASE WHEN utt_id % 3 = 0 THEN NULL ELSE want END AS sec FROM x""")
def parse_noise_seconds(spark, d):
    """M:S with seconds under sixty; null for any other."""
    sec = F.floor(F.col("s") / 1000)
    shown = F.concat(F.floor(sec / 60).cast("string"), F.lit(":"), (sec % 60 + F.when(F.col("utt_id") % 3 == 0, 60).otherwise(0)).cast("string"))
    x = utts(spark, d).where("s >= 0").select("utt_id", shown.alias("shown"))
    parts = F.split("shown", ":")
    ok = F.col("shown").rlike(r"^\d+:[0-5]?\d$")
    return x.select("utt_id", "shown", F.when(ok, parts[0].try_cast("bigint") * 60 + parts[1].try_cast("bigint")).alias("sec"))


@add("render_html", CTE + f"""SELECT job_id, count(*) AS shown, CAST(sum(CASE WHEN {_REVIEW} THEN 1 ELSE 0 END) AS BIGINT) AS review, CAST(sum((length(coalesce(marked, '')) - length(replace(coalesce(marked, ''), '{RED}', ''))) // {len(RED)}) AS BIGINT) AS red FROM u WHERE trim(text) <> '' GROUP BY job_id""")
def render_html(spark, d):
    """What the page of a job counts: rows shown, rows to review, red stretches."""
    u = utts(spark, d).where("trim(text) != ''")
    review = F.sum(F.when(X.needs_review(F.col("marked"), F.col("proofread_pending")), 1).otherwise(0))
    return u.groupBy("job_id").agg(F.count(F.lit(1)).alias("shown"), review.alias("review"), F.sum(X.occurrences(F.col("marked"), X.RED_OPEN)).alias("red"))


@add("load_voiceprints", _VP + """, t AS (SELECT person, count(*) AS n, count(CASE WHEN NOT (person = 'p3' AND vec_id % 2 = 0) THEN tag END) AS tags FROM vp GROUP BY person) SELECT vec_id, vp.person, CASE WHEN n = tags THEN tag ELSE 'legacy' END AS tag FROM vp JOIN t USING (person)""")
def load_voiceprints(spark, d):
    """Samples with their tags; all of a person are legacy if the tags are fewer than the samples (p3 lacks some)."""
    v = _vp(spark, d).withColumn("tag", F.when(~((F.col("person") == "p3") & (F.col("vec_id") % 2 == 0)), F.col("tag")))
    w = W.partitionBy("person")
    whole = F.count(F.lit(1)).over(w) == F.count("tag").over(w)
    return v.select("vec_id", "person", F.when(whole, F.col("tag")).otherwise("legacy").alias("tag"))


@add("search_cap", "SELECT least(count(*), 200) AS hits FROM (SELECT unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line FROM documents WHERE contains(text, '管理') AND contains(text, '確認')) WHERE contains(line, '管理') OR contains(line, '確認')")
def search_cap(spark, d):
    return search_outputs(spark, d).agg(F.count(F.lit(1)).alias("hits"))


@add("topk_per_group", CTE + "SELECT job_id, utt_id, r AS rank FROM (SELECT job_id, utt_id, row_number() OVER (PARTITION BY job_id ORDER BY length(text) DESC, utt_id) AS r FROM u WHERE text IS NOT NULL) WHERE r <= 3")
def topk_per_group(spark, d):
    rank = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc(F.char_length("text")), "utt_id")).cast("bigint")
    return utts(spark, d).where("text IS NOT NULL").withColumn("rank", rank).where("rank <= 3").select("job_id", "utt_id", "rank")


_EXAMPLES = [("予算の配分", "予算配分"), ("次の会議", "次回会議"), ("budget split", "budget")]


@add("context_hints", CTE + """, x(before, after) AS (VALUES ('予算の配分', '予算配分'), ('次の会議', '次回会議'), ('budget split', 'budget')), b AS (SELECT utt_id, text, before, after, len(list_intersect(list_distinct(list_transform(range(1, length(before)), lambda i: substr(before, i, 2))), list_distinct(list_transform(range(1, greatest(length(text), 1)), lambda i: substr(text, i, 2))))) + CASE WHEN contains(text, before) THEN 20 ELSE 0 END AS score FROM u, x WHERE text IS NOT NULL)
SELECT utt_id, after, score FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY score DESC, before) AS r FROM b WHERE score > 0) WHERE r <= 2""")
def context_hints(spark, d):
    """The two kept corrections whose pairs of characters are most like each text's; one held whole counts twenty more."""
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))))
    own = utts(spark, d).where("text IS NOT NULL").select("utt_id", "text", F.when(F.char_length("text") > 1, pairs(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("have"))
    kept = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(a).alias("after")) for b, a in _EXAMPLES])
    x = own.withColumn("k", F.explode(kept))
    score = F.size(F.array_intersect(pairs(F.col("k.before")), F.col("have"))) + F.when(F.contains("text", F.col("k.before")), 20).otherwise(0)
    ranked = x.withColumn("score", score).where("score > 0").withColumn("r", F.row_number().over(W.partitionBy("utt_id").orderBy(F.desc("score"), "k.before")))
    return ranked.where("r <= 2").select("utt_id", F.col("k.after").alias("after"), "score")


@add("inside_word", CTE + """, x AS (SELECT utt_id, word_idx, right(trim(word), 1) || left(trim(lead(word) OVER (PARTITION BY utt_id ORDER BY word_idx)), 1) AS pair FROM w) SELECT utt_id, word_idx, regexp_matches(pair, '^.[ぁぃぅぇぉっゃゅょァィゥェォッャュョー]$|^[ァ-ヺー][ァ-ヺー]$|^[0-9][0-9年月日時分秒円％件名回個]$') AS inside FROM x WHERE pair IS NOT NULL""")
def inside_word(spark, d):
    nxt = F.lead("word").over(W.partitionBy("utt_id").orderBy("word_idx"))
    pair = F.concat(F.right(F.trim("word"), F.lit(1)), F.left(F.trim(nxt), F.lit(1)))
    hit = F.col("pair").rlike("^.[ぁぃぅぇぉっゃゅょァィゥェォッャュョー]$|^[ァ-ヺー][ァ-ヺー]$|^[0-9][0-9年月日時分秒円％件名回個]$")
    return words(spark, d).select("utt_id", "word_idx", pair.alias("pair")).where("pair IS NOT NULL").select("utt_id", "word_idx", hit.alias("inside"))


@add("document_hint", """WITH k AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS kept FROM documents WHERE doc_id % 5 <> 0), s AS (SELECT kind, CASE WHEN text IS NULL THEN 3 WHEN kept IS NULL THEN 1 WHEN kept = sha256(text) THEN 0 ELSE 2 END AS urgency FROM documents LEFT JOIN k USING (doc_id)) SELECT kind, CAST(max(urgency) AS BIGINT) AS urgency FROM s GROUP BY kind""")
def document_hint(spark, d):
    """The most urgent state of each kind of document, for the next step."""
    s = F.col("status")
    urgency = F.when(s == "missing", 3).when(s == "unknown", 1).when(s == "current", 0).otherwise(2).cast("bigint")
    return document_status(spark, d).join(table(spark, d, "documents").select("doc_id", "kind"), "doc_id").groupBy("kind").agg(F.max(urgency).alias("urgency"))
