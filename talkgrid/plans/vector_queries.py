"""Queries on voice vectors (the embeddings table: a label is a person, vec_id mod 5 a job)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.operators import vectors as O
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import table

REGISTRY = Registry()
add = REGISTRY.add

_DOT = "list_inner_product({0}, {1})"
_VP = """WITH vp AS (SELECT vec_id, 'p' || label AS person, CASE WHEN vec_id % 5 = 0 THEN 'enroll' ELSE 'job:' || (vec_id % 5) END AS tag,
list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"""
_MEAN = """, d AS (SELECT person, i, avg(v[i]) AS m FROM (SELECT person, v, unnest(range(1, 65)) AS i FROM vp) GROUP BY ALL), l AS (SELECT person, list(m ORDER BY i) AS m FROM d GROUP BY person),
mean AS (SELECT person, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS mean FROM l)"""


def _vp(spark, d):
    tag = F.when(F.col("vec_id") % 5 == 0, "enroll").otherwise(F.concat(F.lit("job:"), F.col("vec_id") % 5))
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("p"), "label").alias("person"), tag.alias("tag"), "embedding")


@add("list_voiceprints", _VP + "SELECT person, count(*) AS n FROM vp GROUP BY person")
def list_voiceprints(spark, d):
    return _vp(spark, d).groupBy("person").agg(F.count(F.lit(1)).alias("n"))


@add("forget_job", _VP + "SELECT DISTINCT person FROM vp WHERE tag = 'job:3'")
def forget_job(spark, d):
    return _vp(spark, d).where("tag = 'job:3'").select("person").distinct()


@add("delete_voiceprint", _VP + "SELECT vec_id, person FROM vp WHERE person <> 'p3'")
def delete_voiceprint(spark, d):
    v = _vp(spark, d)
    gone = v.where("person = 'p3'").select("person").distinct()
    return v.join(gone, "person", "left_anti").select("vec_id", "person")


@add("mean_unit_vector", _VP + _MEAN + "SELECT person, round(mean[1], 4) AS a, round(mean[64], 4) AS z, round(list_inner_product(mean, mean), 4) AS norm FROM mean")
def mean_unit_vector(spark, d):
    m = O.mean_unit(_vp(spark, d), ["person"])
    return m.select("person", F.round(F.col("mean")[0], 4).alias("a"), F.round(F.col("mean")[63], 4).alias("z"), F.round(O.dot(F.col("mean"), F.col("mean")), 4).alias("norm"))


_PROBE = ", probe AS (SELECT vec_id AS probe, v FROM vp WHERE vec_id % 100 = 0)"


@add("voiceprint_candidates", _VP + _PROBE + """, s AS (SELECT probe, person, round(max(list_inner_product(p.v, vp.v)), 4) AS score FROM probe p JOIN vp ON vp.vec_id <> p.probe GROUP BY ALL)
SELECT probe, person, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, person) AS r FROM s) WHERE r <= 3""")
def voiceprint_candidates(spark, d):
    v = _vp(spark, d)
    probes = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("probe"), "embedding")
    return O.best(O.similarities(probes, v.withColumn("own", F.col("vec_id"))), 3)  # a probe's own vector is no candidate


@add("identify", _VP + _MEAN + _PROBE + """, s AS (SELECT probe, person, round(list_inner_product(v, mean), 4) AS score FROM probe, mean)
SELECT probe, person, score, row_number() OVER (PARTITION BY probe ORDER BY score DESC, person) AS rank FROM s""")
def identify(spark, d):
    v = _vp(spark, d)
    probes = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("probe"), "embedding")
    return O.best(O.similarities(probes, O.mean_unit(v, ["person"]).withColumnRenamed("mean", "embedding")), None)


@add("voice_decision", _VP + _MEAN + _PROBE + "SELECT probe, person, round(list_inner_product(v, mean), 4) >= 0.5 AS known FROM probe, mean")
def voice_decision(spark, d):
    return identify(spark, d).select("probe", "person", (F.col("score") >= 0.5).alias("known"))


@add("percentile_filter", _VP + _MEAN + """, c AS (SELECT vec_id, vp.person, round(list_inner_product(v, mean), 6) AS score FROM vp JOIN mean USING (person)), q AS (SELECT person, quantile_cont(score, 0.3) AS l FROM c GROUP BY person)
SELECT vec_id, c.person FROM c JOIN q USING (person) WHERE score >= l""")
def percentile_filter(spark, d):
    v = _vp(spark, d)
    scored = v.join(O.mean_unit(v, ["person"]), "person").select("vec_id", "person", F.round(O.dot(O.unit(F.col("embedding")), F.col("mean")), 6).alias("score"))
    return O.kept_by_percentile(scored, ["person"], "score", 0.3).select("vec_id", "person")


@add("name_clusters")
def name_clusters(spark, d):
    """Clusters of jobs (every fifth vector's job and label) named by the people's means, one to one."""
    v = _vp(spark, d)
    clusters = O.mean_unit(v.withColumn("job", F.col("vec_id") % 5).withColumn("cluster", F.substring("person", 2, 9).cast("bigint")), ["job", "cluster"])
    probes = clusters.select(F.struct("job", "cluster").alias("probe"), F.col("mean").alias("embedding"))
    scores = O.similarities(probes, O.mean_unit(v, ["person"]).withColumnRenamed("mean", "embedding"))
    return O.assign_names(scores.select("probe.job", "probe.cluster", "person", "score"))


@add("save_voiceprint", _VP + """, n AS (SELECT person, tag, vec_id AS sample FROM vp WHERE tag <> 'job:2' UNION ALL SELECT person, 'job:2', vec_id + 100000 FROM vp WHERE tag = 'job:1')
SELECT person, tag, sample FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY CASE WHEN tag LIKE 'job:%' THEN 0 WHEN tag <> 'enroll' THEN 1 ELSE 2 END DESC, sample DESC) AS r FROM n) WHERE r <= 20""")
def save_voiceprint(spark, d):
    """One job's samples replaced by new ones, within a cap of twenty for each person."""
    v = _vp(spark, d).select("person", "tag", F.col("vec_id").alias("sample"))
    new = v.where("tag = 'job:1'").select("person", F.lit("job:2").alias("tag"), (F.col("sample") + 100000).alias("sample"))
    replaced = v.join(new.select("tag").distinct(), "tag", "left_anti")
    return O.capped_profile(replaced.select("person", "tag", "sample").unionByName(new), 20)


_REFINE = """, rn AS (SELECT vec_id AS run, CASE WHEN vec_id % 7 = 0 THEN 'p' || ((CAST(substr(person, 2) AS BIGINT) + 1) % 10) WHEN vec_id % 7 = 1 THEN 'x' ELSE person END AS label, (vec_id * 37) % 5000 + 1000 AS ms, v FROM vp WHERE tag <> 'enroll'),
sc AS (SELECT run, label, ms, mean.person, list_inner_product(v, mean) AS x, row_number() OVER (PARTITION BY run ORDER BY list_inner_product(v, mean) DESC, mean.person) AS r FROM rn, mean WHERE ms >= 2500),
j AS (SELECT run, label, any_value(ms) AS ms, max(CASE WHEN r = 1 THEN person END) AS best, max(CASE WHEN r = 1 THEN x END) AS x, coalesce(max(CASE WHEN person = label THEN x END), max(CASE WHEN r = 2 THEN x END), -1) AS rival FROM sc GROUP BY run, label),
p AS (SELECT run, label, best AS person, ms FROM j WHERE x >= 0.35 AND best <> label AND x - rival >= 0.1), g AS (SELECT *, count(*) OVER (PARTITION BY label, person) AS n, sum(ms) OVER (PARTITION BY label, person) AS total FROM p)"""


def _refined(spark, d, **options):
    """Vectors as runs of speech, of which every seventh has another person's label and every seventh an unknown one, judged by the people's means."""
    v = _vp(spark, d)
    means = O.mean_unit(v, ["person"]).withColumnRenamed("mean", "embedding")
    k = F.col("vec_id") % 7
    label = F.when(k == 0, F.concat(F.lit("p"), ((F.substring("person", 2, 9).cast("bigint") + 1) % 10).cast("string"))).when(k == 1, "x").otherwise(F.col("person"))
    runs = v.where("tag != 'enroll'").select(F.col("vec_id").alias("run"), label.alias("label"), ((F.col("vec_id") * 37) % 5000 + 1000).alias("ms"), "embedding")
    return O.refined_runs(runs, means, means.limit(0).select(F.col("person").alias("label"), "embedding"), threshold=0.30, **options)


@add("refine_runs", _VP + _MEAN + _REFINE + "SELECT run, person FROM g WHERE n >= 2 AND total >= 6000")
def refine_runs(spark, d):
    """Runs that get another label."""
    return _refined(spark, d)


@add("refine_proposals", _VP + _MEAN + _REFINE + "SELECT label AS cur, person AS best, count(*) AS n, CAST(sum(ms) AS BIGINT) AS ms FROM p GROUP BY label, person")
def refine_proposals(spark, d):
    """What changes of labels are proposed, how often and over how much speech."""
    return _refined(spark, d, least_runs=None).groupBy(F.col("label").alias("cur"), F.col("person").alias("best")).agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"))
