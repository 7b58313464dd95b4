"""Queries on review, correction, checkpoints, and operators behind model interfaces."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from talkgrid.functions import clock, text as X
from talkgrid.operators import checkpoints as C, cues, markdown as M, models, sequence, vectors
from talkgrid.operators.documents import unambiguous_names
from talkgrid.plans.base import CTE, utts, words
from talkgrid.plans.registry import Registry
from talkgrid.plans.sequence_queries import _SPOKEN, _spoken
from talkgrid.plans.vector_queries import _MEAN, _VP
from talkgrid.sources.tables import table

REGISTRY = Registry()
add = REGISTRY.add


@add("placeholder_terms", f"SELECT DISTINCT speaker AS term FROM utterances WHERE trim(speaker) <> '' AND NOT regexp_matches(trim(speaker), '{X.UNNAMED}') AND NOT regexp_matches(speaker, '(質問者|参加者)[0-9A-Z]*$')")
def placeholder_terms(spark, d):
    s = F.col("speaker")
    return table(spark, d, "utterances").where(X.is_named(s) & ~s.rlike("(質問者|参加者)[0-9A-Z]*$")).select(s.alias("term")).distinct()


_CHECK = CTE + """, sg AS (SELECT job_id, list({'s': s, 'e': e} ORDER BY s, e, utt_id) AS segments, max(e) AS reached FROM u WHERE s IS NOT NULL AND e >= s GROUP BY job_id), cp AS (SELECT DISTINCT job_id, clip_id, CAST(round_even(start * 1000, 0) AS BIGINT) AS s, CAST(round_even("end" * 1000, 0) AS BIGINT) AS e FROM clips WHERE reason IS NOT NULL),
pn AS (SELECT job_id, list({'s': s, 'e': e} ORDER BY s, e, clip_id) AS spans FROM cp WHERE s IS NOT NULL AND e IS NOT NULL GROUP BY job_id), c AS (SELECT job_id, phase, total, CASE WHEN phase = 'main' THEN reached WHEN phase = 'prepared' THEN 0 ELSE total END AS done, CASE WHEN phase = 'prepared' AND job_id % 2 = 0 THEN [] ELSE segments END AS segments,
CASE WHEN phase = 'recovery' THEN spans END AS spans, job_id % 3 AS next_index FROM (SELECT job_id, ['prepared', 'main', 'main_complete', 'recovery', 'lost'][job_id % 5 + 1] AS phase, CAST(round_even(coalesce(duration, 0) * 1000, 0) AS BIGINT) AS total FROM jobs) JOIN sg USING (job_id) LEFT JOIN pn USING (job_id))
"""


def _checkpoints(spark, d):
    """Checkpoints as they would stand for each job: its utterances as segments, its marked clips as what is left to fill in."""
    spans = lambda *key: F.transform(F.array_sort(F.collect_list(F.struct("s", "e", *key))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    segments = utts(spark, d).where("s IS NOT NULL AND e >= s").groupBy("job_id").agg(spans("utt_id").alias("segments"), F.max("e").alias("reached"))
    clips = table(spark, d, "clips").where("reason IS NOT NULL").select("job_id", "clip_id", clock.ms_of(F.col("start")).alias("s"), clock.ms_of(F.col("end")).alias("e")).distinct().where("s IS NOT NULL AND e IS NOT NULL")
    plan = clips.groupBy("job_id").agg(spans("clip_id").alias("spans"))
    phase = F.element_at(F.array(*map(F.lit, ("prepared", "main", "main_complete", "recovery", "lost"))), (F.col("job_id") % 5 + 1).cast("int"))
    c = table(spark, d, "jobs").select("job_id", phase.alias("phase"), F.bround(F.coalesce("duration", F.lit(0.0)) * 1000).cast("bigint").alias("total")).join(segments, "job_id").join(plan, "job_id", "left")
    p = F.col("phase")
    done = F.when(p == "main", F.col("reached")).when(p == "prepared", F.lit(0)).otherwise(F.col("total"))
    return c.select("job_id", "phase", "total", done.alias("done"), F.when((p == "prepared") & (F.col("job_id") % 2 == 0), F.slice("segments", 1, 0)).otherwise(F.col("segments")).alias("segments"), F.when(p == "recovery", F.col("spans")).alias("spans"), (F.col("job_id") % 3).alias("next_index"))


_CP = ("phase", "total", "done", "segments", "spans", "next_index")


@add("validate_checkpoint", _CHECK + """SELECT job_id, coalesce(phase <> 'lost' AND total > 0 AND done BETWEEN 0 AND total AND (phase IN ('prepared', 'main') OR done = total) AND (phase <> 'prepared' OR len(segments) = 0) AND len(list_filter(segments, lambda x: NOT (x.s >= 0 AND x.s <= x.e AND x.e <= total + 1000))) = 0
AND (phase NOT IN ('main', 'prepared') OR len(list_filter(segments, lambda x: x.e > done + 1000)) = 0) AND (spans IS NULL OR (next_index BETWEEN 0 AND len(spans) AND len(list_filter(spans, lambda x: NOT (x.s >= 0 AND x.s < x.e AND x.e <= total))) = 0)), false) AS valid FROM c""")
def validate_checkpoint(spark, d):
    return _checkpoints(spark, d).select("job_id", C.valid(*map(F.col, _CP)).alias("valid"))


@add("checkpoint_notice", _CHECK + f"""SELECT job_id, '途中保存・全編未完了 — ' || CASE phase {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.PHASES.items())} ELSE '音声認識' END || ' / 処理位置 ' || printf('%02d:%02d:%02d', done // 3600000, done // 60000 % 60, done // 1000 % 60) || ' / 音声全体 ' || printf('%02d:%02d:%02d', total // 3600000, total // 60000 % 60, total // 1000 % 60) AS notice FROM c""")
def checkpoint_notice(spark, d):
    return _checkpoints(spark, d).select("job_id", C.notice(F.col("phase"), F.col("total"), F.col("done")).alias("notice"))


@add("resume_from_checkpoint", _CHECK + "SELECT job_id, CASE phase WHEN 'recovery' THEN coalesce(spans[next_index + 1].s, total) WHEN 'main_complete' THEN total WHEN 'postprocess' THEN total WHEN 'main' THEN done ELSE 0 END AS resume_ms FROM c WHERE phase <> 'lost'")
def resume_from_checkpoint(spark, d):
    c = _checkpoints(spark, d).where("phase != 'lost'")
    return c.select("job_id", C.resume_at(F.col("phase"), F.col("total"), F.col("done"), F.col("spans"), F.col("next_index")).cast("bigint").alias("resume_ms"))


@add("assign_words_windows", CTE + """, c AS (SELECT DISTINCT job_id, id AS name, CAST(round_even((start + "end") * 500, 0) AS BIGINT) AS mid FROM clips), p AS (SELECT job_id, utt_id, (s + e) // 2 AS t FROM u WHERE e > s)
SELECT job_id, utt_id AS id, name AS speaker FROM (SELECT p.job_id, utt_id, name, row_number() OVER (PARTITION BY utt_id ORDER BY abs(t - mid), mid, CASE WHEN mid <= t THEN NULL ELSE name END, name DESC) AS r FROM p JOIN c ON c.job_id = p.job_id) WHERE r = 1""")
def assign_words_windows(spark, d):
    """Each utterance's middle to the clip of nearest centre; ties to the earlier."""
    mid = F.bround((F.col("start") + F.col("end")) * 500).cast("bigint")
    turns = table(spark, d, "clips").select("job_id", mid.alias("s"), mid.alias("e"), F.col("id").alias("speaker")).distinct()
    points = utts(spark, d).where("e > s").select("job_id", F.col("utt_id").alias("id"), F.floor((F.col("s") + F.col("e")) / 2).alias("t"))
    return sequence.nearest_turn(points, turns, ["job_id"]).where("speaker IS NOT NULL")


@add("words_inside_gap", CTE + """, g AS (SELECT DISTINCT job_id, clip_id, CAST(round_even(start * 1000, 0) AS BIGINT) + 1000 AS a, CAST(round_even("end" * 1000, 0) AS BIGINT) - 1000 AS b FROM clips) SELECT g.clip_id, w.utt_id, w.word_idx FROM g JOIN w ON w.job_id = g.job_id AND (w.s + w.e) // 2 BETWEEN g.a AND g.b WHERE w.e > w.s""")
def words_inside_gap(spark, d):
    ms = lambda c: F.bround(F.col(c) * 1000).cast("bigint")
    gaps = table(spark, d, "clips").select("job_id", "clip_id", (ms("start") + 1000).alias("s"), (ms("end") - 999).alias("e")).dropDuplicates(["clip_id"])
    points = words(spark, d).where("e > s").select("job_id", "utt_id", "word_idx", F.floor((F.col("s") + F.col("e")) / 2).alias("t"))
    return sequence.in_windows(points, gaps, ["job_id"], 30_000).select("clip_id", "utt_id", "word_idx")


_LABEL = "CASE WHEN word_idx % 6 = 0 THEN 'b' ELSE 'a' END"


@add("segment_mode_label", _SPOKEN + f", k AS (SELECT utt_id, {_LABEL} AS label, count(*) AS n FROM sp GROUP BY ALL), t AS (SELECT utt_id, count(*) AS total, max(e) - min(s) AS dur FROM sp GROUP BY utt_id) SELECT utt_id, label FROM k JOIN t USING (utt_id) WHERE n >= 0.8 * total AND dur >= 3000")
def segment_mode_label(spark, d):
    w = W.partitionBy("utt_id")
    k = _spoken(spark, d).groupBy("utt_id", F.when(F.col("word_idx") % 6 == 0, "b").otherwise("a").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"), F.max("e").alias("e"))
    k = k.withColumns({"total": F.sum("n").over(w), "dur": F.max("e").over(w) - F.min("s").over(w)})
    return k.where("n >= 0.8 * total AND dur >= 3000").select("utt_id", "label")


_LEVEL = """WITH vp AS (SELECT vec_id, label, embedding AS v, sqrt(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE) * x)) / 8) AS rms FROM embeddings)"""


def _levels(spark, d):
    """Vectors as clips of their label's speaker; their first eight numbers stand for the sound."""
    square = F.aggregate(F.slice("embedding", 1, 8), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", "embedding", F.sqrt(square / 8).alias("rms"))


@add("loudness_filter", _LEVEL + """, m AS (SELECT 0.5 * quantile_cont(rms, 0.5) AS least FROM vp), k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM vp, m WHERE rms >= least),
p AS (SELECT label, n, CASE WHEN n > 20 THEN j * n // 20 ELSE j END AS i FROM (SELECT DISTINCT label, n FROM k), range(20) t(j)) SELECT k.vec_id, k.label FROM k JOIN (SELECT DISTINCT label, i FROM p) p ON p.label = k.label AND p.i = k.i WHERE n >= 3""")
def loudness_filter(spark, d):
    """Clips of half the median loudness or more, of speakers with three or more; twenty of each, evenly apart (a sampling operator)."""
    return vectors.loud_enough(_levels(spark, d), "label", "vec_id", most=20).select("vec_id", "label")


@add("enroll_filter", _LEVEL + """, q AS (SELECT label, 0.3 * quantile_cont(rms, 0.9) AS least FROM vp GROUP BY label), c AS (SELECT vp.* FROM vp JOIN q USING (label) WHERE rms >= least), d AS (SELECT label, i, avg(CAST(v[i] AS DOUBLE)) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM c) GROUP BY ALL), l AS (SELECT label, list(m ORDER BY i) AS m FROM d GROUP BY label),
z AS (SELECT vec_id, c.label, round(list_inner_product(list_transform(v, lambda x: CAST(x AS DOUBLE)), m) / sqrt(list_inner_product(m, m)), 6) AS score FROM c JOIN l USING (label)), w AS (SELECT label, quantile_cont(score, 0.2) AS least, count(*) AS n FROM z GROUP BY label) SELECT vec_id, z.label FROM z JOIN w USING (label) WHERE n < 4 OR score >= least""")
def enroll_filter(spark, d):
    """Windows that are loud enough, and of four or more those that are like the rest."""
    return vectors.enrolled(_levels(spark, d), "label").select("vec_id", "label")


@add("name_set_compare", CTE + """, n AS (SELECT utt_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')) AS a, list_distinct(regexp_extract_all(memo, '[A-Z][a-z]+')) AS b FROM u WHERE text IS NOT NULL AND memo IS NOT NULL)
SELECT utt_id, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS within, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AND len(a) = len(b) AS equal FROM n""")
def name_set_compare(spark, d):
    """Whether the names of a note are among those of its text, and whether the two sets are equal."""
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Z][a-z]+"), F.lit(0)))
    n = utts(spark, d).where("text IS NOT NULL AND memo IS NOT NULL").select("utt_id", names("text").alias("a"), names("memo").alias("b"))
    within = F.size(F.array_except("b", "a")) == 0
    return n.select("utt_id", within.alias("within"), (within & (F.size("a") == F.size("b"))).alias("equal"))


@add("verify_summary", CTE + """, r AS (SELECT job_id, CAST(sum(CASE WHEN human THEN 1 ELSE 0 END) AS BIGINT) AS checked, CAST(sum(CASE WHEN proofread THEN 1 ELSE 0 END) AS BIGINT) AS fixed, CAST(sum(CASE WHEN proofread_pending THEN 1 ELSE 0 END) AS BIGINT) AS pending FROM u GROUP BY job_id)
SELECT job_id, CASE WHEN checked = 0 AND pending > 0 THEN pending || ' to check' WHEN checked = 0 THEN 'nothing to check' ELSE checked || ' checked' || CASE WHEN fixed > 0 THEN ', ' || fixed || ' fixed' ELSE '' END || CASE WHEN pending > 0 THEN ', ' || pending || ' pending' ELSE '' END END AS message FROM r""")
def verify_summary(spark, d):
    n = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    r = utts(spark, d).groupBy("job_id").agg(n("human").alias("checked"), n("proofread").alias("fixed"), n("proofread_pending").alias("pending"))
    c, f, p = F.col("checked"), F.col("fixed"), F.col("pending")
    some = F.concat(c, F.lit(" checked"), F.when(f > 0, F.concat(F.lit(", "), f, F.lit(" fixed"))).otherwise(""), F.when(p > 0, F.concat(F.lit(", "), p, F.lit(" pending"))).otherwise(""))
    return r.select("job_id", F.when((c == 0) & (p > 0), F.concat(p, F.lit(" to check"))).when(c == 0, "nothing to check").otherwise(some).alias("message"))


@add("verify_resolve", CTE + """, v AS (SELECT job_id, utt_idx // 2 AS n, CASE WHEN human THEN 'ok' WHEN human = false THEN 'fix' END AS verdict FROM u), r AS (SELECT job_id, n, count(verdict) AS k, min(verdict) AS verdict FROM v GROUP BY ALL)
SELECT job_id, n, CASE WHEN k = 1 THEN verdict ELSE 'review' END AS outcome FROM r""")
def verify_resolve(spark, d):
    """The verdict on each item; none, or two on one item, leave it for review."""
    v = F.when(F.col("human"), "ok").when(~F.col("human"), "fix")
    r = utts(spark, d).select("job_id", F.floor(F.col("utt_idx") / 2).alias("n"), v.alias("verdict")).groupBy("job_id", "n").agg(F.count("verdict").alias("k"), F.min("verdict").alias("verdict"))
    return r.select("job_id", "n", F.when(F.col("k") == 1, F.col("verdict")).otherwise("review").alias("outcome"))


@add("make_snippet", """WITH p AS (SELECT doc_id, replace(regexp_replace(text, '<span style="color:red">(.*?)</span>', '\\1', 'gs'), '**', '') AS p FROM documents WHERE contains(text, '確認')), g AS (SELECT doc_id, p, instr(p, '確認') AS pos FROM p)
SELECT doc_id, CASE WHEN pos - 31 > 0 THEN '…' ELSE '' END || substr(p, greatest(pos - 31, 0) + 1, least(pos + 31, length(p)) - greatest(pos - 31, 0)) || CASE WHEN pos + 31 < length(p) THEN '…' ELSE '' END AS snippet FROM g WHERE pos > 0""")
def make_snippet(spark, d):
    docs = table(spark, d, "documents").where(F.contains("text", F.lit("確認")))
    return docs.where(F.contains(F.replace(X.strip_marks(F.col("text")), F.lit("**"), F.lit("")), F.lit("確認"))).select("doc_id", X.snippet(F.col("text"), ["確認"]).alias("snippet"))


@add("render_md", CTE + """SELECT job_id, '# ' || job_id || chr(10) || chr(10) || string_agg('- **' || coalesce(speaker, '') || '** ' || coalesce(marked, text, ''), chr(10) ORDER BY s, utt_idx) || chr(10) AS md FROM u GROUP BY job_id""")
def render_md(spark, d):
    from talkgrid.operators.transcript import joined_by_job

    u = utts(spark, d)
    line = F.concat(F.lit("- **"), F.coalesce("speaker", F.lit("")), F.lit("** "), F.coalesce("marked", "text", F.lit("")))
    return joined_by_job(u, ["s", "utt_idx"], line, "\n", "body").select("job_id", F.concat(F.lit("# "), F.col("job_id").cast("string"), F.lit("\n\n"), "body", F.lit("\n")).alias("md"))


def _texts(spark, d):
    return utts(spark, d).where("text IS NOT NULL").select("utt_id", "text", "marked")


@add("fix_ichi")
def fix_ichi(spark, d):
    return _texts(spark, d).select("utt_id", M.fixed_ichi(F.col("text")).alias("text"))


def _names(spark, d):
    """The spellings that belong to one display name, of two characters or more."""
    return unambiguous_names(table(spark, d, "people")).where("length(alias) >= 2")


_KNOWN = """, al AS (SELECT alias, any_value(display) AS display FROM (SELECT display_name AS display, unnest(list_append(coalesce(aliases, []), display_name)) AS alias FROM people) WHERE trim(alias) <> '' AND length(alias) >= 2 GROUP BY alias HAVING count(DISTINCT display) = 1),
kn AS (SELECT alias, any_value(display) AS display FROM (SELECT alias, display FROM al WHERE alias <> display UNION SELECT DISTINCT display, display FROM al) GROUP BY alias),
"""
#: Names found at places of texts (tx: id, t), the longest of a place, then those that no earlier one reaches into (rows of ok).
_FOUND = """pl AS (SELECT id, t, unnest(range(1, length(t) + 1)) AS pos FROM tx), ca AS (SELECT id, pos, alias, display, length(alias) AS n FROM pl JOIN kn ON starts_with(substr(t, pos), alias) AND NOT (contains(regexp_replace(substr(t, 1, pos - 1), '<[^>]*>', '', 'g'), '<') AND contains(substr(t, pos), '>'))),
be AS (SELECT DISTINCT ON (id, pos) * FROM ca ORDER BY id, pos, n DESC), nu AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM be),
ok AS (SELECT id, k, pos, alias, display, pos + n AS nxt, true AS kept FROM nu WHERE k = 1 UNION ALL SELECT nu.id, nu.k, nu.pos, nu.alias, nu.display, CASE WHEN nu.pos >= ok.nxt THEN nu.pos + nu.n ELSE ok.nxt END, nu.pos >= ok.nxt FROM ok JOIN nu ON nu.id = ok.id AND nu.k = ok.k + 1)
"""
_REC = "WITH RECURSIVE " + CTE[len("\nWITH ") :]


@add("apply_aliases")
def apply_aliases(spark, d):
    return M.aliases_applied(_texts(spark, d), "utt_id", ["text", "marked"], _names(spark, d))


@add("names_in", _REC + _KNOWN + "tx AS (SELECT utt_id AS id, text AS t FROM u WHERE text IS NOT NULL), " + _FOUND + "SELECT DISTINCT id AS utt_id, display AS name FROM ok WHERE kept")
def names_in(spark, d):
    return M.names_found(_texts(spark, d), "utt_id", "text", _names(spark, d))


_QUAL = " OR ".join(f"contains(old, '{q}') <> contains(new, '{q}')" for q in M.QUALIFIERS)
_NUMS = "list_sort(regexp_extract_all(translate({}, '０１２３４５６７８９．，：／', '0123456789.,:/'), '[0-9]+(?:[.,:/][0-9]+)*'))"


@add("changes_facts", _REC + _KNOWN + """pr AS (SELECT utt_id, text AS old, regexp_replace(marked, '<span style="color:red">(.*?)</span>', '\\1', 'g') AS new FROM u WHERE text IS NOT NULL AND marked IS NOT NULL),
tx AS (SELECT utt_id * 2 AS id, old AS t FROM pr UNION ALL SELECT utt_id * 2 + 1, new FROM pr), """ + _FOUND + f""", sd AS (SELECT DISTINCT id // 2 AS utt_id, id % 2 AS side, display FROM ok WHERE kept), mv AS (SELECT DISTINCT utt_id FROM (SELECT utt_id FROM sd GROUP BY utt_id, display HAVING count(*) = 1))
SELECT utt_id, {_NUMS.format('old')} <> {_NUMS.format('new')} OR utt_id IN (SELECT utt_id FROM mv) OR {_QUAL} AS changed FROM pr""")
def changes_facts(spark, d):
    """Whether the marked text, as a correction, changes facts of the text."""
    rows = utts(spark, d).where("text IS NOT NULL AND marked IS NOT NULL").select("utt_id", "text", X.strip_marks(F.col("marked")).alias("new"))
    return M.facts_changed(rows, "utt_id", "text", "new", _names(spark, d))


@add("parse_markdown_blocks", """WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
c AS (SELECT *, contains(line, '|') AND bare <> '' AS pipe, list_transform(string_split(regexp_replace(replace(bare, '\\|', chr(1)), '^\\|+|\\|+$', '', 'g'), '|'), lambda q: replace(regexp_replace(q, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'), chr(1), '|')) AS cells FROM (SELECT *, regexp_replace(line, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS bare FROM l)),
r AS (SELECT *, pipe AND len(list_filter(cells, lambda q: NOT regexp_matches(q, '^:?-{3,}:?$'))) = 0 AS rule FROM c),
st AS (SELECT *, pipe AND coalesce(lead(rule) OVER w AND lead(len(cells)) OVER w = len(cells), false) AS starts, sum(CASE WHEN pipe THEN 0 ELSE 1 END) OVER w AS island FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
f AS (SELECT *, CASE WHEN pipe THEN min(CASE WHEN starts THEN line_no END) OVER (PARTITION BY doc_id, island, pipe) END AS first FROM st),
t AS (SELECT *, coalesce(line_no >= first, false) AS tab, regexp_replace(line, '[\\s\\x0B]+$', '') AS z FROM f),
k AS (SELECT doc_id, CASE WHEN tab THEN first ELSE line_no END AS pos, line_no, cells, tab, CASE WHEN tab THEN 'table' WHEN z = '' THEN 'blank' WHEN regexp_matches(z, '^#{1,6}\\s+') THEN 'h' || least(3, length(regexp_extract(z, '^#+'))) WHEN regexp_matches(z, '^\\s*-\\s*\\[[ xX]?\\]') THEN 'check' WHEN regexp_matches(z, '^\\s*[-*]\\s+') THEN 'bullet' ELSE 'text' END AS kind, z FROM t WHERE NOT tab OR line_no <> first + 1),
g AS (SELECT doc_id, pos, any_value(kind) AS kind, any_value(z) AS z, max(len(cells)) AS width, list(cells ORDER BY line_no) AS rows FROM k GROUP BY doc_id, pos)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS no, kind, CASE kind WHEN 'table' THEN NULL WHEN 'check' THEN regexp_replace(z, '^\\s*-\\s*\\[[ xX]?\\]\\s*', '') WHEN 'bullet' THEN regexp_replace(z, '^\\s*[-*]\\s+', '') WHEN 'text' THEN z WHEN 'blank' THEN '' ELSE regexp_replace(z, '^#{1,6}\\s+', '') END AS content,
CASE WHEN kind = 'table' THEN list_transform(rows, lambda q: list_resize(q, width, '')) END AS rows FROM g""")
def parse_markdown_blocks(spark, d):
    from talkgrid.operators.documents import lines

    return M.blocks(lines(table(spark, d, "documents")))


@add("tidy_minutes", """WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?s)<think>.*?</think>[\\s\\x0B]*', '', 'g'), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS p FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, CASE WHEN regexp_matches(p, '(?s)^```[^\\n]*\\n.*\\n\\s*```$') THEN regexp_replace(regexp_extract(p, '(?s)^```[^\\n]*\\n(.*)\\n\\s*```$', 1), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') ELSE p END AS p FROM p),
l AS (SELECT doc_id, list_transform(string_split(regexp_replace(p, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: CASE WHEN regexp_matches(regexp_replace(x, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'), '^【[^】]+】$') THEN chr(10) || regexp_replace(x, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') || chr(10) WHEN regexp_matches(regexp_replace(x, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g'), '^[^\\s\\x0B#|\\-*>][^:：]{0,12}[:：]\\s*[^\\s\\x0B]') THEN regexp_replace(x, '[\\s\\x0B]+$', '') || '  ' ELSE x END) AS x FROM q)
SELECT doc_id, regexp_replace(regexp_replace(array_to_string(x, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') || chr(10) AS text FROM l""")
def tidy_minutes(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", M.tidied(M.unfenced(F.col("text"))).alias("text"))


@add("append_mark", """WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM documents WHERE text IS NOT NULL))
SELECT doc_id, line_no, regexp_replace(substr(line, 3), '[\\s\\x0B]+$', '') || '？' || CASE WHEN suffix(line, '  ') THEN '  ' ELSE '' END AS line FROM l WHERE starts_with(line, '- ')""")
def append_mark(spark, d):
    """Bullets with a mark at their end that keep the line breaks of the old line."""
    from talkgrid.operators.documents import lines

    body = F.substring("line", 3, 1 << 30)
    return lines(table(spark, d, "documents")).where(F.startswith("line", F.lit("- "))).select("doc_id", "line_no", M.kept_break(F.col("line"), M.appended_mark(F.lit(""), body, "？")).alias("line"))


def _labelled(spark, d):
    return _spoken(spark, d).withColumn("label", F.col("speaker"))


@add("glue_word_heads")
def glue_word_heads(spark, d):
    made = cues.grouped_words(_labelled(spark, d)).select("utt_id", F.explode(M.glued(F.col("words"))).alias("w"))
    return made.select("utt_id", "w.word_idx", "w.s", "w.e", "w.word")


@add("repair_punctuation")
def repair_punctuation(spark, d):
    fixed = M.repaired(_labelled(spark, d)).groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("ws"))
    return fixed.select("utt_id", F.array_join(F.col("ws")["word"], "").alias("text"))


_BUILD = """o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY s, utt_id, word_idx) AS rn FROM sw), f AS (
SELECT job_id, rn, s, e, word, speaker, s AS first_s, 0 AS no FROM o WHERE rn = 1 UNION ALL SELECT job_id, rn, s, e, word, speaker, CASE WHEN m THEN s ELSE first_s END, CASE WHEN m THEN no + 1 ELSE no END
FROM (SELECT o.*, f.first_s, f.no, o.speaker <> f.speaker OR o.s - f.e > 8000 OR (o.s - f.first_s > 45000 AND trim(f.word) <> '' AND contains('。？！?!', right(trim(f.word), 1))) AS m FROM f JOIN o ON o.job_id = f.job_id AND o.rn = f.rn + 1)),
built AS (SELECT job_id, CAST(no AS BIGINT) AS no, min(speaker) AS speaker, arg_min(s, rn) AS s, arg_max(e, rn) AS e, count(*) AS n FROM f GROUP BY job_id, no)
"""
_RECSP = "WITH RECURSIVE " + _SPOKEN[len("\nWITH ") :]


@add("reflow", _RECSP + """, nx AS (SELECT *, lead(word) OVER w1 AS nw, lead(s) OVER w1 AS ns, lead(speaker) OVER w1 AS nl, substr(word, 1, length(word) - 1) AS body FROM sp WINDOW w1 AS (PARTITION BY utt_id ORDER BY word_idx)),
mk AS (SELECT *, trim(body, ' ') AS b, trim(nw, ' ') AS h, regexp_matches(word, '[、。]$') AND nw IS NOT NULL AND trim(body, ' ') <> '' AS mark FROM nx),
sw AS (SELECT job_id, utt_id, word_idx, s, e, speaker, CASE WHEN mark AND (regexp_matches(h, '^[ぁぃぅぇぉっゃゅょァィゥェォッャュョー]') OR (regexp_matches(b, '[ァ-ヺー]$') AND regexp_matches(h, '^[ァ-ヺー]')) OR (regexp_matches(b, '[0-9０-９]$') AND regexp_matches(h, '^[0-9年月日時分秒円％件名回個]'))) AND NOT regexp_matches(b, '[0-9]$') THEN body
WHEN mark AND right(word, 1) = '。' AND ns - e < 800 AND nl = speaker AND regexp_matches(body, '(けど|ので|から|が|て)$') THEN body || '、' ELSE word END AS word FROM mk), """ + _BUILD + """SELECT * FROM built UNION ALL SELECT job_id, utt_idx + 1000000, speaker, s, e, 0 FROM u WHERE utt_id NOT IN (SELECT utt_id FROM sp)""")
def reflow(spark, d):
    """Utterances built anew from repaired words; utterances without words stay as they are."""
    fixed = M.repaired(_labelled(spark, d)).withColumnRenamed("label", "speaker")
    u = utts(spark, d)
    built = sequence.built_utterances(fixed.join(u.select("utt_id", "job_id"), "utt_id"))
    rest = u.join(fixed.select("utt_id").distinct(), "utt_id", "left_anti").select("job_id", (F.col("utt_idx") + 1_000_000).cast("bigint").alias("no"), "speaker", "s", "e", F.lit(0).cast("bigint").alias("n"))
    return built.unionByName(rest)


@add("relabel_preserving_edits", _RECSP + """, jn AS (SELECT utt_id, string_agg(word, '' ORDER BY word_idx) AS joined FROM w GROUP BY utt_id), sp2 AS (SELECT job_id, utt_id, word_idx, s, e, word, CASE WHEN word_idx % 6 < 2 THEN 'b' ELSE 'a' END AS speaker FROM sp),
ed AS (SELECT u.* FROM u LEFT JOIN jn USING (utt_id) WHERE coalesce(human, false) OR coalesce(proofread, false) OR regexp_replace(coalesce(text, ''), '[\\s\\x0B　]+$', '') <> regexp_replace(joined, '[\\s\\x0B　]+$', '') OR utt_id NOT IN (SELECT utt_id FROM sp)),
sw AS (SELECT * FROM sp2 WHERE utt_id NOT IN (SELECT utt_id FROM ed)), t AS (SELECT utt_id, speaker, sum(greatest(e - s, 10)) AS d, min(word_idx) AS f FROM sp2 GROUP BY utt_id, speaker), mj AS (SELECT DISTINCT ON (utt_id) utt_id, speaker FROM t ORDER BY utt_id, d DESC, f, speaker), """ + _BUILD + """
SELECT * FROM built UNION ALL SELECT job_id, utt_idx + 1000000, coalesce(mj.speaker, ed.speaker), s, e, 0 FROM ed LEFT JOIN mj USING (utt_id)""")
def relabel_preserving_edits(spark, d):
    """Edited utterances, by flag or by a text other than their words, and those without words keep their text and get their words' main label; the others are built anew."""
    label = F.when(F.col("word_idx") % 6 < 2, "b").otherwise("a")
    spoken = _spoken(spark, d).withColumn("speaker", label)
    end = lambda c: F.regexp_replace(c, r"[\s\x0B　]+$", "")
    joined = words(spark, d).groupBy("utt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), "").alias("joined"))
    spoken_of = spoken.select("utt_id").distinct().withColumn("said", F.lit(True))
    u = utts(spark, d).join(joined, "utt_id", "left").join(spoken_of, "utt_id", "left")
    other = end(F.coalesce("text", F.lit(""))) != end(F.col("joined"))
    edited = u.where(F.coalesce("human", F.lit(False)) | F.coalesce("proofread", F.lit(False)) | F.coalesce(other, F.lit(False)) | F.col("said").isNull())
    main = sequence.majority(spoken.join(edited.select("utt_id"), "utt_id", "left_semi"), ["utt_id"], "speaker", F.greatest(F.col("e") - F.col("s"), F.lit(10)), "word_idx").withColumnRenamed("speaker", "main")
    kept = edited.join(main, "utt_id", "left").select("job_id", (F.col("utt_idx") + 1_000_000).cast("bigint").alias("no"), F.coalesce("main", "speaker").alias("speaker"), "s", "e", F.lit(0).cast("bigint").alias("n"))
    return sequence.built_utterances(spoken.join(edited.select("utt_id"), "utt_id", "left_anti")).unionByName(kept)


@add("overlap_clean_clips")
def overlap_clean_clips(spark, d):
    """Clips of three seconds from where one named speaker alone goes on speaking, away from others' utterances."""
    w = W.partitionBy("job_id").orderBy("s", "utt_idx")
    u = utts(spark, d).where("e > s")
    before, after = F.lag(F.struct("speaker", "e")).over(w), F.lead(F.struct("speaker", "s")).over(w)
    near = u.withColumns({"b": before, "a": after}).where(X.is_named(F.col("speaker")))
    lo = F.greatest(F.col("s") + 250, F.when(~F.col("b.speaker").eqNullSafe(F.col("speaker")), F.col("b.e") + 250))
    hi = F.least(F.col("e") - 250, F.when(~F.col("a.speaker").eqNullSafe(F.col("speaker")), F.col("a.s") - 250))
    bounds = near.select("utt_id", "job_id", "speaker", lo.alias("lo"), hi.alias("hi"))
    inside = words(spark, d).where("e > s").select("utt_id", "s", "e").join(bounds, "utt_id").select("job_id", "utt_id", "speaker", F.greatest("s", "lo").alias("s"), F.least("e", "hi").alias("e")).where("e > s")
    runs = sequence.merged_spans(inside, ["job_id", "utt_id", "speaker"], 299)
    n = F.floor((F.col("e") - F.col("s")) / 3000)
    starts = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), n), lambda i: F.col("s") + i * 3000)).alias("a")
    return runs.select("job_id", "utt_id", "speaker", "e", starts).select("job_id", "utt_id", "speaker", F.col("a").alias("s"), F.least(F.col("a") + 3000, F.col("e")).alias("e")).where("e - s >= 1500")


@add("notes_compaction")
def notes_compaction(spark, d):
    """Transcripts summed up in two levels by a generator that keeps first sentences."""
    lines = utts(spark, d).select("job_id", F.col("utt_idx").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("line"))
    return models.compacted_notes(lines, 600, models.FirstSentence())


@add("split_speaker")
def split_speaker(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 5).alias("job"), F.col("label").cast("string").alias("speaker"), F.col("vec_id").alias("clip"), "embedding")
    return models.split_speaker(e)


@add("embed_clips")
def embed_clips(spark, d):
    clips = table(spark, d, "clips").select("clip_id", "path").dropDuplicates(["clip_id"])
    return models.embedded(clips, "path", models.HashEmbedder()).select("clip_id", F.size("embedding").alias("size"), F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm"))


@add("recheck_long_segments", _VP + _MEAN + """, sc AS (SELECT vec_id, vp.person AS own, mean.person AS other, list_inner_product(v, mean) AS x FROM vp, mean), b AS (SELECT vec_id, max(CASE WHEN own = other THEN x END) AS mine, max(x) AS best, arg_max(other, x) AS person FROM sc GROUP BY vec_id)
SELECT vec_id, substr(person, 2) AS person FROM b WHERE best - mine > 0.08""")
def recheck_long_segments(spark, d):
    """Vectors whose own label's centroid is worse by the margin than another's, with the better label."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("person"), "embedding")
    means = vectors.mean_unit(e, ["person"]).withColumnRenamed("mean", "embedding")
    scores = vectors.similarities(e.select(F.struct("vec_id", "person").alias("probe"), "embedding"), means)
    own = F.max(F.when(F.col("probe.person") == F.col("person"), F.col("score")))
    best = F.max(F.struct("score", "person"))
    return scores.groupBy("probe").agg(own.alias("own"), best.alias("best")).where(F.col("best.score") - F.col("own") > 0.08).select("probe.vec_id", F.col("best.person").alias("person"))


@add("merge_tiny_clusters", """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN 100 + label ELSE label END AS c, CASE WHEN vec_id % 50 = 7 THEN 400 ELSE 1500 END AS ms, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), t AS (SELECT c, sum(ms) AS ms FROM e GROUP BY c), lim AS (SELECT greatest(2000, sum(ms) * 0.005) AS least FROM t),
tiny AS (SELECT c FROM t, lim WHERE ms < least), d AS (SELECT c, i, avg(v[i]) AS m FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM e WHERE c NOT IN (SELECT c FROM tiny)) GROUP BY ALL), l AS (SELECT c, list(m ORDER BY i) AS m FROM d GROUP BY c),
s AS (SELECT vec_id, l.c, list_inner_product(v, m) / sqrt(list_inner_product(m, m)) AS x FROM e, l WHERE e.c IN (SELECT c FROM tiny)), n AS (SELECT vec_id, arg_max(c, x) AS c FROM s GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(n.c, e.c) AS VARCHAR) AS person FROM e LEFT JOIN n USING (vec_id)""")
def merge_tiny_clusters(spark, d):
    """Clusters of little speech given, vector by vector, to the nearest of the others."""
    few = F.col("vec_id") % 50 == 7
    e = table(spark, d, "embeddings").select("vec_id", F.when(few, 100 + F.col("label")).otherwise(F.col("label")).cast("string").alias("person"), F.when(few, 400).otherwise(1500).alias("ms"), "embedding")
    return vectors.without_tiny(e, "vec_id")


@add("cluster_speakers")
def cluster_speakers(spark, d):
    """Vectors of every job in as many clusters as it seems to have speakers."""
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 5).alias("job"), F.col("vec_id").alias("clip"), "embedding")
    return models.clusters_of_jobs(e, most=15)


@add("transcribe_clips", "SELECT clip_id, CAST(i - 1 AS DOUBLE) AS start, CAST(i AS DOUBLE) AS \"end\", p[i] AS text FROM (SELECT clip_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT DISTINCT clip_id, string_split(path, '/') AS p FROM clips)) WHERE p[i] <> ''")
def transcribe_clips(spark, d):
    """Segments of clips by a recogniser that needs no model."""
    return models.recognised(table(spark, d, "clips").select("clip_id", "path").distinct(), "clip_id", "path", models.NamedTurns())
