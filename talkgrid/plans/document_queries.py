"""Queries on documents, people, clips and history."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from talkgrid.functions import clock, text as X
from talkgrid.operators import documents as O, sequence
from talkgrid.operators.markdown import QUALIFIERS
from talkgrid.plans.base import CTE, utts
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import table

REGISTRY = Registry()
add = REGISTRY.add

_QUAL = " OR ".join(f"contains(text, '{q}') <> contains(new, '{q}')" for q in QUALIFIERS)
_NUMS = "list_sort(regexp_extract_all(translate({}, '０１２３４５６７８９．，：／', '0123456789.,:/'), '[0-9]+(?:[.,:/][0-9]+)*'))"
_LINES = """WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM documents WHERE text IS NOT NULL))"""


def _lines(spark, d):
    return O.lines(table(spark, d, "documents"))


@add("scan_markdown_lines", _LINES + "SELECT doc_id, line_no, line FROM l")
def scan_markdown_lines(spark, d):
    return _lines(spark, d)


@add("transcript_lines", _LINES + "SELECT doc_id, line_no, CAST(substr(line, 2, 2) AS BIGINT) * 3600 + CAST(substr(line, 5, 2) AS BIGINT) * 60 + CAST(substr(line, 8, 2) AS BIGINT) AS sec, line FROM l WHERE regexp_matches(line, '^\\[\\d{2}:\\d{2}:\\d{2}\\]')")
def transcript_lines(spark, d):
    return O.transcript_lines(_lines(spark, d))


@add("section_items", _LINES + f""", b AS (SELECT *, trim(line, ' ') AS bare FROM l),
n AS (SELECT *, CASE WHEN regexp_matches(bare, '^【[^】]+】$') THEN substr(bare, 2, length(bare) - 2) WHEN regexp_matches(bare, '^#{{1,3}}\\s+.') AND NOT starts_with(bare, '### 議題') THEN trim(regexp_replace(regexp_replace(bare, '^#{{1,3}}\\s+', ''), '^[^0-9A-Za-z_一-鿿ぁ-ゖァ-ヺ]+', ''), ' ') END AS name FROM b),
p AS (SELECT *, coalesce(last_value(name IGNORE NULLS) OVER w, '') AS section, count(name) OVER w AS part FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q AS (SELECT *, starts_with(bare, '|') AND NOT regexp_matches(bare, '^\\|[\\s\\-:|]+\\|$') AS row FROM p WHERE name IS NULL AND bare <> '' AND NOT regexp_matches(section, '{O.SKIPPED}')),
s AS (SELECT *, sum(CASE WHEN row THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, part ORDER BY line_no) AS seen FROM q)
SELECT doc_id, line_no, section, line FROM s WHERE CASE WHEN starts_with(bare, '|') THEN row AND seen > 1 AND trim(replace(bare, '|', ''), ' ') <> ''
WHEN regexp_matches(bare, '^\\s*([-*・]|\\d+[.．)])\\s*\\S') THEN trim(regexp_replace(regexp_replace(bare, '^\\s*([-*・]|\\d+[.．)])\\s*', ''), '^[（）() ]+|[（）() ]+$', '', 'g'), ' ') <> '' ELSE regexp_matches(section, '{O.PARAGRAPHS}') AND NOT starts_with(bare, '#') END""")
def section_items(spark, d):
    return O.sectioned(_lines(spark, d))


@add("parse_inline_runs", CTE + """, x AS (SELECT utt_id, unnest(regexp_extract_all(marked, '<span style="color:red">[^<]*</span>|[^<]+')) AS run FROM u)
SELECT utt_id, starts_with(run, '<span') AS red, count(*) AS n, CAST(sum(length(regexp_replace(run, '<[^>]*>', '', 'g'))) AS BIGINT) AS chars FROM x GROUP BY ALL""")
def parse_inline_runs(spark, d):
    run = F.explode(F.regexp_extract_all("marked", F.lit('<span style="color:red">[^<]*</span>|[^<]+'), F.lit(0)))
    x = utts(spark, d).select("utt_id", run.alias("run"))
    return x.groupBy("utt_id", F.startswith("run", F.lit("<span")).alias("red")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(F.regexp_replace("run", "<[^>]*>", ""))).alias("chars"))


_TS = r"((?:\d{1,2}:)?\d{1,2}:\d{2}[,.]\d{1,3})"


@add("parse_srt", """WITH b AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS no, unnest(x) AS block FROM (SELECT doc_id, string_split(regexp_replace(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(65279), ''), '\\n[\\s\\x0B]*\\n', chr(1), 'g'), chr(1)) AS x FROM documents WHERE kind = 'srt' AND text IS NOT NULL)),
p AS (SELECT doc_id, no, regexp_extract(block, '((?:\\d{1,2}:)?\\d{1,2}:\\d{2}[,.]\\d{1,3})\\s*-->\\s*((?:\\d{1,2}:)?\\d{1,2}:\\d{2}[,.]\\d{1,3})[^\\n]*\\n((?:.|\\n)*)', ['a', 'z', 'body']) AS r FROM b WHERE regexp_matches(block, '(?:\\d{1,2}:)?\\d{1,2}:\\d{2}[,.]\\d{1,3}\\s*-->\\s*(?:\\d{1,2}:)?\\d{1,2}:\\d{2}[,.]\\d{1,3}[^\\n]*\\n')),
t AS (SELECT doc_id, no, string_split(replace(r.a, ',', '.'), ':') AS a, string_split(replace(r.z, ',', '.'), ':') AS z, regexp_replace(r.body, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS body FROM p),
k AS (SELECT DISTINCT speaker FROM utterances WHERE speaker IS NOT NULL), v AS (SELECT *, regexp_extract(body, '^[（(]([^）)]{1,20})[）)]', 1) AS named, regexp_extract(body, '^<v ([^>]+)>', 1) AS voice FROM t),
o AS (SELECT *, CASE WHEN named IN (SELECT speaker FROM k) AND trim(substr(body, length(named) + 3)) <> '' THEN named ELSE '' END AS who FROM v)
SELECT doc_id, no, CAST(round_even((CASE WHEN len(a) = 3 THEN CAST(a[1] AS DOUBLE) * 3600 ELSE 0 END + CAST(a[-2] AS DOUBLE) * 60 + CAST(a[-1] AS DOUBLE)) * 1000, 0) AS BIGINT) AS s, CAST(round_even((CASE WHEN len(z) = 3 THEN CAST(z[1] AS DOUBLE) * 3600 ELSE 0 END + CAST(z[-2] AS DOUBLE) * 60 + CAST(z[-1] AS DOUBLE)) * 1000, 0) AS BIGINT) AS e,
CASE WHEN who <> '' THEN who ELSE voice END AS speaker, CASE WHEN who <> '' THEN regexp_replace(substr(body, length(who) + 3), '^[\\s\\x0B]+', '') WHEN voice <> '' THEN regexp_replace(substr(body, length(voice) + 5), '^[\\s\\x0B]+', '') ELSE body END AS body FROM o WHERE body <> ''""")
def parse_srt(spark, d):
    """Cues of the subtitle documents; a name in round brackets is the speaker if it is a known one, and one in a voice tag always."""
    docs = table(spark, d, "documents").where("kind = 'srt' AND text IS NOT NULL")
    plain = F.replace(F.regexp_replace("text", "\r\n?", "\n"), F.lit("\ufeff"), F.lit(""))
    b = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(plain, r"\n\s*\n", "\x01"), "\x01")).alias("p", "block"))
    times = _TS + r"\s*-->\s*" + _TS + r"[^\n]*\n([\s\S]*)"
    ms = lambda i: F.bround(clock.parse_seconds(F.replace(F.regexp_extract("block", times, i), F.lit(","), F.lit("."))) * 1000).cast("bigint")
    body = F.regexp_replace(F.regexp_extract("block", times, 3), r"^\s+|\s+$", "")
    cue = b.where(F.col("block").rlike(times)).select("doc_id", (F.col("p") + 1).cast("bigint").alias("no"), ms(1).alias("s"), ms(2).alias("e"), body.alias("body")).where("body != ''")
    named, voice = F.regexp_extract("body", "^[（(]([^）)]{1,20})[）)]", 1), F.regexp_extract("body", "^<v ([^>]+)>", 1)
    known = table(spark, d, "utterances").where("speaker IS NOT NULL").select(F.col("speaker").alias("named")).distinct().withColumn("known", F.lit(True))
    met = cue.withColumns({"named": named, "voice": voice}).join(known, "named", "left")
    who = F.col("known") & (F.col("named") != "") & (F.trim(F.substr("body", F.char_length("named") + 3)) != "")
    rest = lambda n, skip: F.regexp_replace(F.substr("body", F.char_length(n) + skip), r"^\s+", "")
    text = F.when(who, rest("named", 3)).when(F.col("voice") != "", rest("voice", 5)).otherwise(F.col("body"))
    return met.select("doc_id", "no", "s", "e", F.when(who, F.col("named")).otherwise(F.col("voice")).alias("speaker"), text.alias("body"))


@add("search_outputs", """WITH f AS (SELECT doc_id, source, text FROM documents WHERE contains(lower(text), '管理') AND contains(lower(text), '確認')), l AS (SELECT doc_id, source, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, source, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM f)),
h AS (SELECT source, doc_id, line_no, replace(regexp_replace(line, '<span style="color:red">(.*?)</span>', '\\1', 'gs'), '**', '') AS p FROM l WHERE contains(lower(line), '管理') OR contains(lower(line), '確認')),
g AS (SELECT *, coalesce(nullif(instr(lower(p), '管理'), 0), nullif(instr(lower(p), '確認'), 0), 1) AS pos, CASE WHEN contains(lower(p), '管理') THEN 2 WHEN contains(lower(p), '確認') THEN 2 ELSE 0 END AS n FROM h)
SELECT source AS folder, doc_id, line_no, CASE WHEN pos - 31 > 0 THEN '…' ELSE '' END || substr(p, greatest(pos - 31, 0) + 1, least(pos - 1 + n + 30, length(p)) - greatest(pos - 31, 0)) || CASE WHEN pos - 1 + n + 30 < length(p) THEN '…' ELSE '' END AS snippet FROM g ORDER BY folder DESC, doc_id DESC, line_no LIMIT 200""")
def search_outputs(spark, d):
    return O.search(table(spark, d, "documents"), "管理　確認")


@add("list_jobs", "SELECT job_id, job_dir FROM jobs ORDER BY job_dir DESC, job_id")
def list_jobs(spark, d):
    return table(spark, d, "jobs").select("job_id", "job_dir").orderBy(F.desc("job_dir"), "job_id")


@add("list_editable_jobs", "SELECT job_id FROM jobs WHERE job_id IN (SELECT job_id FROM utterances UNION SELECT job_id FROM clips)")
def list_editable_jobs(spark, d):
    have = table(spark, d, "utterances").select("job_id").union(table(spark, d, "clips").select("job_id"))
    return table(spark, d, "jobs").select("job_id").join(have, "job_id", "left_semi")


@add("list_md_files", "SELECT job_id, list_sort(list(kind || '-' || doc_id || '.md')) AS files FROM documents WHERE job_id IS NOT NULL GROUP BY job_id")
def list_md_files(spark, d):
    name = F.concat("kind", F.lit("-"), "doc_id", F.lit(".md"))
    return table(spark, d, "documents").where("job_id IS NOT NULL").groupBy("job_id").agg(F.array_sort(F.collect_list(name)).alias("files"))


@add("scan_utterances", CTE + "SELECT j.job_id, count(u.utt_id) AS n, coalesce(min(u.s), 0) AS first_s FROM jobs j LEFT JOIN u ON u.job_id = j.job_id GROUP BY j.job_id")
def scan_utterances(spark, d):
    u = utts(spark, d)
    return table(spark, d, "jobs").select("job_id").join(u, "job_id", "left").groupBy("job_id").agg(F.count("utt_id").alias("n"), F.coalesce(F.min("s"), F.lit(0)).alias("first_s"))


@add("scan_partial", CTE + "SELECT job_id, utt_id, '' AS speaker, true AS incomplete FROM u WHERE job_id IN (SELECT job_id FROM jobs WHERE duration IS NULL)")
def scan_partial(spark, d):
    """Jobs that never finished (no duration) as read-only, unlabelled utterances."""
    open_ = table(spark, d, "jobs").where("duration IS NULL").select("job_id")
    return utts(spark, d).join(open_, "job_id", "left_semi").select("job_id", "utt_id", F.lit("").alias("speaker"), F.lit(True).alias("incomplete"))


@add("document_status", """WITH k AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS kept FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN kept IS NULL THEN 'unknown' WHEN kept = sha256(text) THEN 'current' ELSE 'stale' END AS status FROM documents LEFT JOIN k USING (doc_id)""")
def document_status(spark, d):
    docs = table(spark, d, "documents")
    seen = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    kept = docs.where("doc_id % 5 != 0").select("doc_id", F.sha2(seen, 256).alias("kept"))
    return O.status(docs, kept)


@add("staleness_report", """WITH k AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS kept FROM documents WHERE doc_id % 5 <> 0)
SELECT CASE WHEN text IS NULL THEN 'missing' WHEN kept IS NULL THEN 'unknown' WHEN kept = sha256(text) THEN 'current' ELSE 'stale' END AS status, count(*) AS n FROM documents LEFT JOIN k USING (doc_id) GROUP BY 1""")
def staleness_report(spark, d):
    return document_status(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@add("document_warning", """WITH k AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS kept FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN text IS NULL THEN 'create it' WHEN kept IS NULL THEN 'not tracked' WHEN kept = sha256(text) THEN '' ELSE 'create it again' END AS hint FROM documents LEFT JOIN k USING (doc_id)""")
def document_warning(spark, d):
    s = F.col("status")
    hint = F.when(s == "missing", "create it").when(s == "unknown", "not tracked").when(s == "current", "").otherwise("create it again")
    return document_status(spark, d).select("doc_id", hint.alias("hint"))


@add("fingerprint", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@add("optimistic_conflict", "SELECT doc_id, md5(text) <> md5(text || CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE '' END) AS conflict FROM documents WHERE text IS NOT NULL")
def optimistic_conflict(spark, d):
    """Whether a document has changed since an editor read it (every fourth has)."""
    seen = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " ").otherwise(""))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", (F.sha2("text", 256) != F.sha2(seen, 256)).alias("conflict"))


_HISTORY = "WITH h AS (SELECT job_id, doc_id AS id, row_number() OVER (PARTITION BY job_id ORDER BY created_at, doc_id) AS version, count(*) OVER (PARTITION BY job_id) AS n FROM documents WHERE job_id IS NOT NULL)"


def _history(spark, d):
    return O.versions(table(spark, d, "documents").where("job_id IS NOT NULL").withColumnRenamed("doc_id", "id"), "job_id", "created_at")


@add("history_append", _HISTORY + "SELECT job_id, id, version, version = n AS latest FROM h")
def history_append(spark, d):
    return _history(spark, d)


@add("history_list", _HISTORY + "SELECT job_id, id, n - version + 1 AS pos FROM h")
def history_list(spark, d):
    newest = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("version")))
    return _history(spark, d).select("job_id", "id", newest.cast("bigint").alias("pos"))


@add("restore", _HISTORY + "SELECT job_id, id, n + 1 AS version FROM h WHERE version = 1")
def restore(spark, d):
    """The first version of each job saved again as its newest."""
    h = _history(spark, d).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("job_id")))
    return h.where("version = 1").select("job_id", "id", (F.col("n") + 1).alias("version"))


@add("history_coalesce", """WITH RECURSIVE x AS (SELECT job_id, doc_id AS id, (epoch_us(created_at) // 1000) AS t, row_number() OVER (PARTITION BY job_id ORDER BY (epoch_us(created_at) // 1000), doc_id) AS rn FROM documents WHERE job_id IS NOT NULL),
f AS (SELECT job_id, id, rn, t AS pos, true AS kept FROM x WHERE rn = 1 UNION ALL SELECT x.job_id, x.id, x.rn, CASE WHEN x.t - f.pos >= 600000 THEN x.t ELSE f.pos END, x.t - f.pos >= 600000 FROM f JOIN x ON x.job_id = f.job_id AND x.rn = f.rn + 1) SELECT job_id, id FROM f WHERE kept""")
def history_coalesce(spark, d):
    """One backup of a job in ten minutes."""
    x = table(spark, d, "documents").where("job_id IS NOT NULL").select("job_id", F.col("doc_id").alias("id"), F.unix_millis("created_at").alias("t"), F.lit("").alias("phase"))
    return sequence.throttled(x, ["job_id"], 600_000)


@add("name_map", """WITH s AS (SELECT display_name, unnest(list_concat([display_name], coalesce(aliases, []))) AS alias FROM people), m AS (SELECT alias, min(display_name) AS display FROM s WHERE trim(alias) <> '' AND length(alias) >= 2 GROUP BY alias HAVING count(DISTINCT display_name) = 1)
SELECT * FROM m UNION ALL SELECT DISTINCT speaker, speaker FROM utterances WHERE length(speaker) >= 2 AND trim(speaker) <> '' AND speaker NOT IN (SELECT alias FROM s WHERE alias IS NOT NULL)""")
def name_map(spark, d):
    """Spellings of two characters or more with the display name they stand for; other speakers stand for themselves."""
    people = table(spark, d, "people")
    taken = people.select(F.explode(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).where("alias IS NOT NULL")
    speakers = table(spark, d, "utterances").where("length(speaker) >= 2 AND trim(speaker) != ''").select(F.col("speaker").alias("alias")).distinct().join(taken, "alias", "left_anti")
    return O.unambiguous_names(people).unionByName(speakers.withColumn("display", F.col("alias")))


@add("people_table_roundtrip", """SELECT person_id, list_filter(list_transform(string_split(array_to_string(coalesce(aliases, []), '、'), '、'), lambda x: trim(x)), lambda x: x <> '') AS aliases FROM people WHERE trim(display_name) <> ''""")
def people_table_roundtrip(spark, d):
    shown = F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "、")
    back = F.filter(F.transform(F.split(shown, "、"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "people").where("trim(display_name) != ''").select("person_id", back.alias("aliases"))


@add("people_names", """WITH a AS (SELECT display_name AS name, person_id AS o FROM people UNION ALL SELECT speaker, 1000000 FROM utterances WHERE trim(speaker) <> '') SELECT name, min(o) AS first FROM a GROUP BY name""")
def people_names(spark, d):
    a = table(spark, d, "people").select(F.col("display_name").alias("name"), F.col("person_id").alias("o"))
    b = table(spark, d, "utterances").where("trim(speaker) != ''").select(F.col("speaker").alias("name"), F.lit(1_000_000).cast("bigint").alias("o"))
    return O.first_of_each(a.unionByName(b), "name", "o")


@add("ordered_dedupe", "SELECT word, min(job_id * 1000000 + utt_id) AS first FROM words GROUP BY word")
def ordered_dedupe(spark, d):
    return O.first_of_each(table(spark, d, "words").withColumn("o", F.col("job_id") * 1_000_000 + F.col("utt_id")), "word", "o")


@add("context_block", "SELECT role, string_agg(display_name, '、' ORDER BY person_id) AS people FROM people WHERE role <> '' GROUP BY role")
def context_block(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("person_id", "display_name")))
    return table(spark, d, "people").where("role != ''").groupBy("role").agg(F.array_join(F.transform(parts, lambda p: p["display_name"]), "、").alias("people"))


_CORR = "(VALUES ('確認', '点検', 2), ('予算', '予賛', 1), ('会議', '協議', 3), ('です', 'ます', 2))"


@add("apply_corrections", CTE + "SELECT utt_id, replace(replace(replace(text, '確認', '点検'), '会議', '協議'), 'です', 'ます') AS text FROM u")
def apply_corrections(spark, d):
    pairs = [("確認", "点検", 2), ("予算", "予賛", 1), ("会議", "協議", 3), ("です", "ます", 2)]
    return utts(spark, d).select("utt_id", X.applied_corrections(F.col("text"), pairs).alias("text"))


@add("learn_pair", f"""WITH k AS (SELECT * FROM {_CORR} t(a, b, n)), w AS (SELECT event_type AS a, CAST(user_id % 3 AS VARCHAR) AS b, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT a, b, n FROM k) SELECT a AS wrong, b AS "right", CAST(greatest(sum(n), 2) AS BIGINT) AS count FROM w GROUP BY a, b HAVING max(a) NOT IN ('予算') UNION ALL SELECT '予算', '予賛', 1""")
def learn_pair(spark, d):
    kept = spark.createDataFrame([("確認", "点検", 2), ("予算", "予賛", 1), ("会議", "協議", 3), ("です", "ます", 2)], "wrong string, right string, count bigint")
    new = table(spark, d, "events").select(F.col("event_type").alias("wrong"), (F.col("user_id") % 3).cast("string").alias("right"))
    return O.upserted(kept, new, promote=2)


@add("learnable_pair", """SELECT doc_id, coalesce(length(source) BETWEEN 2 AND 12 AND length(kind) BETWEEN 2 AND 12 AND NOT regexp_matches(source, '[\\n、。？！?!，,.]') AND NOT regexp_matches(kind, '[\\n、。？！?!，,.]') AND source <> kind, false) AS learnable FROM documents""")
def learnable_pair(spark, d):
    return table(spark, d, "documents").select("doc_id", X.learnable(F.col("source"), F.col("kind")).alias("learnable"))


@add("mistake_hints", """WITH c AS (SELECT trim(event_type) AS wrong, CAST(user_id % 50 AS VARCHAR) || 'x' AS "right", count(*) AS n FROM events GROUP BY ALL)
SELECT wrong, "right", n FROM c WHERE length(wrong) BETWEEN 2 AND 12 AND length("right") BETWEEN 2 AND 12 AND wrong <> "right" ORDER BY n DESC, wrong, "right" LIMIT 40""")
def mistake_hints(spark, d):
    """The forty corrections that were made most often, of those that may be learned (a top-k report)."""
    c = table(spark, d, "events").select(F.trim("event_type").alias("wrong"), F.concat((F.col("user_id") % 50).cast("string"), F.lit("x")).alias("right"))
    seen = c.groupBy("wrong", "right").agg(F.count(F.lit(1)).alias("n")).where(X.learnable(F.col("wrong"), F.col("right")))
    return seen.orderBy(F.desc("n"), "wrong", "right").limit(40)


@add("safe_filename", "SELECT doc_id, substr(trim(regexp_replace(coalesce(source, '') || ':' || kind || '/' || substr(coalesce(text, ''), 1, 80), '[\\\\/:*?\"<>|\\r\\n\\t]', '_', 'g'), ' '), 1, 60) AS name FROM documents")
def safe_filename(spark, d):
    raw = F.concat(F.coalesce("source", F.lit("")), F.lit(":"), "kind", F.lit("/"), F.substring(F.coalesce("text", F.lit("")), 1, 80))
    return table(spark, d, "documents").select("doc_id", X.safe_name(raw).alias("name"))


_WINDOW = "least(65536, 16384 * CAST(pow(2, greatest(0, ceil(log2((floor(length(text) * 0.8) + 6144) / 16384)))) AS BIGINT))"


@add("estimate_tokens", f"SELECT doc_id, CAST(ceil(length(text) * 0.8) AS BIGINT) AS tokens, {_WINDOW} AS window_size FROM documents WHERE text IS NOT NULL")
def estimate_tokens(spark, d):
    n = F.char_length("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.token_estimate(n).alias("tokens"), X.window_size(n).alias("window_size"))


@add("fits_context", "SELECT doc_id, b AS budget, length(text) <= b AS fits FROM (SELECT doc_id, text, CAST(greatest(0, floor((8192 - 6144 - floor((doc_id % 900) * 0.8) - 64) / 0.8)) AS BIGINT) AS b FROM documents WHERE text IS NOT NULL)")
def fits_context(spark, d):
    """Whether a document fits a window of 8,192 tokens beside a system's text of some length, and the room there is."""
    room = X.input_budget(F.col("doc_id") % 900, F.lit(8192))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", room.alias("budget"), (F.char_length("text") <= room).alias("fits"))


@add("numbers_multiset", CTE + "SELECT utt_id, list_sort(regexp_extract_all(text, '[0-9]+')) AS numbers FROM u WHERE text IS NOT NULL")
def numbers_multiset(spark, d):
    return utts(spark, d).where("text IS NOT NULL").select("utt_id", F.array_sort(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("numbers"))


@add("stamp_except", CTE + """, n AS (SELECT utt_id, regexp_extract_all(text, '[0-9]+') AS a, regexp_extract_all(regexp_replace(coalesce(marked, ''), '<[^>]*>', '', 'g'), '[0-9]+') AS b FROM u WHERE text IS NOT NULL)
SELECT utt_id, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS lost FROM n""")
def stamp_except(spark, d):
    """Numbers of a text that its marked version has lost."""
    found = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    plain = F.regexp_replace(F.coalesce("marked", F.lit("")), "<[^>]*>", "")
    return utts(spark, d).where("text IS NOT NULL").select("utt_id", F.array_sort(F.array_except(found(F.col("text")), found(plain))).alias("lost"))


@add("idset_equal", """WITH a AS (SELECT DISTINCT job_id FROM utterances), b AS (SELECT DISTINCT job_id FROM words) SELECT job_id, 'no words' AS side FROM (SELECT job_id FROM a EXCEPT SELECT job_id FROM b) UNION ALL SELECT job_id, 'no utterances' FROM (SELECT job_id FROM b EXCEPT SELECT job_id FROM a)
UNION ALL SELECT count(*), 'jobs' FROM a""")
def idset_equal(spark, d):
    a, b = table(spark, d, "utterances").select("job_id").distinct(), table(spark, d, "words").select("job_id").distinct()
    side = lambda x, y, name: x.join(y, "job_id", "left_anti").select("job_id", F.lit(name).alias("side"))
    return side(a, b, "no words").unionByName(side(b, a, "no utterances")).unionByName(a.agg(F.count(F.lit(1)).alias("job_id")).select("job_id", F.lit("jobs").alias("side")))


@add("union_recovered", CTE + """, a AS (SELECT job_id, utt_id AS id, s, 0 AS o FROM u UNION ALL SELECT job_id, clip_id + 10000000, CAST(round_even(start * 1000, 0) AS BIGINT), 1 FROM (SELECT DISTINCT job_id, clip_id, start FROM clips))
SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY s NULLS FIRST, o, id) AS pos FROM a""")
def union_recovered(spark, d):
    clips = table(spark, d, "clips").select("job_id", (F.col("clip_id") + 10_000_000).alias("id"), F.bround(F.col("start") * 1000).cast("bigint").alias("s"), F.lit(1).alias("o")).distinct()
    both = utts(spark, d).select("job_id", F.col("utt_id").alias("id"), "s", F.lit(0).alias("o")).unionByName(clips)
    return both.select("job_id", "id", F.row_number().over(W.partitionBy("job_id").orderBy("s", "o", "id")).cast("bigint").alias("pos"))


_EVID = CTE + """, it AS (SELECT utt_id AS item_id, job_id, s // 1000 AS sec FROM u WHERE contains(text, '確認') AND s IS NOT NULL), sp AS (SELECT utt_id, job_id, utt_idx, s // 1000 AS sec FROM u WHERE s IS NOT NULL)"""


@add("evidence_time", _EVID + "SELECT DISTINCT item_id, sp.utt_id FROM it JOIN sp ON sp.job_id = it.job_id AND abs(sp.sec - it.sec) <= 75")
def evidence_time(spark, d):
    u = utts(spark, d).where("s IS NOT NULL").withColumn("sec", F.floor(F.col("s") / 1000))
    return O.evidence_by_time(u.where(F.contains("text", F.lit("確認"))).select(F.col("utt_id").alias("item_id"), "job_id", "sec"), u.select("utt_id", "job_id", "sec"))


_KEYS = "list_distinct(regexp_extract_all(text, '[一-龥々]{2,}|[ァ-ヺー]{2,}|[A-Za-z0-9]{2,}'))"


@add("evidence_keyword", CTE + """, it AS (SELECT utt_id AS item_id, job_id, unnest(list_filter(list_distinct(regexp_extract_all(regexp_replace(coalesce(text, ''), '<span style="color:red">(.*?)</span>', '\\1', 'g'), '[一-鿿々]{2,}|[ァ-ヺー]{2,}|[A-Za-z0-9０-９]{2,}')), lambda k: k NOT IN ('根拠', '担当', '期限', '未定', '確認', '必要', '事項'))) AS word FROM u WHERE contains(text, '確認')),
sp AS (SELECT utt_id, job_id, text, row_number() OVER (PARTITION BY job_id ORDER BY utt_idx, utt_id) AS no FROM u), h AS (SELECT item_id, sp.job_id, no, count(*) AS hits FROM it JOIN sp ON sp.job_id = it.job_id AND contains(sp.text, it.word) GROUP BY ALL),
b AS (SELECT item_id, job_id, no FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, no) AS r FROM h) WHERE r <= 3)
SELECT DISTINCT item_id, sp.utt_id FROM b JOIN sp ON sp.job_id = b.job_id AND abs(sp.no - b.no) <= 1""")
def evidence_keyword(spark, d):
    u = utts(spark, d).withColumn("keywords", X.keywords(F.col("text")))
    spoken = u.select("utt_id", "job_id", "text", F.row_number().over(W.partitionBy("job_id").orderBy("utt_idx", "utt_id")).alias("no"))
    return O.evidence_by_keyword(u.where(F.contains("text", F.lit("確認"))).select(F.col("utt_id").alias("item_id"), "job_id", "keywords"), spoken)


@add("evidence_budget", CTE + """, x AS (SELECT *, sum(length(text)) OVER (PARTITION BY job_id ORDER BY abs(s - 60000), utt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM u WHERE text IS NOT NULL AND s IS NOT NULL) SELECT job_id, utt_id FROM x WHERE total <= 1400""")
def evidence_budget(spark, d):
    u = utts(spark, d).where("text IS NOT NULL AND s IS NOT NULL").withColumn("far", F.abs(F.col("s") - 60_000))
    return O.within_budget(u, "job_id", ["far", "utt_idx"], F.char_length("text"), 1400).select("job_id", "utt_id")


@add("quote_support", CTE + f"""SELECT q.utt_id AS item_id, count(x.utt_id) AS n, length(trim(q.quote, ' ')) >= 6 AND coalesce(bool_or(x.utt_id IS NOT NULL AND (q.claimed IS NULL OR contains(q.quote, q.claimed) OR (x.speaker IS NOT DISTINCT FROM q.claimed AND regexp_matches(q.quote, '{X.FIRST_PERSON}')))), false) AS supported
FROM (SELECT utt_id, job_id, s // 1000 AS stamp, substr(marked, 3, 12) AS quote, CASE WHEN utt_id % 2 = 0 THEN speaker END AS claimed FROM u WHERE length(marked) >= 20 AND s IS NOT NULL) q LEFT JOIN u x ON x.job_id = q.job_id AND x.s // 1000 = q.stamp AND contains(x.text, q.quote) GROUP BY q.utt_id, q.quote""")
def quote_support(spark, d):
    """Quotes from the marked text against all lines of the job with the same stamp (a second); every second one claims its speaker."""
    u = utts(spark, d).where("s IS NOT NULL").withColumn("stamp", F.floor(F.col("s") / 1000))
    q = u.where(F.char_length("marked") >= 20).select(F.col("utt_id").alias("item_id"), "job_id", "stamp", F.substring("marked", 3, 12).alias("quote"), F.when(F.col("utt_id") % 2 == 0, F.col("speaker")).alias("claimed"))
    return O.supported_quotes(q, u.select("job_id", "stamp", "speaker", "text"))


@add("dedupe_search_source", "SELECT doc_id FROM documents a WHERE NOT (kind = 'transcript' AND EXISTS (SELECT 1 FROM documents b WHERE b.source = a.source AND b.kind = 'summary' AND b.job_id = a.job_id))")
def dedupe_search_source(spark, d):
    """Transcripts are left out where the same folder and job has a summary."""
    docs = table(spark, d, "documents")
    plain = docs.where("kind = 'summary'").select("source", "job_id").distinct()
    keep = docs.where("kind = 'transcript'").join(plain, ["source", "job_id"], "left_anti")
    return docs.where("kind != 'transcript' OR kind IS NULL").select("doc_id").unionByName(keep.select("doc_id"))


@add("apply_edit_table", CTE + """, x AS (SELECT job_id, utt_idx, min(text) AS text, bool_or(coalesce(human, false)) AS human FROM u GROUP BY job_id, utt_idx),
ed AS (SELECT job_id, utt_idx, text AS shown, CASE WHEN utt_idx % 14 = 0 THEN '' WHEN utt_idx % 7 = 0 THEN text || '！' ELSE text END AS new FROM x WHERE NOT (job_id % 4 = 1 AND utt_idx = 0) UNION ALL SELECT job_id, utt_idx, text, text FROM x WHERE job_id % 4 = 2 AND utt_idx = 1 UNION ALL SELECT job_id, utt_idx + 1000000, text, text FROM x WHERE job_id % 4 = 3 AND utt_idx = 0),
er AS (SELECT x.job_id, CASE WHEN max(c.twice) > 1 THEN 'twice' WHEN bool_or(c.unknown) THEN 'unknown' WHEN bool_or(ed.job_id IS NULL) THEN 'missing' END AS error FROM x LEFT JOIN ed ON ed.job_id = x.job_id AND ed.utt_idx = x.utt_idx
LEFT JOIN (SELECT job_id, max(n) AS twice, bool_or(NOT known) AS unknown FROM (SELECT ed.job_id, ed.utt_idx, count(*) AS n, bool_or(x.job_id IS NOT NULL) AS known FROM ed LEFT JOIN x ON x.job_id = ed.job_id AND x.utt_idx = ed.utt_idx GROUP BY ALL) GROUP BY job_id) c ON c.job_id = x.job_id GROUP BY x.job_id)
SELECT x.job_id, x.utt_idx, CASE WHEN er.error IS NULL THEN n.new ELSE x.text END AS text, (er.error IS NULL AND n.new IS DISTINCT FROM n.shown) OR x.human AS human, er.error FROM x JOIN er USING (job_id) LEFT JOIN (SELECT job_id, utt_idx, min(shown) AS shown, min(new) AS new FROM ed GROUP BY ALL) n ON n.job_id = x.job_id AND n.utt_idx = x.utt_idx
WHERE NOT (er.error IS NULL AND n.new IS DISTINCT FROM n.shown AND coalesce(n.new, '') = '')""")
def apply_edit_table(spark, d):
    """Tables of edits, of which one job in four leaves a row out, one names a row twice, one an unknown row."""
    u = utts(spark, d).groupBy("job_id", "utt_idx").agg(F.min("text").alias("text"), F.max(F.coalesce("human", F.lit(False))).alias("human"))
    i = F.col("utt_idx")
    new = F.when(i % 14 == 0, F.lit("")).when(i % 7 == 0, F.concat("text", F.lit("！"))).otherwise(F.col("text"))
    edits = u.where("NOT (job_id % 4 = 1 AND utt_idx = 0)").select("job_id", "utt_idx", F.col("text").alias("shown"), new.alias("new"))
    again = u.where("job_id % 4 = 2 AND utt_idx = 1").select("job_id", "utt_idx", F.col("text").alias("shown"), F.col("text").alias("new"))
    beyond = u.where("job_id % 4 = 3 AND utt_idx = 0").select("job_id", (i + 1_000_000).alias("utt_idx"), F.col("text").alias("shown"), F.col("text").alias("new"))
    return O.edits_applied(u, edits.unionByName(again).unionByName(beyond))


@add("delete_item", CTE + "SELECT utt_id FROM u WHERE utt_id NOT IN (SELECT utt_id FROM u WHERE proofread_pending)")
def delete_item(spark, d):
    u = utts(spark, d)
    return u.select("utt_id").join(u.where("proofread_pending").select("utt_id"), "utt_id", "left_anti")


@add("corrections_table_roundtrip", "SELECT doc_id, source AS wrong, kind AS \"right\", coalesce(try_cast(lang AS BIGINT), 1) AS count FROM documents WHERE trim(source) <> '' AND trim(kind) <> ''")
def corrections_table_roundtrip(spark, d):
    keep = table(spark, d, "documents").where("trim(source) != '' AND trim(kind) != ''")
    return keep.select("doc_id", F.col("source").alias("wrong"), F.col("kind").alias("right"), F.coalesce(F.col("lang").try_cast("bigint"), F.lit(1)).alias("count"))


@add("context_table_validate", "SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN 'missing' WHEN length(text) > 300 THEN 'long' ELSE 'ok' END AS verdict FROM documents")
def context_table_validate(spark, d):
    v = F.when(F.coalesce("source", F.lit("")) == "", "missing").when(F.char_length("text") > 300, "long").otherwise("ok")
    return table(spark, d, "documents").select("doc_id", v.alias("verdict"))


_RATIO = "CAST(length(new) AS DOUBLE) / greatest(length(text), 1) BETWEEN 0.5 AND 1.6"


@add("proofread_accept", CTE + f""", x AS (SELECT utt_id, job_id, utt_idx + 1 AS no, text, coalesce(nullif(speaker, ''), '話者') AS who, replace(regexp_replace(coalesce(marked, ''), '<[^>]*>', '', 'g'), chr(10), ' ') AS m FROM u WHERE text IS NOT NULL),
ln AS (SELECT job_id, no, trim(CASE WHEN no % 5 = 0 THEN who || '：' || m WHEN no % 7 = 0 THEN substr(m, 1, 3) WHEN no % 11 = 0 THEN replace(m, '1', '7') ELSE m END, ' ') AS body FROM x UNION ALL SELECT job_id, no, trim(m, ' ') FROM x WHERE no % 11 = 0),
y AS (SELECT x.job_id, x.no, text, CASE WHEN starts_with(body, who || ':') OR starts_with(body, who || '：') THEN trim(substr(body, length(who) + 2), ' ') ELSE body END AS new FROM x JOIN ln ON ln.job_id = x.job_id AND ln.no = x.no WHERE body <> ''),
ok AS (SELECT DISTINCT job_id, no FROM y WHERE {_RATIO} AND {_NUMS.format("new")} = {_NUMS.format("text")} AND NOT ({_QUAL}))
SELECT DISTINCT job_id AS id, no, (job_id, no) IN (SELECT (job_id, no) FROM ok) AS accepted FROM x""")
def proofread_accept(spark, d):
    """Replies made of the marked texts: some too short, some with other numbers and then a right line, some behind the speaker's name, and one of an unknown row."""
    u = utts(spark, d).where("text IS NOT NULL").select(F.col("job_id").alias("id"), (F.col("utt_idx") + 1).cast("bigint").alias("no"), "speaker", "text", "marked")
    plain = F.replace(F.regexp_replace(F.coalesce("marked", F.lit("")), "<[^>]*>", ""), F.lit("\n"), F.lit(" "))
    n, who = F.col("no"), F.coalesce(F.nullif("speaker", F.lit("")), F.lit("話者"))
    body = F.when(n % 5 == 0, F.concat(who, F.lit("："), plain)).when(n % 7 == 0, F.substring(plain, 1, 3)).when(n % 11 == 0, F.replace(plain, F.lit("1"), F.lit("7"))).otherwise(plain)
    line = lambda text: F.concat(F.lit("["), n.cast("string"), F.lit("] "), text)
    both = F.concat_ws("\n", line(body), F.when(n % 11 == 0, line(plain)))
    replies = u.groupBy("id").agg(F.concat(F.lit("[99999999] nobody\nno line of an answer\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", both.alias("t")))), lambda x: x["t"]), "\n")).alias("reply"))
    return O.accepted_replies(u.select("id", "no", "speaker", "text"), replies).distinct()


@add("verify_report", CTE + "SELECT job_id, CAST(sum(CASE WHEN human THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN human = false THEN 1 ELSE 0 END) AS BIGINT) AS fixed, CAST(sum(CASE WHEN human IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unresolved FROM u GROUP BY job_id")
def verify_report(spark, d):
    v = F.when(F.col("human"), "ok").when(~F.col("human"), "fixed").otherwise("unresolved")
    return utts(spark, d).withColumn("v", v).groupBy("job_id").pivot("v", ["ok", "fixed", "unresolved"]).agg(F.count(F.lit(1))).na.fill(0)


_ARMS = """WITH c AS (SELECT DISTINCT clip_id, job_id, coalesce(whisper, '') AS a FROM clips), q AS (SELECT clip_id, CASE WHEN clip_id % 9 = 0 THEN '' WHEN clip_id % 4 = 1 THEN a || '。' WHEN clip_id % 7 = 2 THEN replace(a, 'の', '') WHEN a = '' THEN 'x' ELSE a END AS b, clip_id % 31 AS sec, clip_id % 13 = 0 AS unsafe FROM c),
g AS (SELECT clip_id, CASE WHEN clip_id % 5 = 0 THEN b || 'です' WHEN clip_id % 6 = 1 THEN b || '！' ELSE b END AS c FROM q), x AS (SELECT job_id, a, b, g.c, sec, unsafe, regexp_replace(b, '[\\s、。？！?!,.・…]', '', 'g') AS pb, regexp_replace(g.c, '[\\s、。？！?!,.・…]', '', 'g') AS pc FROM c JOIN q USING (clip_id) JOIN g USING (clip_id))
"""


def _arms(spark, d):
    """Clips as three recognitions of the same windows: the first as it is, a second, and the second corrected."""
    c = table(spark, d, "clips").select("clip_id", "job_id", F.coalesce("whisper", F.lit("")).alias("a")).distinct()
    i, a, b = F.col("clip_id"), F.col("a"), F.col("b")
    second = F.when(i % 9 == 0, "").when(i % 4 == 1, F.concat(a, F.lit("。"))).when(i % 7 == 2, F.replace(a, F.lit("の"), F.lit(""))).when(a == "", "x").otherwise(a)
    q = c.select("clip_id", second.alias("b"), (i % 31).alias("sec"), (i % 13 == 0).alias("unsafe"))
    g = q.select("clip_id", F.when(i % 5 == 0, F.concat(b, F.lit("です"))).when(i % 6 == 1, F.concat(b, F.lit("！"))).otherwise(b).alias("c"))
    return c, q, g


@add("experiment_stats", _ARMS + """SELECT job_id, count(*) AS windows, CAST(sum(sec) AS BIGINT) AS sec, CAST(sum(CASE WHEN b = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty, CAST(sum(CASE WHEN unsafe THEN 1 ELSE 0 END) AS BIGINT) AS unsafe, CAST(sum(CASE WHEN b <> c THEN 1 ELSE 0 END) AS BIGINT) AS changed,
CAST(sum(CASE WHEN pb <> pc THEN 1 ELSE 0 END) AS BIGINT) AS reworded, CAST(sum(CASE WHEN a = '' AND b <> '' THEN 1 ELSE 0 END) AS BIGINT) AS filled, CAST(sum(length(a)) AS BIGINT) AS chars_a, CAST(sum(length(b)) AS BIGINT) AS chars_b, CAST(sum(length(c)) AS BIGINT) AS chars_c FROM x GROUP BY job_id""")
def experiment_stats(spark, d):
    """What a second recogniser and a correction of it did to the windows of each job."""
    return O.compared(*_arms(spark, d), "job_id")


@add("compare_recognitions", _ARMS + """SELECT CAST(count(*) AS BIGINT) AS windows, CAST(sum(CASE WHEN pb <> pc THEN 1 ELSE 0 END) AS BIGINT) AS reworded, (SELECT count(*) FROM c) = (SELECT count(*) FROM q) AS same_windows FROM x""")
def compare_recognitions(spark, d):
    """The whole comparison in one row, and whether all arms have the same windows."""
    a, b, c = _arms(spark, d)
    ids = lambda x, y: x.join(y, "clip_id", "left_anti").limit(1)
    same = a.select(F.lit(1)).limit(1).count() == 0 or (ids(a, b).isEmpty() and ids(b, c).isEmpty() and ids(c, a).isEmpty())
    return O.compared(a, b, c, "job_id").agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("windows"), F.sum("reworded").alias("reworded")).withColumn("same_windows", F.lit(same))


@add("stride_sample", """WITH r AS (SELECT job_id, utt_id, row_number() OVER (PARTITION BY job_id ORDER BY utt_idx, utt_id) - 1 AS i, count(*) OVER (PARTITION BY job_id) AS n FROM (SELECT DISTINCT job_id, utt_id, utt_idx FROM utterances)), k AS (SELECT DISTINCT job_id, n, j * n // 10 AS i FROM (SELECT DISTINCT job_id, n FROM r), range(10) t(j)) SELECT r.job_id, utt_id FROM r JOIN k ON k.job_id = r.job_id AND k.i = r.i""")
def stride_sample(spark, d):
    """Ten utterances of each job, evenly apart (a sampling operator)."""
    w = W.partitionBy("job_id")
    u = utts(spark, d).select("job_id", "utt_id", "utt_idx")
    r = u.withColumns({"i": F.row_number().over(w.orderBy("utt_idx", "utt_id")) - 1, "n": F.count(F.lit(1)).over(w)})
    # Row i is the one at floor(j * n / 10) for the j it falls to.
    j = F.ceil(F.col("i") * 10 / F.col("n")).cast("bigint")
    return r.where((j < 10) & (F.floor(j * F.col("n") / 10) == F.col("i"))).select("job_id", "utt_id")
