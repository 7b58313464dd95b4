"""Queries on sentences, cues and speaker smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.functions import text as X
from talkgrid.functions.text import RED_CLOSE, RED_OPEN
from talkgrid.operators import cues as O, difference as D, labels as L, sequence
from talkgrid.plans.base import CTE, utts, words
from talkgrid.plans.registry import Registry

REGISTRY = Registry()
add = REGISTRY.add


def _words(spark, d):
    """Words with labels that flicker (by arithmetic on their numbers)."""
    k = F.pmod(F.col("word_idx") * F.col("word_idx") * 3 + F.col("word_idx") + F.col("utt_id"), F.lit(11))
    label = F.when(k < 4, "b").when(k == 7, "c").otherwise("a")
    return words(spark, d).where("s IS NOT NULL AND e IS NOT NULL").withColumn("label", label)


def _labelled(spark, d):
    return O.grouped_words(_words(spark, d))


#: Labelled words (wl), the same with the number of their run (wr), and runs.
_RUNS = """WITH RECURSIVE """ + CTE[len("\nWITH ") :] + """, wl AS (SELECT *, CASE WHEN k < 4 THEN 'b' WHEN k = 7 THEN 'c' ELSE 'a' END AS label FROM (SELECT *, (word_idx::BIGINT * word_idx * 3 + word_idx + utt_id) % 11 AS k FROM w WHERE s IS NOT NULL AND e IS NOT NULL)),
wr AS (SELECT *, sum(new) OVER (PARTITION BY utt_id ORDER BY word_idx) AS r FROM (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY utt_id ORDER BY word_idx) = label THEN 0 ELSE 1 END AS new FROM wl)),
run0 AS (SELECT utt_id, r, count(*) AS n, any_value(label) AS label, arg_min(s, word_idx) AS lo, arg_max(e, word_idx) AS hi, min(s) AS low, max(e) AS high FROM wr GROUP BY utt_id, r),
run AS (SELECT *, lead(label) OVER (PARTITION BY utt_id ORDER BY r) AS nxt, max(r) OVER (PARTITION BY utt_id) AS last FROM run0)
"""
_TO_WORDS = "SELECT wr.utt_id, wr.word_idx, f.label FROM wr JOIN f ON f.utt_id = wr.utt_id AND f.r = wr.r"


@add("smooth_flicker", _RUNS + """, f AS (SELECT utt_id, r, CASE WHEN n <= 2 AND hi - lo < 600 THEN coalesce(nxt, label) ELSE label END AS label FROM run WHERE r = 1
UNION ALL SELECT run.utt_id, run.r, CASE WHEN n <= 2 AND hi - lo < 600 THEN f.label ELSE run.label END FROM f JOIN run ON run.utt_id = f.utt_id AND run.r = f.r + 1) """ + _TO_WORDS)
def smooth_flicker(spark, d):
    return L.without_flicker(_words(spark, d))


@add("smooth_windows", _RUNS + """, f AS (SELECT utt_id, r, label FROM run WHERE r = 1
UNION ALL SELECT run.utt_id, run.r, CASE WHEN n = 1 AND run.r < last AND f.label = nxt THEN f.label ELSE run.label END FROM f JOIN run ON run.utt_id = f.utt_id AND run.r = f.r + 1) """ + _TO_WORDS)
def smooth_windows(spark, d):
    """Single windows between two of one label take that label."""
    return L.without_single_windows(_words(spark, d))


@add("snap_edges", _RUNS + """, c AS (SELECT utt_id, list(label ORDER BY word_idx) AS ls FROM wl GROUP BY utt_id),
h AS (SELECT a.utt_id, CASE WHEN len(ls) >= 4 AND a.n <= 2 AND a.last > 1 AND a.high - a.low < 800 AND len(list_filter(ls, lambda x: x = a.nxt)) >= 0.6 * len(ls) THEN a.n ELSE 0 END AS k, a.nxt, c.ls FROM run a JOIN c USING (utt_id) WHERE a.r = 1),
h2 AS (SELECT utt_id, k, list_transform(ls, lambda x, i: CASE WHEN i <= k THEN nxt ELSE x END) AS ls FROM h),
t AS (SELECT z.utt_id, h2.ls, CASE WHEN len(h2.ls) >= 4 AND z.n <= 2 AND z.last > 1 AND NOT (z.last = 2 AND h2.k > 0) AND z.high - z.low < 800 AND len(list_filter(h2.ls, lambda x: x = h2.ls[len(h2.ls) - z.n])) >= 0.6 * len(h2.ls) THEN z.n ELSE 0 END AS k FROM run z JOIN h2 USING (utt_id) WHERE z.r = z.last),
o AS (SELECT utt_id, list_transform(ls, lambda x, i: CASE WHEN i > len(ls) - k THEN ls[len(ls) - k] ELSE x END) AS ls FROM t)
SELECT utt_id, word_idx, ls[row_number() OVER (PARTITION BY utt_id ORDER BY word_idx)] AS label FROM wl JOIN o USING (utt_id)""")
def snap_edges(spark, d):
    return L.snapped_edges(_words(spark, d))


@add("phrase_vote", _RUNS + """, e AS (SELECT *, coalesce(regexp_matches(rtrim(word), '[。？！?!、，,]$') OR lead(s) OVER (PARTITION BY utt_id ORDER BY word_idx) - e >= 300, false) AS stop FROM wl),
p AS (SELECT *, coalesce(sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY utt_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM e),
q AS (SELECT *, sum(new) OVER (PARTITION BY utt_id ORDER BY word_idx) AS no FROM (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY utt_id, p ORDER BY word_idx) = label THEN 0 ELSE 1 END AS new FROM p)),
g AS (SELECT utt_id, p, no, any_value(label) AS label, arg_max(e, word_idx) - arg_min(s, word_idx) AS long FROM q GROUP BY utt_id, p, no),
m AS (SELECT utt_id, p, label, sum(long) AS weight, min(no) AS since FROM g GROUP BY utt_id, p, label), b AS (SELECT DISTINCT ON (utt_id, p) utt_id, p, label AS main FROM m ORDER BY utt_id, p, weight DESC, since)
SELECT q.utt_id, q.word_idx, CASE WHEN g.long < 1500 THEN b.main ELSE q.label END AS label FROM q JOIN g ON g.utt_id = q.utt_id AND g.no = q.no JOIN b ON b.utt_id = q.utt_id AND b.p = q.p""")
def phrase_vote(spark, d):
    return L.voted_phrases(_words(spark, d))


@add("sentence_rows", """WITH RECURSIVE """ + CTE[len("\nWITH "):] + """, c AS (SELECT utt_id, s, e, text, 0 AS i, 0 AS last, false AS cut FROM u WHERE text <> '' UNION ALL
SELECT utt_id, s, e, text, i + 1, CASE WHEN cut THEN i ELSE last END, contains('。？！?!', substr(text, i + 1, 1)) OR (contains('、，,', substr(text, i + 1, 1)) AND i - CASE WHEN cut THEN i ELSE last END >= 80) FROM c WHERE i < length(text)),
p AS (SELECT utt_id, s, e, text, i AS hi, lag(i, 1, 0) OVER (PARTITION BY utt_id ORDER BY i) AS lo FROM (SELECT DISTINCT utt_id, s, e, text, i FROM c WHERE i > 0 AND (cut OR i = length(text)))),
q AS (SELECT *, substr(text, lo + 1, hi - lo) AS piece, regexp_replace(substr(text, lo + 1, hi - lo), '^[\\s　\\x{A0}\\x{2007}\\x{2009}\\x{202F}]+|[\\s　\\x{A0}\\x{2007}\\x{2009}\\x{202F}]+$', '', 'g') AS shown FROM p)
SELECT utt_id, count(*) AS n FROM q WHERE regexp_replace(shown, '[。？！?!、，,]', '', 'g') <> '' OR (shown <> '' AND lo = 0) GROUP BY utt_id""")
def sentence_rows(spark, d):
    """Sentences of each utterance, counted (p: their texts and times are in sentence_times)."""
    return sentence_times(spark, d).groupBy("utt_id").agg(F.count(F.lit(1)).alias("n"))


@add("sentence_times")
def sentence_times(spark, d):
    return O.flat_map(utts(spark, d).select("utt_id", "s", "e", "text"), O.sentence_rows, "utt_id bigint, no int, s bigint, e bigint, text string")


@add("build_cues")
def build_cues(spark, d):
    return O.flat_map(_labelled(spark, d), O.cues, "utt_id bigint, no int, s bigint, e bigint, text string")


@add("merge_short_cues", "WITH RECURSIVE " + CTE[len("\nWITH ") :] + """, x AS (SELECT job_id, s, e, speaker, text, row_number() OVER (PARTITION BY job_id ORDER BY s, utt_idx, utt_id) AS k FROM u WHERE e > s AND text IS NOT NULL),
f AS (SELECT job_id, k, s, e, speaker, text, 0 AS no FROM x WHERE k = 1 UNION ALL SELECT job_id, k, CASE WHEN m THEN s0 ELSE s END, e, speaker, CASE WHEN m THEN text0 || CASE WHEN text0 <> '' AND contains('。？！?!、，,', right(text0, 1)) THEN '' ELSE '　' END || text ELSE text END, CASE WHEN m THEN no ELSE no + 1 END
FROM (SELECT x.job_id, x.k, x.s, x.e, x.speaker, x.text, f.s AS s0, f.text AS text0, f.no, (f.e - f.s < 1000 OR x.e - x.s < 1000) AND length(regexp_replace(f.text || x.text, '^[\\s\\x0B　]+|[\\s\\x0B　]+$', '', 'g')) <= 40 AND x.e - f.s <= 7800 AND f.speaker IS NOT DISTINCT FROM x.speaker AND x.s - f.e < 1000 AS m FROM f JOIN x ON x.job_id = f.job_id AND x.k = f.k + 1))
SELECT job_id, arg_max(s, k) AS s, arg_max(e, k) AS e, any_value(speaker) AS speaker, arg_max(text, k) AS text FROM f GROUP BY job_id, no""")
def merge_short_cues(spark, d):
    """Utterances as cues, of which short neighbours of one speaker are one."""
    rows = utts(spark, d).where("e > s AND text IS NOT NULL").select("job_id", "utt_idx", "utt_id", F.col("s").alias("_s"), "s", "e", "speaker", "text")
    return sequence.merged_cues(rows, ["job_id"], ["_s", "utt_idx", "utt_id"])


_CLASS = "CASE WHEN regexp_matches({0}, '^[\u3040-\u309f]') THEN 'hira' WHEN regexp_matches({0}, '^[\u30a0-\u30ff]') THEN 'kata' WHEN regexp_matches({0}, '^[\u4e00-\u9fff々〆]') THEN 'kanji' WHEN regexp_matches({0}, '^[0-9０-９]') THEN 'digit' WHEN regexp_matches({0}, '^[A-Za-z]') THEN 'alpha' ELSE 'other' END"


@add("wrap_lines", CTE + f""", t AS (SELECT utt_id, trim(text, ' ') AS t FROM u WHERE text IS NOT NULL), p AS (SELECT utt_id, t, unnest(range(1, greatest(length(t), 2))) AS i FROM t WHERE length(t) > 20),
k AS (SELECT *, substr(t, i, 1) AS a, substr(t, i + 1, 1) AS b, length(trim(substr(t, 1, i), ' ')) AS head, length(trim(substr(t, i + 1), ' ')) AS rest FROM p), c AS (SELECT *, {_CLASS.format("a")} AS ka, {_CLASS.format("b")} AS kb FROM k WHERE head <= 24 AND rest <= 24),
z AS (SELECT *, abs(i - length(t) / 2) + 3 * (greatest(0, head - 20) + greatest(0, rest - 20)) + CASE WHEN ka = kb AND ka IN ('kata', 'digit', 'alpha') THEN 8 WHEN ka = kb AND ka = 'kanji' THEN 3 WHEN contains('をはがでにとへもや', a) AND kb <> 'hira' THEN -3 ELSE 0 END
+ CASE WHEN b IN ('　', ' ') THEN -8 WHEN contains('。？！?!', a) THEN -10 WHEN contains('、，,', a) THEN -6 WHEN a IN ('　', ' ') THEN -4 ELSE 0 END AS score FROM c),
m AS (SELECT utt_id, arg_min(i, (score, i)) AS i FROM z GROUP BY utt_id), o AS (SELECT utt_id, t, coalesce(i, length(t) // 2) AS i FROM t LEFT JOIN m USING (utt_id))
SELECT utt_id, CASE WHEN length(t) <= 20 THEN t ELSE trim(substr(t, 1, i), ' ') || chr(10) || trim(substr(t, i + 1), ' ') END AS shown FROM o""")
def wrap_lines(spark, d):
    """Texts in two lines of twenty characters, parted at the best place."""
    return utts(spark, d).where("text IS NOT NULL").select("utt_id", X.wrapped(F.col("text"), 20).alias("shown"))


@add("punctuate")
def punctuate(spark, d):
    """Texts made from the words alone, marks put in by pauses."""
    return O.flat_map(_labelled(spark, d), lambda r: [(r["utt_id"], O.punctuated([w | {"word": w["word"].rstrip(O.MARKS + O.COMMAS)} for w in r["words"]]))], "utt_id bigint, text string")


@add("remove_fillers")
def remove_fillers(spark, d):
    rows = utts(spark, d).select("utt_id", "text")
    return O.flat_map(rows, lambda r: [(r["utt_id"], *O.without_fillers(r["text"]))], "utt_id bigint, text string, removed int")


@add("remove_word_fillers")
def remove_word_fillers(spark, d):
    """Words without hesitations, their times and probabilities kept; utterances of nothing else give no row."""
    order = F.array_sort(F.collect_list(F.struct("word_idx", "s", "e", "word", "prob")))
    rows = words(spark, d).groupBy("utt_id").agg(order.alias("words"))

    def run(row):
        kept, n = O.words_without_fillers(row["words"])
        return [(row["utt_id"], w["word_idx"], w["s"], w["e"], w["word"], w["prob"], n) for w in kept]

    return O.flat_map(rows, run, "utt_id bigint, word_idx int, s bigint, e bigint, word string, prob double, removed int")


def _edited(spark, d):
    """Marked texts as what stood before, texts as what stands now."""
    return utts(spark, d).where("text IS NOT NULL AND marked IS NOT NULL").select("utt_id", X.strip_marks(F.col("marked")).alias("old"), "text")


@add("learn_from_diff")
def learn_from_diff(spark, d):
    """Corrections that show between two versions and may be learned, with how often each was seen."""
    changed = lambda r: [(a.strip(), b.strip()) for tag, a, b in D.steps(r["old"], r["text"]) if tag == "replace"]
    found = O.flat_map(_edited(spark, d).where("old != text"), changed, "wrong string, right string").where(X.learnable(F.col("wrong"), F.col("right")))
    return found.groupBy("wrong", "right").agg(F.count(F.lit(1)).alias("count"))


@add("remember_context")
def remember_context(spark, d):
    """Corrections kept whole with their context, each once."""
    rows = _edited(spark, d).where("old != text AND length(old) <= 300 AND length(text) <= 300")
    return O.flat_map(rows, lambda r: [(r["old"], r["text"])] if D.worth_keeping(r["old"], r["text"]) else [], "before string, after string").distinct()


@add("mark_corrections")
def mark_corrections(spark, d):
    new = lambda r: "".join(b if tag == "equal" or not b else RED_OPEN + b + RED_CLOSE for tag, _, b in D.steps(r["old"], r["text"]))
    return O.flat_map(_edited(spark, d), lambda r: [(r["utt_id"], new(r))], "utt_id bigint, marked string")


@add("proofread_drops")
def proofread_drops(spark, d):
    """Whether the marked text, as a correction of the text, leaves out what was said."""
    return O.flat_map(_edited(spark, d), lambda r: [(r["utt_id"], D.drops_content(r["text"], r["old"]))], "utt_id bigint, drops boolean")


@add("align_words")
def align_words(spark, d):
    """The words of each text with their times, taken over from the recogniser's words where the text was edited."""
    parts = words(spark, d).where("s IS NOT NULL AND e IS NOT NULL").groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "s", "e", "word"))).alias("words"))
    rows = utts(spark, d).select("utt_id", "s", "e", "text").join(parts, "utt_id", "left")
    run = lambda r: [(r["utt_id"], i, *x) for i, x in enumerate(D.aligned(r["words"] or [], r["text"], r["s"], r["e"]))]
    return O.flat_map(rows, run, "utt_id bigint, no int, word string, s double, e double")


@add("report_delta")
def report_delta(spark, d):
    """Two versions of each text side by side: what went and what came."""
    return O.flat_map(_edited(spark, d).where("old != text"), lambda r: [(r["utt_id"], D.delta_html(r["old"], r["text"]))], "utt_id bigint, html string")
