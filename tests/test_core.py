import json
import os
import random

import pytest
from pyspark.sql import functions as F

from talkgrid.functions import clock, text as X
from talkgrid.operators import cues, documents as D, sequence, vectors
from talkgrid.operators.intervals import IntervalMap, periods_and_gaps
from talkgrid.sources import jobs
from tests.helpers import rows


def brute(spans):
    out = []
    for s, e in sorted(x for x in spans if x[0] is not None and x[1] is not None and x[1] > x[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_interval_map_matches_a_sort():
    r = random.Random(1)
    for _ in range(200):
        spans = [(a, a + r.randint(-2, 12)) for a in (r.randint(0, 60) for _ in range(r.randint(0, 25)))]
        m = IntervalMap()
        for s, e in spans:
            m.insert(s, e)
        assert list(m.periods()) == brute(spans)
        assert list(m.gaps()) == [(a[1], b[0]) for a, b in zip(brute(spans), brute(spans)[1:])]


@pytest.mark.parametrize("slot", [7, 1000])
def test_periods_and_gaps(spark, slot):
    r = random.Random(slot)
    data = [(k, a, b) for k in ("x", "y", None) for a, b in ((r.randint(-50, 400), r.randint(-50, 400)) for _ in range(60))] + [("x", None, 3), ("x", 3, None), ("z", 5, 5)]
    df = spark.createDataFrame(data * 2, "k string, s long, e long").withColumn("kind", F.lit("clash"))
    got = rows(periods_and_gaps(df, ["k"], "s", "e", slot))
    want = []
    for k in ("x", "y", None):
        p = brute([(a, b) for q, a, b in data if q == k])
        want += [(k, "period", *x) for x in p] + [(k, "gap", a[1], b[0]) for a, b in zip(p, p[1:])]
    assert got == sorted(want, key=repr)
    assert rows(periods_and_gaps(df.limit(0), ["k"], "s", "e")) == []


def test_clock(spark):
    df = spark.createDataFrame([(0,), (3_723_004,), (-5,), (None,), (360_000_000,)], "ms long")
    got = [tuple(r) for r in df.select(clock.hms(F.col("ms")), clock.cue_time(F.col("ms")), clock.duration_text(F.col("ms"))).collect()]
    assert got[:3] == [("00:00:00", "00:00:00,000", "0秒"), ("01:02:03", "01:02:03,004", "1時間2分3秒"), ("00:00:00", "00:00:00,000", "0秒")]
    texts = spark.createDataFrame([("1:02:03.5",), ("2:03",), ("7,25",), ("x",), ("",), (None,), ("1:2:3:4",)], "t string")
    assert [r[0] for r in texts.select(clock.parse_seconds(F.col("t"))).collect()] == [3723.5, 123.0, 7.25, None, None, None, None]


def test_text_functions(spark):
    red = X.RED_OPEN + "{}" + X.RED_CLOSE
    df = spark.createDataFrame([("aXb", "a" + red.format("X") + "b", None), ("aXb", "a" + red.format("Xb"), True), (None, None, None)], "t string, m string, p boolean")
    new, marked = X.replaced(F.col("t"), F.col("m"), "Xb", "YY")
    assert [tuple(r) for r in df.select(new, marked, X.needs_review(F.col("m"), F.col("p"))).collect()][:2] == [("aYY", "aYY", True), ("aYY", "a" + red.format("YY"), True)]
    got = df.select(X.escape_keep_red(F.lit("<b>" + red.format("x"))), X.occurrences(F.lit("aaaa"), "aa"), X.strip_marks(F.col("m"))).first()
    assert tuple(got) == ("&lt;b&gt;" + red.format("x"), 2, "aXb")


def test_sessions_of_words(spark):
    data = [(1, 1, i, s, s + 500, w, who) for i, (s, w, who) in enumerate([(0, "a", "A"), (600, "b。", "A"), (50_000, "c", "A"), (50_600, "d", "B"), (51_200, "e", "A")])]
    df = spark.createDataFrame(data, "job_id long, utt_id long, word_idx int, s long, e long, word string, speaker string")
    assert [r[1:] for r in rows(sequence.built_utterances(df))] == [(0, "A", 0, 1100, 2), (1, "A", 50000, 50500, 1), (2, "B", 50600, 51100, 1), (3, "A", 51200, 51700, 1)]
    assert rows(sequence.built_utterances(df.limit(0))) == []


def test_nearest_turn(spark):
    turns = spark.createDataFrame([(1, 0, 10, "a"), (1, 20, 30, "b"), (1, 40, 50, "")], "j long, s long, e long, speaker string")
    points = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 14, 15, 16, 25, 99])] + [(2, 9, 5)], "j long, id long, t long")
    got = {i: s for _, i, s in rows(sequence.nearest_turn(points, turns, ["j"]))}
    assert got == {0: "a", 1: "a", 2: "a", 3: "b", 4: "b", 5: "b", 9: None}


def test_smoothing_and_cues():
    word = lambda s, e, label, text="x": {"s": s, "e": e, "label": label, "word": text}
    ws = [word(0, 900, "a"), word(900, 1100, "b"), word(1100, 1300, "c"), word(1300, 2500, "a")]
    assert cues.sentence_rows({"utt_id": 1, "s": 0, "e": 100, "text": "あ。い！。"}) == [(1, 0, 0, 40, "あ。"), (1, 1, 40, 80, "い！。")]
    assert cues.sentence_rows({"utt_id": 1, "s": None, "e": 3, "text": " "}) == [] and cues.sentence_rows({"utt_id": 1, "s": 0, "e": 1, "text": None}) == []
    made = cues.cues({"utt_id": 1, "words": [word(i * 500, i * 500 + 400, "a", "言葉です、") for i in range(20)]})
    assert "".join(c[4] for c in made) == "言葉です、" * 20 and all(len(c[4]) <= 40 for c in made)
    assert cues.without_fillers("えー、そうですね、えーと。") == ("そうですね。", 2) and cues.without_fillers(None) == (None, 0)
    said = [{"word": w, "s": i} for i, w in enumerate(["え", "ー", "と、", "そう、", "あー", "。", "はい", "うー", "ん"])]
    assert cues.words_without_fillers(said) == ([{"word": "そう", "s": 3}, {"word": "。", "s": 5}, {"word": "はい", "s": 6}], 3)
    assert cues.words_without_fillers([{"word": "えー、"}]) == ([], 1) and cues.without_fillers("答えー、へえー、じゃあー") == ("答えー、へえー、じゃあー", 0)


def test_vectors(spark):
    people = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0])], "person string, embedding array<float>")
    probes = spark.createDataFrame([(1, [3.0, 0.1]), (2, [0.1, 1.0])], "probe long, embedding array<float>")
    assert [(r.probe, r.person) for r in vectors.best(vectors.similarities(probes, people), 1).orderBy("probe").collect()] == [(1, "a"), (2, "b")]
    scores = spark.createDataFrame([(1, 0, "a", 0.9), (1, 1, "a", 0.85), (1, 1, "b", 0.6), (1, 2, "b", 0.31), (2, 0, "a", 0.55), (2, 0, "b", 0.5)], "job long, cluster long, person string, score double")
    assert rows(vectors.assign_names(scores)) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "話者A"), (2, 0, "話者A")]


def test_job_folders(spark, tmp_path):
    utt = {"start": 0, "end": 1, "speaker": "A", "text": "x", "marked": "x", "words": []}
    jobs.publish(str(tmp_path), "done", {"utterances.json": json.dumps({"source": "s", "utterances": [utt]}), "a.md": "# a"})
    jobs.publish(str(tmp_path), "half", {"checkpoint.json": json.dumps({"segments": [{"start": 0, "end": 2, "text": "y", "words": []}]})})
    jobs.publish(str(tmp_path), "done", {"checkpoint.json": json.dumps({"segments": []})})
    got = rows(jobs.exploded_utterances(jobs.read_jobs(spark, str(tmp_path))).select("job_dir", "incomplete", "speaker", "text", "human"))
    assert got == [("done", False, "A", "x", False), ("half", True, "", "y", False)]
    assert rows(jobs.read_texts(spark, str(tmp_path), "*.md")) == [("done", "a.md", "# a")]
    assert sorted(os.listdir(tmp_path / "done")) == ["a.md", "checkpoint.json", "utterances.json"]
    assert jobs.merged_settings({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "d": None, "e": 1}) == {"a": {"b": 5, "c": 2}, "d": 3, "e": 1}
    assert jobs.read_settings(str(tmp_path / "none.json"), {"a": 1}) == {"a": 1}


def test_every_query_is_registered_once():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_identify_ranks_everyone(spark, tmp_path):
    from __spark_entry__ import queries

    n = 1030
    data = [(i, str(i), [float(i % 7 + 1), float(i % 11), 1.0]) for i in range(n)]
    spark.createDataFrame(data, "vec_id long, label string, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    probes = len(range(0, n, 100))
    assert queries()["identify"](spark, str(tmp_path)).groupBy("probe").agg(F.count("person"), F.max("rank")).distinct().select("count(person)", "max(rank)").distinct().collect() == [(n, n)]
    assert queries()["voice_decision"](spark, str(tmp_path)).count() == probes * n


def test_edits_replies_and_quotes(spark):
    rows_ = spark.createDataFrame([(1, 0, "a", False), (1, 1, "b", True), (2, 0, "c", None), (3, 0, "d", None)], "job_id long, utt_idx int, text string, human boolean")
    edits = spark.createDataFrame([(1, 0, "a", "A"), (1, 1, "b", ""), (2, 0, "c", "C"), (2, 0, "c", "D")], "job_id long, utt_idx int, shown string, new string")
    assert rows(D.edits_applied(rows_, edits)) == [(1, 0, "A", True, None), (2, 0, "c", False, "twice"), (3, 0, "d", False, None)]
    said = spark.createDataFrame([(1, 1, "Ada", "会議は10時です"), (1, 2, None, "今日はここまでです"), (1, 3, "", "結論は未定です")], "id long, no long, speaker string, text string")
    reply = spark.createDataFrame([(1, "[1] Ada: 会議は11時です\n[1] Ada：会議は１０時です。\n x\n[2] 今\n[3] 結論です\n[9] y")], "id long, reply string")
    assert rows(D.accepted_replies(said, reply)) == [(1, 1, True), (1, 2, False), (1, 3, False)]
    quotes = spark.createDataFrame([(1, 1, 5, "私がすぐに送ります", "Ada"), (2, 1, 5, "すぐに送ります", "Ada"), (3, 1, 6, "私がすぐに送ります", None), (4, 1, 5, "すぐ", None)], "item_id long, job_id long, stamp long, quote string, claimed string")
    lines_ = spark.createDataFrame([(1, 5, "Ada", "はい、私がすぐに送ります。"), (1, 5, "Bob", "私がすぐに送ります")], "job_id long, stamp long, speaker string, text string")
    assert rows(D.supported_quotes(quotes, lines_)) == [(1, 2, True), (2, 2, False), (3, 0, False), (4, 2, False)]


def test_slots_change_nothing(spark):
    r = random.Random(3)
    spans = [(r.choice((1, 2, None)), a, a + r.randint(-2, 30)) for a in (r.randint(0, 900) for _ in range(200))]
    df = spark.createDataFrame(spans, "job_id long, s long, e long")
    for tolerance in (0, 7):
        assert rows(sequence.merged_in_slots(df, ["job_id"], tolerance, 50)) == rows(sequence.merged_spans(df.where("e > s"), ["job_id"], tolerance))
    points = spark.createDataFrame([(1, i, r.randint(-50, 1000)) for i in range(150)], "job_id long, id long, t long")
    turns = spark.createDataFrame([(1, a, a + r.randint(1, 40), r.choice("abc")) for a in (r.randint(0, 900) for _ in range(12))], "job_id long, s long, e long, speaker string")
    assert rows(sequence.nearest_turn(points, turns, ["job_id"], 60)) == rows(sequence.nearest_turn(points, turns, ["job_id"], 10**9))


def test_quotes_meet_other_lines_and_fail(spark, tmp_path):
    from __spark_entry__ import queries

    said = "we agreed on the budget of May and left"
    data = [(1, 7, 0, 1.2, "nothing of the kind", said), (2, 7, 1, 1.9, "so " + said, None), (3, 8, 0, 1.2, said, "x" * 30), (4, 7, 2, 5.0, said, said), (5, 7, 3, 9.0, "something else", said), (6, 7, 4, None, said, said)]
    full = [(i, j, 1, n, s, s, "A", text, marked, None, None, None, None) for i, j, n, s, text, marked in data]
    schema = "utt_id long, job_id long, series_id long, utt_idx long, start double, end double, speaker string, text string, marked string, memo string, human boolean, proofread string, proofread_pending boolean"
    spark.createDataFrame(full + full[:1], schema).write.parquet(str(tmp_path / "utterances.parquet"))
    assert rows(queries()["quote_support"](spark, str(tmp_path))) == [(1, 1, True), (3, 0, False), (4, 1, False), (5, 0, False)]


def test_registers_locks_and_pauses(spark, tmp_path):
    from talkgrid.sources import registers as G

    people = spark.createDataFrame([("高橋 花", ["花", "hana"], None), ("Bob", [], "chair")], G.PEOPLE)
    path = str(tmp_path / "profiles" / "people.yaml")
    os.makedirs(tmp_path / "profiles")
    G.save_people(people, path)
    assert rows(G.read_people(spark, path)) == rows(people)
    G.save_corrections(spark.createDataFrame([("a", "b", 2)], G.CORRECTIONS), path)
    assert rows(G.read_corrections(spark, path)) == [("a", "b", 2)] and rows(G.read_people(spark, path)) == []
    G.save_glossary(spark.createDataFrame([(" x ",), ("",), (None,)], "term string"), path)
    assert rows(G.read_glossary(spark, path)) == [("x",)]
    (tmp_path / "bad.yaml").write_text("people: [1, {display_name: A, aliases: b}]\nexamples: [{before: x, after: 1}, {before: x, after: y}]\n")
    assert rows(G.read_people(spark, str(tmp_path / "bad.yaml"))) == [("A", [], None)] and rows(G.read_examples(spark, str(tmp_path / "bad.yaml"))) == [("x", "y")]
    assert rows(G.read_people(spark, str(tmp_path / "none.yaml"))) == []
    with G.job_lock(str(tmp_path)):
        with pytest.raises(G.JobBusy), G.job_lock(str(tmp_path)):
            pass
    with G.job_lock(str(tmp_path)):
        pass
    assert not G.pause_requested(str(tmp_path)) and not G.stop_if_asked(None, str(tmp_path))
    query = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    G.request_pause(str(tmp_path))
    assert G.stop_if_asked(query, str(tmp_path)) and not query.isActive and not G.pause_requested(str(tmp_path))


def test_differences():
    from talkgrid.operators import difference as X2

    assert X2.drops_content("えーと、予算の話を続けます。", "予算の話を続けます。") is False and X2.drops_content("結論は来週の会議で決めます。", "結論は。") and not X2.drops_content(None, "")
    assert X2.worth_keeping("家電します", "架電します") and not X2.worth_keeping("a", "a") and not X2.worth_keeping("abc", "xyz") and not X2.worth_keeping("", "x")
    assert X2.acceptable_fix("- 予算を確認する（根拠 00:01:02）", "- 予算を再確認する（根拠 00:01:02）") and not X2.acceptable_fix("- 予算（根拠 00:01:02）", "- 予算（根拠 00:01:03）")
    assert not X2.acceptable_fix("| a | b |", "a b") and not X2.acceptable_fix("予算を確認する", "会場を予約する", ("会場を予約する",)) and not X2.acceptable_fix("abc", " ")
    words = [{"word": "予算", "s": 0, "e": 200}, {"word": "の話", "s": 200, "e": 400}]
    assert X2.aligned(words, "予算の話", 0, 400) == [("予算", 0, 200), ("の話", 200, 400)]
    assert X2.aligned(words, "予山の話", 0, 400) == [("予", 0, 100), ("山", 100, 200), ("の", 200, 300), ("話", 300, 400)]
    assert X2.aligned([], " x ", 1, 2) == [("x", 1, 2)] and X2.aligned([], None, 1, 2) == [] and X2.aligned(words, "ー予算の話", 0, 400)[0] == ("ー", 0, 0)
    assert X2.delta_html("a<b", "a>b") == "a<del>&lt;</del><ins>&gt;</ins>b" and X2.delta_html(None, "x") == "<ins>x</ins>"


def test_speakers_are_counted_and_clustered(spark):
    import numpy as np
    from talkgrid.operators import models

    rng = np.random.default_rng(2)
    for count in (2, 3, 5):
        centres = np.linalg.qr(rng.normal(size=(32, 8)))[0].T[:count]
        truth = np.repeat(np.arange(count), 40)
        v = centres[truth] + 0.05 * rng.normal(size=(len(truth), 32))
        got = models.clustered(v)
        assert len(set(got)) == count and all(len(set(got[truth == k])) == 1 for k in range(count))
    assert models.clustered(np.zeros((0, 4))).tolist() == [] and models.clustered(np.ones((3, 4))).tolist() == [0, 0, 0]
    df = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(v)], "job long, clip long, embedding array<double>")
    found = models.clusters_of_jobs(df).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in found) == [40] * 5
