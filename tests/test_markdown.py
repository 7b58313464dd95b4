from pyspark.sql import functions as F

from talkgrid.operators import labels as L, markdown as M
from talkgrid.operators.documents import lines
from tests.helpers import rows


def one(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_clean_ups(spark):
    assert one(spark, M.fixed_ichi, "ー番だけどー緒にコーヒーとスー番", None, "もうー度") == ["一番だけど一緒にコーヒーとスー番", "", "もうー度"]
    assert one(spark, M.unfenced, "```md\n# a\nb\n```", "<think>x\ny</think>\nz", "plain", "```a") == ["# a\nb", "z", "plain", "```a"]
    assert one(spark, M.tidied, "a\n【見出し】\n日時: 今日\n\n\n\n- 項目: x", "") == ["a\n\n【見出し】\n\n日時: 今日  \n\n- 項目: x\n", "\n"]
    assert one(spark, lambda t: M.appended_mark(F.lit("- "), t, "？"), "本文  ", "| a | b |") == ["- 本文？", "| a？ | b |"]


def test_blocks(spark):
    text = "# t\n| a | b\\|c |\n|---|:---:|\n| 1 |\n| 2 | 3 | 4 |\n\n- [x] done\n* point\nplain | text\n---"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.kind, r.content, r.rows) for r in M.blocks(lines(df)).orderBy("doc_id", "no").collect()]
    assert got == [
        (1, "h1", "t", None), (1, "table", None, [["a", "b|c", ""], ["1", "", ""], ["2", "3", "4"]]), (1, "blank", "", None), (1, "check", "done", None), (1, "bullet", "point", None),
        (1, "text", "plain | text", None), (1, "text", "---", None), (2, "blank", "", None),
    ]
    assert rows(M.blocks(lines(df.limit(0)))) == []


def test_names_and_facts(spark):
    names = spark.createDataFrame([("高橋", "高橋 花"), ("高橋 花", "高橋 花"), ("橋本", "橋本 翔"), ("x", "長い名")], "alias string, display string")
    texts = spark.createDataFrame([(1, "高橋本と高橋 花と橋本", None), (2, "<b title=高橋>橋本</b>", "高橋"), (3, None, ""), (4, "x", "5")], "i int, t string, u string")
    assert rows(M.aliases_applied(texts, "i", ["t", "u"], names)) == [(1, "高橋 花本と高橋 花と橋本 翔", None), (2, "<b title=高橋>橋本 翔</b>", "高橋 花"), (3, None, ""), (4, "x", "5")]
    assert rows(M.names_found(texts, "i", "t", names)) == [(1, "橋本 翔"), (1, "高橋 花"), (2, "橋本 翔")]
    pairs = spark.createDataFrame([(1, "１２時", "12時"), (2, "12時", "13時"), (3, "高橋", "橋本"), (4, "しない", "する"), (5, "高橋", "高橋 花"), (6, "", "")], "i int, a string, b string")
    assert rows(M.facts_changed(pairs, "i", "a", "b", names)) == [(1, False), (2, True), (3, True), (4, True), (5, False), (6, False)]


def test_heads_of_words_and_marks(spark):
    data = [(1, 0, 0, 200, "エ", "b"), (1, 1, 9000, 9400, "ビデンス。", "a"), (1, 2, 9500, 9900, "ですけど。", "a"), (1, 3, 10000, 10400, "はい", "a")]
    words = spark.createDataFrame(data, "utt_id long, word_idx int, s long, e long, word string, label string")
    array = words.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "s", "e", "word", "label"))).alias("w"))
    got = array.select(F.explode(M.glued(F.col("w"))).alias("x")).select("x.*").orderBy("word_idx").first()
    assert tuple(got) == (0, 8800, 9000, "エ", "a")
    assert [r.word for r in M.repaired(words).orderBy("word_idx").collect()] == ["エ", "ビデンス。", "ですけど、", "はい"]


def test_labels_of_runs(spark):
    def labelled(*runs):
        out, t = [], 0
        for label, n, long in runs:
            for _ in range(n):
                out.append((1, len(out), t, t + long, "x", label))
                t += long
        return spark.createDataFrame(out, "utt_id long, word_idx int, s long, e long, word string, label string")

    read = lambda df: "".join(r.label or "-" for r in df.orderBy("word_idx").collect())
    assert read(L.without_flicker(labelled(("a", 3, 300), ("b", 1, 200), ("c", 1, 200), ("a", 3, 300)))) == "aaaaaaaa"
    assert read(L.without_flicker(labelled(("b", 1, 200), ("c", 1, 200), (None, 3, 400), ("b", 1, 100), ("a", 1, 900)))) == "cc---aa"
    assert read(L.without_single_windows(labelled(("a", 2, 1), ("b", 1, 1), ("a", 1, 1), ("b", 1, 1), ("a", 2, 1)))) == "aaaaaaa"
    assert read(L.snapped_edges(labelled(("b", 1, 200), ("a", 4, 300), ("c", 1, 300)))) == "aaaaaa" and read(L.snapped_edges(labelled(("b", 1, 200), ("a", 2, 300)))) == "baa"
    assert read(L.voted_phrases(labelled(("b", 1, 200), ("a", 4, 300), ("c", 1, 1600)))) == "cccccc" and read(L.voted_phrases(labelled(("a", 1, 200), ("b", 1, 200)))) == "aa"
    empty = labelled(("a", 1, 1)).limit(0)
    assert all(rows(f(empty)) == [] for f in (L.without_flicker, L.without_single_windows, L.snapped_edges, L.voted_phrases))
