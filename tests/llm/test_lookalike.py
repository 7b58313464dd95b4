import random
import unicodedata

from pyspark.sql import functions as F

from talkgrid.llm import lookalike
from tests.helpers import rows


def forms(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r.form for r in lookalike.canonical(spark, df, ["id"], "t").orderBy("id").collect()]


def test_equal_looks_have_one_form(spark):
    groups = [["がぎ", "がぎ", "ｶﾞ"[:0] + "がぎ​"], ["ﾃｽﾄ：ABC", "テスト:ＡＢＣ", "テス卜:АВС"], ["q̣́", "q̣́"], ["a b", "a  b", "a　b "], ["ﬁne…", "fine..."], ["データ", "デ一夕"], ["é", "é"]]
    for group in groups:
        assert len(set(forms(spark, group))) == 1, group


def test_different_looks_stay_apart(spark):
    texts = ["は", "ば", "ぱ", "A", "a", "0", "O", "x²", "x2", "①", "1", "㈱", "(株)", "ä", "a", "6", "9", None, ""]
    got = forms(spark, texts)
    assert len({g for t, g in zip(texts, got)}) == len(set(texts))
    assert got[-2] is None and got[-1] == ""


def test_pairs(spark):
    red = '<span style="color:red">{}</span>'
    data = [
        (1, 1, "Please sit down", "Please sit down", 1), (2, 1, "Pleаse sit down", None, 1), (3, 1, "Please sit down", "Please " + red.format("sіt") + " down", 1),
        (3, 1, "Please sit down", "Please " + red.format("sіt") + " down", 2), (4, 2, "Pleаse sit down", red.format("Please") + " sit up", 1), (5, 1, "short", "shоrt", 1), (6, 1, "shоrt", None, 1), (7, 1, None, "x", 1), (8, 1, "", None, 1),
    ]
    df = spark.createDataFrame(data, "utt_id long, job_id long, text string, marked string, received_at int")
    assert rows(lookalike.same_looks(df)) == [(1, 2), (2, 3), (3, 3), (5, 5)]
    assert rows(lookalike.same_looks(df.limit(0))) == []


def test_marks_are_ordered_and_composed_like_the_standard(spark):
    r = random.Random(4)
    letters = "aeqAuώυ한かはक" + "\u0301\u0323\u0308\u0304\u0327\u0345\u0342\u3099\u309a\u093c\u094d\u0e38\u0e48\u1112\u1161\u11ab\u09c7\u09be"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(400)]
    plain = lambda t: unicodedata.normalize("NFC", t)
    keep = [t for t in texts if all(lookalike._form(ord(c)) in (c, unicodedata.normalize("NFD", c)) for c in t)]
    for t, got in zip(keep, forms(spark, keep)):
        assert got == plain(t), (ascii(t), ascii(got))


def test_legible(spark):
    texts = ["エ場で努カする", "工場で努力する", "第ー回", "サ一バ一", "データ", "スカート", "ニ月", "ハロー", "駅へ", "一ヶ月", "う一ん、もうー点"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [x.form for x in lookalike.canonical(spark, df, ["id"], "t").select("id", lookalike.legible(F.col("form")).alias("form")).orderBy("id").collect()]
    assert got == ["工場で努力する", "工場で努力する", "第一回", "サーバー", "データ", "スカート", "二月", "ハロー", "駅へ", "一ヶ月", "うーん、もう一点"]


def test_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "BLOCK", 3)
    data = [(i, i % 2, "Please sit down" if i % 3 else "Pleаse sit down", None) for i in range(40)]
    df = spark.createDataFrame(data, "utt_id long, job_id long, text string, marked string")
    want = sorted((a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[1] == b[1] and a[2] != b[2])
    assert rows(lookalike.same_looks(df)) == sorted(want, key=repr)
