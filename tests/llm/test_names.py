import random

from talkgrid.llm import names
from talkgrid.llm.names import attached, linked_names
from tests.helpers import rows

PEOPLE = [
    (1, "槙尾崎 芙美", ["槙尾崎（ふみ）", "議長"], None), (2, "鹿苑田倫太郎", ["Rokuonda Rintaro"], None), (3, "Leopold Lindqvarn", None, "x"), (4, "Gabriele Lindqvarn", [], None), (5, "株式会社青嶺音響", ["Aomine Onkyo Co., Ltd.", "議長"], None),
    (6, "Makiozaki Fuml", [], None), (7, "星置 健吾", [" ", ""], None), (8, None, None, None),
]


SCHEMA = "person_id long, display_name string, aliases array<string>"


def who(spark, people, labels):
    df = spark.createDataFrame([(s, n) for s, n in labels.items()], "label string, n long")
    return {r.label: r.person_id for r in attached(df, spark.createDataFrame(people, SCHEMA)).collect() if r.label in labels}  # registered spellings come as well


def test_spellings_of_one_person(spark):
    same = {
        1: ["槙尾崎芙美", "槙尾﨑　芙美さん", "まきおざき ふみ", "マキオザキ・フミ", "MAKIOZAKI, Fumi", "Makiozkai Fumi", "F. Makiozaki", "makiozakifumi", "【槙尾崎芙美】", "槙尾崎部長"],
        2: ["鹿苑田 倫太郎", "Rintaro Rokuonda", "Rokunda Rintaro", "ろくおんだりんたろう"],
        3: ["LINDQVARN Leopold", "Leopold B. Lindqvarn", "Leo. Lindqvarn", "LW Lindqvarn", "Leopold Lindqvarnn", "Poldi Lindqvarn"],
        5: ["（株）青嶺音響", "青嶺音響 御中", "AomineOnkyo", "Aomine Onkyo K.K."],
        7: ["星置賢吾", "Hoshioki-san"],
    }
    nobody = ["Lindqvarn", "議長", "話者A", "Speaker B", "", " ", "不明", "?", "Cordula Brixen", "星置 透", "根小屋 耕作"]
    got = who(spark, [p[:3] for p in PEOPLE], {s: 1 for spellings in (*same.values(), nobody) for s in spellings})
    for person, spellings in same.items():
        for s in spellings:
            assert got.get(s) == person, s
    assert not [s for s in nobody if got.get(s) is not None]


def test_surnames_of_one_character(spark):
    people = [(1, "林 健吾", []), (2, "森 透", []), (3, "森 芙美", []), (4, "原", None), (5, "槙尾崎 東", [])]
    want = dict(zip(("林さん", "林", "林 健吾", "原さん", "森", "森さん", "森 透", "東", "J"), [1, 1, 1, 4, None, None, 2, None, None]))
    got = who(spark, people, dict.fromkeys(want, 1))
    assert {s: got.get(s) for s in want} == want


def test_posterior_over_all_candidates(spark):
    people = [p[:3] for p in PEOPLE]
    assert who(spark, people, {"星置健吾": 10, "Hoshioki Kenngo": 2}).get("Hoshioki Kenngo") == 7
    # A spelling that is frequent itself is a name of its own, and so is what varies it.
    assert who(spark, people, {"星置健吾": 10, "Hoshioki Kenngo": 500}).get("Hoshioki Kenngo") is None
    got = who(spark, people, {"Leopold Lindqvarn": 3, "Leopold Lindqvern": 900, "Leopold Lindqvernn": 1})
    assert got["Leopold Lindqvarn"] == 3 and got.get("Leopold Lindqvern") is None and got.get("Leopold Lindqvernn") is None


def test_rows_registered_more_than_once(spark):
    people = [(4, "Makiozaki Fumi", []), (9, "MAKIOZAKI, Fumi", []), (12, "Makiozaki Fuml", None), (13, "Fumi Makiozaki", ["Fu. Makiozaki"]), (20, "Fumi Makino", [])]
    got = who(spark, people, {s: 1 for s in ("Makiozaki Fumi", "Makiozaki Fuml", "Fumi Makiozaki", "F. Makiozaki", "F. Makino")})
    assert got == {"Makiozaki Fumi": 4, "Makiozaki Fuml": 4, "Fumi Makiozaki": 4, "F. Makiozaki": 4, "F. Makino": 20}


def test_a_large_register(spark):
    r = random.Random(1)
    part = lambda n: "".join(r.choice("bdgklmnprstvz") + r.choice("aeiou") for _ in range(n)).capitalize()
    people = [(i, f"{part(4)} {part(6)}", None) for i in range(2000)]
    labels = {}
    for i, name, _ in people[::50]:
        labels[name.upper()] = i
        labels[name[:9] + name[10:]] = i
    got = who(spark, people, dict.fromkeys(labels, 1))
    assert sum(got.get(s) == i for s, i in labels.items()) >= len(labels) - 1


def test_linked_names(spark):
    people = spark.createDataFrame(PEOPLE, "person_id long, display_name string, aliases array<string>, role string")
    utts = spark.createDataFrame([(1, 9, "F. Makiozaki"), (1, 9, "F. Makiozaki"), (2, 9, None), (3, 9, "話者A"), (4, 8, "Lindqvarn")], "utt_id long, job_id long, speaker string")
    got = rows(linked_names(utts, people))
    assert (9, "F. Makiozaki", 1) in got and (0, "Makiozaki Fuml", 1) in got and (0, "槙尾崎（ふみ）", 1) in got
    assert not any(s in ("議長", "Lindqvarn", "話者A", " ") for _, s, _ in got) and len(got) == len(set(got))
    assert rows(linked_names(utts.limit(0), people.limit(0))) == []
