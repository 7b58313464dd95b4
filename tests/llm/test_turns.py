import random

from talkgrid.llm import turns
from talkgrid.llm.turns import analysed, automaton, speaker_turns
from tests.helpers import rows

A = automaton()


def read(text):
    whole, cut, _, looks, _ = analysed(text, A)
    return (cut if looks else whole), looks


def test_clean_text():
    cases = {
        "えー、(笑) 次に、予算です。": ("次に、予算です。", None),
        "um, uh…": ("", None), "[noise]": ("", None), "(00:12) [laughs]": ("", None), "<12.5> はい。": ("はい。", None), " ": ("", None), None: ("", None),
        "話者B： 了解です！": ("了解です！", "#b"), "Speaker A: yes": ("yes", "#a"), "Ada Lovelace: um, fine": ("fine", "n:ada lovelace"), "Kurz gesagt: die Sicherung läuft.": ("Kurz gesagt: die Sicherung läuft.", None),
        "The umbrella (see below) is her hum.": ("The umbrella (see below) is her hum.", None), "ええ、はい。": ("ええ、はい。", None), "the plan uhm works": ("the plan works", None),
    }
    for text, want in cases.items():
        assert read(text) == want, text


def test_turns_match_a_plain_loop(spark):
    rnd = random.Random(5)
    data = []
    for i in range(400):
        start = None if i % 97 == 0 else round(rnd.uniform(0, 5000), 3)
        data.append((i, i % 3, i, start, None if i % 5 else (start or 0) + 2.0, rnd.choice(["Ada Lovelace", "Ada Lovelace", "話者A", "speaker a", None, "?", ""]), rnd.choice(["hello there", "um…", "(笑)", None, "Grace Hopper: yes", "話者A：はい"])))
    df = spark.createDataFrame(data + data[:50], "utt_id long, job_id long, utt_idx int, start double, end double, speaker string, text string")
    people = spark.createDataFrame([(1, "Ada Lovelace", None)], "person_id long, display_name string, aliases array<string>")
    want, last = [], {}
    for u, j, x, s, _, who, text in sorted(data, key=lambda r: (r[1], -1e18 if r[3] is None else round(r[3] * 1000), r[2])):
        rest, head = read(text)
        if not rest:
            continue
        key = "p1" if who == "Ada Lovelace" else "#a" if who and "a" in who.lower()[-1:] or who == "話者A" else head or "unknown"
        if j in last and last[j][0] == key:
            want[last[j][1]][2] = u
        else:
            want.append([j, u, u])
            last[j] = (key, len(want) - 1)
    for slot in (60_000, 10**9):
        got = rows(speaker_turns(df, people, slot_ms=slot).select("job_id", "first_utt_id", "last_utt_id"))
        assert got == sorted(map(tuple, want), key=repr)
    assert rows(speaker_turns(df.limit(0), people)) == []


def test_labels_of_the_automaton_and_beyond(spark, monkeypatch):
    # A label of the automaton may hold a mark itself; without it the head ends at the first mark.
    assert analysed("(00:12) Ada: X: yes", automaton(["Ada: X"]))[1:3] == ("yes", "Ada: X") and analysed("(00:12) Ada: X: yes", A)[2] == "Ada"
    people = spark.createDataFrame([(1, "Ada Lovelace", ["countess"])], "person_id long, display_name string, aliases array<string>")
    data = [(1, 1, 1, 0.0, 1.0, None, "countess: yes"), (2, 1, 2, 1.0, 2.0, "Lovelace, Ada", "no"), (3, 1, 3, 2.0, 3.0, "countess", "so it is"), (4, 1, 4, 3.0, 4.0, None, "to sum up: no")]
    df = spark.createDataFrame(data, "utt_id long, job_id long, utt_idx int, start double, end double, speaker string, text string")
    want = [(1, 1, 3, "p1", 0, 3000, "yes no so it is"), (1, 4, 4, "unknown", 3000, 4000, "to sum up: no")]
    assert rows(speaker_turns(df, people)) == want
    monkeypatch.setattr(turns, "LABELS", 0)
    assert rows(speaker_turns(df, people)) == want


def test_labels_beyond_the_automaton_make_the_same_turns(spark, monkeypatch):
    # Marks, ends of sentences, brackets, blanks, letters of odd case, labels within labels, longer than any head.
    labels = ["Ada: X", "Ada: X: Y", "Who?", "Guest: ", "Guest", "Room > 2 ]", "İnci: ΣΟΦΟΣ", "Speaker: Speaker B", "L" * 60, "話者A：仮", "Dr. No!"]
    texts = ["(00:12) Ada: X: um, yes", "[ADA: X: Y ]: yes : no", "Ada: X ]]: no", "Who?> um, me", "Who?: (笑)", "guest: : a", "GUEST ] : b", "[Room > 2 ]: c", "İNCİ: σοφος: d", "speaker: speaker b: e", "speaker: f", "[speaker: g", "l" * 60 + ": h", "話者A：仮：はい", "話者A： um", "Dr. No!: 12:30 it is", "to sum up: i", "Ada: Y: j", "Ada:", "Room > 2 : k"]
    people = spark.createDataFrame([(1, "Who?", ["Ada: X", "Dr. No!"]), (2, "L" * 60, ["İnci: ΣΟΦΟΣ", "Guest"])], "person_id long, display_name string, aliases array<string>")
    data = [(i, 0, i, float(i), i + 1.0, None, text) for i, text in enumerate(texts)] + [(100 + i, 1, i, float(i), None, label, "yes") for i, label in enumerate(labels)]
    data += [(200 + i, 2 + i, 0, 0.0, 1.0, None, text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(data, "utt_id long, job_id long, utt_idx int, start double, end double, speaker string, text string")
    want = rows(speaker_turns(df, people))
    assert {(j, t[3], t[6]) for t in want if (j := t[0]) in (2, 5, 14)} == {(2, "p1", "yes"), (5, "p1", "me"), (14, "p2", "h")}
    monkeypatch.setattr(turns, "LABELS", 0)
    assert rows(speaker_turns(df, people)) == want
    assert rows(speaker_turns(df, people, with_text=False)) == sorted((t[:6] for t in want), key=repr)
