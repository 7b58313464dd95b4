import zlib

import numpy as np

from talkgrid.llm.pii import TAGS, Field, found_mentions, personal_information, redacted, trained
from talkgrid.llm.pii_table import labelled
from tests.helpers import rows


def accuracy(field, held):
    hit = wrong = missed = 0
    for (_, gold), got in zip(held, field.mentions([t for t, _ in held])):
        hit += len(set(gold) & set(got))
        wrong += len(set(got) - set(gold))
        missed += len(set(gold) - set(got))
    return hit / (hit + wrong), hit / (hit + missed)


def test_held_out_sentences():
    """No sentence of the held-out fifth is among those that the field is trained on."""
    apart = lambda s: zlib.crc32(s.encode()) % 5 == 0
    precision, recall = accuracy(Field().fit(labelled(chosen=lambda s: not apart(s))), labelled(copies=4, seed=99, chosen=apart))
    print("held-out sentences", precision, recall)
    assert precision > 0.9 and recall > 0.85


def test_held_out_language():
    """A whole language is left out: its names, numbers and addresses are met for the first time."""
    apart = lambda s: "{es_" in s or "{_s}" in s
    precision, recall = accuracy(Field().fit(labelled(chosen=lambda s: not apart(s))), labelled(copies=4, seed=99, chosen=apart))
    print("held-out language", precision, recall)
    assert precision > 0.6 and recall > 0.6


def test_viterbi_and_gradients_match_enumeration():
    rng = np.random.default_rng(0)
    f = Field()
    f.moves = rng.normal(size=f.moves.shape).astype(np.float32)
    scores, lengths = rng.normal(size=(3, len(TAGS))).astype(np.float32), np.array([3])
    move, best, total, expected = f.transitions().astype(float), (-1e9, None), 0.0, np.zeros((3, len(TAGS)))
    for a in range(len(TAGS)):
        for b in range(len(TAGS)):
            for c in range(len(TAGS)):
                if not f.first[a] or not f.allowed[a, b] or not f.allowed[b, c]:
                    continue
                s = scores[0, a] + scores[1, b] + scores[2, c] + move[a, b] + move[b, c]
                best = max(best, (s, (a, b, c)))
                w = np.exp(s)
                total += w
                for j, t in enumerate((a, b, c)):
                    expected[j, t] += w
    assert tuple(f.viterbi(scores, lengths)) == best[1]
    gold = np.array(best[1])
    diff, _ = f.gradients(scores, lengths, gold)
    want = -expected / total
    want[np.arange(3), gold] += 1
    assert np.allclose(diff, want, atol=1e-4)


def test_placeholders_keep_the_rest(spark):
    data = [
        (1, "電話は03-1234-5678です。次に、予算の話をします。", None, 1), (1, "電話は03-1234-5678です。次に、予算の話をします。", None, 2), (2, None, "Please send it to jane@example.net.", 1), (3, "", " ", 1),
        (4, "会議室8-8-8に移りました。注文番号1234 5678 9012は出荷済みです。", None, 1),
    ]
    got = {(r.utt_id, r.field): r for r in personal_information(spark.createDataFrame(data, "utt_id long, text string, memo string, received_at int")).collect()}
    assert got[1, "text"].redacted == "電話は[PHONE]です。次に、予算の話をします。" and got[1, "text"].mentions[0].value == "03-1234-5678"
    assert got[2, "memo"].redacted == "Please send it to [EMAIL]." and (2, "text") not in got
    assert got[3, "text"].redacted == "" and got[3, "memo"].redacted == " " and got[4, "text"].mentions == []


def test_extra_columns_and_long_text(spark):
    text = "次に、予算の話をします。" * 3000 + "メールはjane@example.netです。"
    df = spark.createDataFrame([(text, "x"), (None, "y")], "t string, mention string")
    got = rows(found_mentions(df, "t"))
    assert next(r for r in got if r[0] is None)[2:] == ([], None)
    long = next(r for r in got if r[0])
    assert [m.value for m in long[2]] == ["jane@example.net"] and redacted("ab", [(0, 1, "name")]) == "[NAME]b"
