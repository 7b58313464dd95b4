import random

from talkgrid.llm.spans import shared_parts, shared_spans
from tests.helpers import rows


def brute(texts, least):
    grams = {}
    for d, t in texts.items():
        for i in range(len(t or "") - least + 1):
            grams.setdefault(t[i : i + least], {}).setdefault(d, set()).add(i)
    pairs = {(a, b) for v in grams.values() for a in v for b in v if a < b}
    cover = {d: set() for d in texts}
    for v in grams.values():
        if len(v) > 1:
            for d, at in v.items():
                cover[d] |= {k for i in at for k in range(i, i + least)}
    return pairs, {d: len(c) for d, c in cover.items()}


def test_pairs_and_parts_match_brute_force(spark):
    r = random.Random(7)
    word = lambda n, letters="abcdefgh 会議予算": "".join(r.choice(letters) for _ in range(n))
    hot, cores = word(150), [word(r.randint(190, 420)) for _ in range(6)]
    texts = {}
    for d in range(150):
        parts = [word(r.randint(0, 120))]
        if r.random() < 0.6:
            parts += [hot, word(r.randint(0, 90))]
        if r.random() < 0.5:
            parts += [r.choice(cores), word(40)]
        texts[d] = "".join(parts)
    texts |= {200: None, 201: "", 202: "=" * 500, 203: "x" + "=" * 300 + "y", 204: texts[3], 205: cores[0] + cores[1], 206: cores[0] + "?" + cores[1]}
    df = spark.createDataFrame([(d, t, "z") for d, t in texts.items()] + [(3, texts[3], "z")], "doc_id long, text string, doc_a string")
    pairs, cover = brute(texts, 200)
    for block in (8, 64):
        found = shared_spans(df, block=block)
        got = {(a, b) for a, b in found.select("doc_a", "doc_b").collect()}
        assert got == pairs
        for x in found.collect():
            assert texts[x.doc_a][x.from_a : x.to_a] == texts[x.doc_b][x.from_b : x.to_b] and x.to_a - x.from_a >= 200
    parts = {x.doc_id: (x.n_chars, x.shared_chars) for x in shared_parts(df, shared_spans(df)).collect()}
    assert parts[200] == (None, None) and parts[201] == (0, 0)
    assert all(parts[d][1] == cover[d] for d in texts if texts[d] and d != 202 and d != 203)


def test_unequal_repetitions_inside_shared_text(spark):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefgh 会議予算") for _ in range(n))
    texts, units = {}, ["-", "はい", "ご視聴", "thank you ", "a phrase of thirty letters....", "twenty-nine letters and a dot."]
    for k, unit in enumerate(units):
        head, tail = word(400), word(400)
        texts |= {10 * k: head + unit * 150 + tail, 10 * k + 1: head + unit * 190 + tail, 10 * k + 2: word(50) + unit * 170 + word(50)}
        # The shared run is hardly longer than the repetition, and begins or ends at another place of the unit.
        line = unit * 400
        texts |= {10 * k + 3: word(40) + line[3:203] + word(40), 10 * k + 4: word(40) + line[1:194] + tail[:12] + word(40), 10 * k + 5: word(40) + line[2:900] + tail[:12] + word(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs, cover = brute(texts, 200)
    assert all((10 * k, 10 * k + 1) in pairs for k in range(len(units)))
    for block in (8, 64, 4096):
        found = shared_spans(df, block=block).collect()
        assert {(x.doc_a, x.doc_b) for x in found} == pairs
        assert all(texts[x.doc_a][x.from_a : x.to_a] == texts[x.doc_b][x.from_b : x.to_b] and x.to_a - x.from_a >= 200 for x in found)
    for block in (8, 1 << 30):
        assert {x.doc_id: x.shared_chars for x in shared_parts(df, shared_spans(df, block=block)).collect()} == cover


def test_parts_of_hot_passages_match_brute_force(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefgh 会議予算") for _ in range(n))
    long, short, sides = word(3000), word(150), [word(n) for n in (30, 90, 170)]
    texts = {}
    for d in range(40):
        parts = [word(r.randint(0, 90)), r.choice(sides), long, r.choice(sides)[::-1], word(r.randint(0, 90))]
        if d % 3 == 0:
            parts += [long, word(30)]  # twice in one document
        if d % 2:
            parts += [r.choice(sides), short, r.choice(sides), word(60), short, word(r.randint(0, 90))]
        texts[d] = "".join(parts)
    texts |= {50: "=" * 700, 51: "x" + "=" * 300 + "y" + word(99), 52: word(40) + "はい" * 101 + word(10), 53: word(9) + "はい" * 250 + word(10)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs, cover = brute(texts, 200)
    for block in (1, 8):
        spans = shared_spans(df, block=block)
        found = spans.collect()
        assert {(x.doc_a, x.doc_b) for x in found} == pairs
        assert all(texts[x.doc_a][x.from_a : x.to_a] == texts[x.doc_b][x.from_b : x.to_b] and x.to_a - x.from_a >= 200 for x in found)
        assert {x.doc_id: x.shared_chars for x in shared_parts(df, spans).collect()} == cover
        assert {(x.doc_a, x.doc_b) for x in shared_spans(df, block=block, cover=False).collect()} == pairs


def test_hot_passages_are_whole_and_few_rows(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh 会議予算") for _ in range(n))
    long, short = word(5000), word(210)
    texts = {d: word(r.randint(0, 60)) + long + word(r.randint(0, 60)) for d in range(70)} | {100 + d: word(r.randint(1, 60)) + short + word(r.randint(1, 60)) for d in range(100)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs, cover = brute(texts, 200)
    spans = shared_spans(df, pairs=False)
    assert {x.doc_id: x.shared_chars for x in shared_parts(df, spans).collect()} == cover
    assert min(cover[d] for d in range(70)) >= 5000
    assert spans.count() < 12 * len(texts)  # linear in the members
    found = shared_spans(df, cover=False).collect()
    assert {(x.doc_a, x.doc_b) for x in found} == pairs and len(found) < 2 * len(pairs)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows(shared_spans(df)) == [] and rows(shared_parts(df, shared_spans(df))) == []
