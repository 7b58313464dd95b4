from talkgrid.llm import pieces
from tests.helpers import rows


def cover(got, text, max_size, overlap, unit):
    size = lambda t: len(t) if unit == "chars" else len(t.encode())
    assert got[0].from_char == 0 and got[-1].to_char == len(text)
    for a, b in zip(got, got[1:]):
        assert a.from_char < b.from_char <= a.to_char < b.to_char
        assert size(text[b.from_char : a.to_char]) <= overlap
    for p in got:
        assert p.text == text[p.from_char : p.to_char] and size(p.text) == p.size <= max_size


def test_pieces_cover_the_text_within_the_limit(spark):
    texts = ["今日は会議です。次に、予算の話をします！" * 40, "One short sentence. Then, another one of 3.5 parts… " * 30, "漢" * 2000, "a" * 999 + "é́" * 50, "word " * 400, "x\n" * 500, "ก" * 700]
    items = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)] * 2, "target string, item_id long, text string")
    for unit, most, overlap in (("chars", 120, 20), ("bytes", 100, 30), ("chars", 300, 0)):
        limits = spark.createDataFrame([("t", unit, most, overlap)], "target string, unit string, max_size long, overlap_size long")
        for chars in (64, 1 << 16):
            got = pieces.split_items(items, limits, range_chars=chars, halo=32).orderBy("item_id", "piece_no").collect()
            for i, text in enumerate(texts):
                cover([r for r in got if r.item_id == i], text, most, overlap, unit)


def test_cuts_after_sentences(spark):
    text = "First part is here. " * 3 + "Second part, still going, ends now. " + "Third."
    plan = pieces.lay_out(pieces.range_table(text, 0, len(text), "chars", 70)[1], len(text), len(text), 70, 0)
    assert [text[a:b] for a, b, _, _ in plan] == ["First part is here. " * 3, "Second part, still going, ends now. Third."]


def test_every_boundary_counts(spark):
    # Words of all lengths, so that boundaries stand anywhere; the overlap is near the limit, or far below it.
    texts = ["".join("ab"[i % 2] * (i * 7 % 23 + 1) + (". A" if i % 5 == 0 else ", " if i % 3 == 0 else " ") for i in range(400)), "会議の予算。" * 300, "漢" * 1500, "é" * 900]
    items = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "target string, item_id long, text string")
    for unit, most, overlap in (("bytes", 150, 120), ("chars", 400, 40), ("chars", 400, 7), ("bytes", 150, 149)):
        size = lambda t: len(t) if unit == "chars" else len(t.encode())  # noqa: B023, E731
        limits = spark.createDataFrame([("t", unit, most, overlap)], "target string, unit string, max_size long, overlap_size long")
        for chars in (64, 1 << 16):
            got = pieces.split_items(items, limits, range_chars=chars, halo=64).orderBy("item_id", "piece_no").collect()
            for i, text in enumerate(texts):
                kinds = {p: k for p, k in pieces.boundaries(text, 0, len(text))}
                clusters = {m.end() for m in pieces._CLUSTER.finditer(text)}
                mine = [r for r in got if r.item_id == i]
                cover(mine, text, most, overlap, unit)
                for n, (a, b) in enumerate(zip(mine, mine[1:])):
                    end, done = a.to_char, mine[n - 1].to_char if n else 0
                    reach = [p for p in range(max(a.from_char, done) + 1, len(text)) if size(text[a.from_char : p]) <= most]
                    for kind in (pieces.SENTENCE, pieces.CLAUSE):
                        if far := [p for p in reach if kinds.get(p, 0) >= kind and size(text[a.from_char : p]) > most / 2]:
                            assert end == far[-1]
                            break
                    room = lambda p: size(text[p : end + 1]) <= most  # noqa: B023, E731
                    back = [p for p in range(a.from_char + 1, end) if size(text[p:end]) <= overlap and room(p)]
                    words = [p for p in back if kinds.get(p, 0) >= pieces.WORD]
                    assert b.from_char == (words or [p for p in back if p in clusters or p in kinds] or [end])[0]


def test_nulls_small_and_unlimited_items_give_nothing(spark):
    items = spark.createDataFrame([("t", 1, None), ("t", 2, ""), ("t", 3, "short"), ("other", 4, "x" * 999)], "target string, item_id long, text string")
    limits = spark.createDataFrame([("t", "chars", 10, None), ("t2", "chars", 1, 0)], "target string, unit string, max_size long, overlap_size long")
    assert pieces.split_items(items, limits).count() == 0
    assert pieces.split_items(items.limit(0), limits).count() == 0


def test_files_by_byte_ranges(spark, tmp_path):
    text = "会議の記録です。次に進みます。\nAnd then, one more. " * 300
    path = tmp_path / "giant.txt"
    path.write_bytes(text.encode())
    files = spark.createDataFrame([(str(path), len(text.encode())), (str(path) + "x", 0)], "path string, n_bytes long")
    got = pieces.split_files(spark, files, 500, 60, range_bytes=1000, halo=64).orderBy("piece_no").collect()
    data = text.encode()
    assert got[0].from_byte == 0 and got[-1].to_byte == len(data)
    for a, b in zip(got, got[1:]):
        assert a.from_byte < b.from_byte <= a.to_byte and a.to_byte - b.from_byte <= 60
    for p in got:
        assert data[p.from_byte : p.to_byte].decode() == p.text and p.to_byte - p.from_byte <= 500
    ends = [p.text.rstrip()[-1] for p in got]
    assert sum(e in "。." for e in ends) == len(ends)
    assert rows(files.limit(0)) == []


def test_bytes_of_files_keep_their_places(spark, tmp_path):
    data = ("会議の記録です。One more word. ".encode() + b"\xff\xe3 bad ") * 200
    path = tmp_path / "bad.txt"
    path.write_bytes(data)
    got = pieces.split_files(spark, spark.createDataFrame([(str(path), len(data))], "path string, n_bytes long"), 150, 120, range_bytes=1000, halo=64).orderBy("piece_no").collect()
    assert got[0].from_byte == 0 and got[-1].to_byte == len(data)
    for n, (a, b) in enumerate(zip(got, got[1:])):
        assert b.piece_no == n + 1 and a.from_byte < b.from_byte < a.to_byte < b.to_byte and a.to_byte - b.from_byte <= 120
        assert a.to_byte - a.from_byte <= 150 and data[a.from_byte : a.to_byte].decode("utf-8", "replace") == a.text
