"""One consistent form of texts that look alike but are made of different characters.

A text is exploded to positioned code points.  Stretches of characters that map to themselves and can
neither combine nor reorder travel as one row; every other code point is a row of its own, placed by its
cluster (a character and the marks on it) and its place in it.  Rows carry the text's key, never the text.
They are joined to a broadcast table of decompositions, look-alikes and combining classes; the marks of a
cluster are ordered by class and composed one after the other as far as the rules of composition allow;
then the text is rebuilt from its clusters.  Everything stays in the partition of the text's key.

The table is derived from the Unicode database of the Python build: decompositions
that keep the looks, kinds of space, ignorable characters, and the look-alike letters listed below.  Its size is bounded by Unicode (some 45,000 rows), not by the data.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkgrid.operators.durable import cut_lineage

# Letters of other alphabets that are drawn like Latin ones, in natural order.
LATIN_LOOKS = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ү": "y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ԍ": "g",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o", "հ": "h", "յ": "j", "զ": "q",
}
# Chinese characters and hiragana that are drawn like katakana, in natural order.
KANA_LOOKS = {"一": "ー", "二": "ニ", "八": "ハ", "力": "カ", "卜": "ト", "口": "ロ", "夕": "タ", "工": "エ", "へ": "ヘ"}
# Marks that are drawn alike and that Unicode's compatibility mappings keep apart.
MARK_LOOKS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹘": "-", "˗": "-", "⁄": "/", "∕": "/", "∶": ":", "꞉": ":", "∣": "|", "ǃ": "!", "‚": ",", "∼": "~", "〜": "~"}
# Kinds of compatibility mappings that keep the looks.
_KEEPS_LOOKS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"}
_SPACES = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_INVISIBLE = {0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xFFF9, 0xFFFC), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)}

#: What the red tag of a marked text looks like.
RED = r'<span style="color:red">|</span>'


def _decomposed(ch: str) -> str:
    """Decomposed as far as the looks stay: a circled or raised digit, a bracketed letter and a full stop in a number stay."""
    kind, _, parts = unicodedata.decomposition(ch).rpartition(">")
    if not parts:
        return ch
    out = "".join(chr(int(x, 16)) for x in parts.split())
    if kind and kind + ">" not in _KEEPS_LOOKS or kind == "<compat" and not all(c.isalpha() or unicodedata.combining(c) or c in " .!?" for c in out):
        return ch
    return "".join(map(_decomposed, out))


def _form(cp: int) -> str:
    """The characters that stand for one code point: decomposed, with spaces and look-alikes folded."""
    if cp in _INVISIBLE:
        return ""
    if cp in _SPACES:
        return " "
    out = []
    for ch in _decomposed(LATIN_LOOKS.get(chr(cp), chr(cp))):
        ch = next((looks[ch] for looks in (MARK_LOOKS, LATIN_LOOKS, KANA_LOOKS) if ch in looks), ch)
        if ord(ch) not in _INVISIBLE:
            out.append(" " if ord(ch) in _SPACES else ch)
    # Spacing forms of the voicing marks, half width or not, combine with what precedes them.
    text = "".join(out)
    return {"゛": "゙", " ゙": "゙", "゜": "゚", " ゚": "゚"}.get(text, text)


def _pairs() -> dict[str, str]:
    """Two characters to the one that they compose to."""
    out = {}
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.decomposition(chr(cp))
        if kind and not kind.startswith("<") and " " in kind and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            out["".join(chr(int(x, 16)) for x in kind.split())] = chr(cp)
    return out


#: First and last of the letters that Korean syllables consist of: beginnings, vowels, ends.
_JAMO = ((0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2))


def _whole() -> dict[str, str]:
    """Sequences without marks that compose: Korean syllables, and vowel signs in two parts."""
    out = {pair: c for pair, c in _pairs().items() if not unicodedata.combining(pair[1]) and not 0xAC00 <= ord(c) < 0xD7A4}
    for cp in range(0xAC00, 0xD7A4):
        full = unicodedata.normalize("NFD", chr(cp))
        out[full] = chr(cp)
        if len(full) == 3:
            out[unicodedata.normalize("NFC", full[:2]) + full[2]] = chr(cp)
    return out


def _parts(form: str) -> list[tuple[int, int, int, str]]:
    """(segment, class, place, character) of a form; marks after its last full character belong to the cluster's last segment."""
    starters = [i for i, c in enumerate(form) if not unicodedata.combining(c)]
    last = starters[-1] if starters else -1
    return [(LAST if i > last else i, unicodedata.combining(c), i, c) for i, c in enumerate(form)]


#: Segment of the marks at the end of a cluster, which are ordered together.
LAST = 1000


def mapping_rows() -> list[tuple[str, list[tuple[int, int, int, str]]]]:
    """(character or sequence, parts of its form) of all that does not stand for itself or that is a mark."""
    rows = [(whole, _parts(c)) for whole, c in _whole().items()]
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4 or unicodedata.category(chr(cp)) in ("Cn", "Co"):
            continue
        form = _form(cp)
        if form != chr(cp) or unicodedata.combining(chr(cp)):
            rows.append((chr(cp), _parts(form)))
    return rows


def _ranges(points: list[int]) -> str:
    """A character class of sorted code points, for java.util.regex."""
    out, start, last = [], points[0], points[0]
    for cp in [*points[1:], -1]:
        if cp == last + 1:
            last = cp
            continue
        out.append(f"\\x{{{start:X}}}" if start == last else f"\\x{{{start:X}}}-\\x{{{last:X}}}")
        start = last = cp
    return "".join(out)


# Blocks of Unicode that most texts are written in (first and last code point), the most common first.
_COMMON = ((0x20, 0x7E), (0x3041, 0x3096), (0x30A1, 0x30FC), (0x4E00, 0x9FFF), (0x3001, 0x3011), (0xC0, 0x17F), (0x0E01, 0x0E5B), (0x0900, 0x097F))


def _stable() -> str:
    """The class of common characters that stand for themselves, alone or composed again; few ranges, so that matching is fast."""
    apart = {c for whole in _pairs() if not unicodedata.combining(whole[1]) for c in whole}
    keep = lambda cp: unicodedata.normalize("NFC", _form(cp)) == chr(cp) and not unicodedata.combining(chr(cp)) and chr(cp) not in apart
    return "".join(_ranges([cp for cp in range(lo, hi + 1) if keep(cp)]) for lo, hi in _COMMON)


def _token(rows: list[tuple[str, list]]) -> str:
    """A stretch of stable characters but the last one before a mark, a sequence that composes, or a character and its marks."""
    stable = _stable()
    marks = [ord(c) for c, parts in rows if len(c) == 1 and all(p[1] for p in parts)]  # invisible characters part no cluster
    beginning, vowel, end = (f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _JAMO)
    two = {}
    for pair in _pairs():
        if not unicodedata.combining(pair[1]):
            two.setdefault(pair[0], []).append(ord(pair[1]))
    pairs = "|".join(f"\\x{{{ord(a):X}}}[{_ranges(sorted(b))}]" for a, b in sorted(two.items()))
    mark = _ranges(sorted(marks))
    return f"[{stable}]+(?![{mark}])|[{beginning}][{vowel}][{end}]?|[\\x{{AC00}}-\\x{{D7A3}}][{end}]|{pairs}|(?s:.)[{mark}]*"


_cache: dict[str, object] = {}


def _tables() -> tuple[pa.Table, str, str]:
    """Rows of the mapping, the pattern of tokens, and the pairs of a character and a mark that compose."""
    if not _cache:
        rows = mapping_rows()
        part = pa.list_(pa.struct([("seg", pa.int32()), ("ccc", pa.int32()), ("k", pa.int32()), ("c", pa.string())]))
        held = pa.table([pa.array([c for c, _ in rows]), pa.array([[dict(zip(("seg", "ccc", "k", "c"), p)) for p in parts] for _, parts in rows], part)], names=["c", "parts"])
        _cache["all"] = held, _token(rows), json.dumps({pair: c for pair, c in _pairs().items() if unicodedata.combining(pair[1])})
    return _cache["all"]


def _composed(parts: Column, pairs: Column) -> Column:
    """One cluster's parts, in their order, as a string: a mark composes with the last full character unless another mark blocks it.

    The state is what is done, the last full character, the marks that stay on it, and the class of the last of these.
    """
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(-1).alias("last"))

    def step(acc: Column, p: Column) -> Column:
        one = F.try_element_at(pairs, F.concat(acc["base"], p["c"]))
        free = (p["ccc"] > 0) & (acc["last"] < p["ccc"]) & one.isNotNull()
        full = p["ccc"] == 0
        return F.struct(
            F.when(full, F.concat(acc["done"], acc["base"], acc["rest"])).otherwise(acc["done"]).alias("done"),
            F.when(full, p["c"]).when(free, one).otherwise(acc["base"]).alias("base"),
            F.when(full, "").when(free, acc["rest"]).otherwise(F.concat(acc["rest"], p["c"])).alias("rest"),
            F.when(full, -1).when(free, acc["last"]).otherwise(p["ccc"]).alias("last"),
        )

    return F.aggregate(parts, empty, step, lambda a: F.concat(a["done"], a["base"], a["rest"]))


def canonical(spark: SparkSession, texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """`key` and `form`: the consistent form of every text; null for null, '' for empty.

    Letter case, digits against letters, and marks that are drawn differently stay apart.  White space of
    any kind counts as one plain space, and at the ends of the text as nothing.  `key` must tell the rows apart.
    """
    rows, token, pairs = _tables()
    table = F.broadcast(spark.createDataFrame(rows))  # bounded by Unicode
    held = texts.select(*key, text)
    tokens = held.select(*key, F.col(text).isNull().alias("_null"), F.posexplode_outer(F.regexp_extract_all(F.col(text), F.lit(token), F.lit(0))).alias("pos", "t"))
    # A cluster of several code points gives a row for each, all others one row.
    mark = F.char_length("t") > 1
    letters = F.when(mark & ~F.col("t").rlike(f"^(?:{token.rsplit('|(?s:.)', 1)[0]})$"), F.split("t", "")).otherwise(F.array("t"))
    points = tokens.select(*key, "_null", "pos", F.posexplode(letters).alias("sub", "c"))
    own = F.array(F.struct(F.lit(0).alias("seg"), F.lit(0).alias("ccc"), F.lit(0).alias("k"), F.coalesce("c", F.lit("")).alias("c")))
    mapped = points.join(table, "c", "left").select(*key, "_null", "pos", "sub", F.coalesce("parts", own).alias("parts"))
    full = mapped.groupBy(*key, "_null", "pos").agg(F.collect_list(F.struct("sub", "parts")).alias("subs"))
    placed = F.flatten(F.transform("subs", lambda s: F.transform(s["parts"], lambda p: F.struct(p["seg"].alias("seg"), p["ccc"].alias("ccc"), s["sub"].alias("sub"), p["k"].alias("k"), p["c"].alias("c")))))
    alone = (F.size("subs") == 1) & (F.size(F.col("subs")[0]["parts"]) == 1)
    compositions = F.from_json(F.lit(pairs), "map<string,string>")
    ordered = full.select(*key, "_null", "pos", F.when(~alone, F.array_sort(placed)).alias("_parts"), F.when(alone, F.col("subs")[0]["parts"][0]["c"]).alias("_one"))
    plain = ordered.withColumn("_plain", F.coalesce("_one", F.array_join(F.col("_parts")["c"], "")))
    # Only clusters with a mark that composes with anything go through the steps of composition.
    seconds = _ranges(sorted({ord(pair[1]) for pair in json.loads(pairs)}))
    clusters = plain.select(*key, "_null", "pos", F.when(F.col("_one").isNull() & F.col("_plain").rlike(f"[{seconds}]"), _composed(F.col("_parts"), compositions)).otherwise(F.col("_plain")).alias("form"))
    built = clusters.groupBy(*key, "_null").agg(F.array_sort(F.collect_list(F.struct("pos", "form"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["form"]), "")
    form = F.trim(F.regexp_replace(joined, " +", " "))
    return built.select(*key, F.when(~F.col("_null"), form).alias("form"))


def legible(form: Column) -> Column:
    """The form with Chinese characters and hiragana where no katakana stands beside them: 工場, not エ場.

    A function of the form alone, which no two forms share: one or two of the look-alikes in a row, between
    characters that are no katakana, are not katakana either.
    """
    drawn = "".join(KANA_LOOKS.values())
    kana = "ァ-ヴヷ-ヺ・ー" + drawn  # the small ones that count months and places are none
    out = form
    for other, katakana in KANA_LOOKS.items():
        # A long vowel stands after hiragana too, unless a Chinese character follows, as in もう一点.
        before, more = ("ぁ-ゖ", "|(?<=[ぁ-ゖ])ー(?=[一-鿿])") if katakana == "ー" else ("", "")
        out = F.regexp_replace(out, f"(?<![{kana}{before}]){katakana}(?=[{drawn}]?(?![{kana}]))|(?<=(?<![{kana}])[{drawn}]){katakana}(?![{kana}]){more}", other)
    return F.when(form.rlike(f"[{drawn}]"), out).otherwise(form)


#: Members of a class that meet in one block.
BLOCK = 256


def same_looks(utterances: DataFrame, least: int = 10) -> DataFrame:
    """utt_id_a, utt_id_b: utterances of one job whose texts look the same but differ, and those whose marked does.

    Repeated deliveries count once.  Texts of fewer than `least` characters take no part in the pairs of
    two utterances.  Null texts look like nothing.
    """
    spark = utterances.sparkSession
    once = utterances.select("utt_id", "job_id", "text", F.regexp_replace("marked", RED, "").alias("marked")).dropDuplicates(["utt_id"])
    both = once.withColumn("own", F.col("marked").isNotNull() & (F.col("marked") != F.col("text")))
    layers = F.explode(F.array(F.struct(F.lit("text").alias("layer"), F.col("text").alias("t"), F.col("own").alias("own")), F.struct(F.lit("marked").alias("layer"), F.col("marked").alias("t"), F.col("own").alias("own")))).alias("x")
    stacked = both.select("utt_id", "job_id", layers).select("utt_id", "job_id", "x.*").where("t IS NOT NULL AND (layer = 'text' OR own)")
    # What is compared later is a digest: texts stay where they are.
    key = ["utt_id", "job_id", "layer", "own", "digest", "long"]
    digests = stacked.select("utt_id", "job_id", "layer", "own", F.md5(F.col("t").cast("binary")).alias("digest"), (F.char_length("t") >= least).alias("long"), "t")
    forms = canonical(spark, digests, key, "t").select(*key, F.md5(F.col("form").cast("binary")).alias("looks"))
    forms = cut_lineage(forms)
    self_ = forms.where("own").groupBy("utt_id").agg(F.count(F.lit(1)).alias("n"), F.min("looks").alias("a"), F.max("looks").alias("b")).where("n = 2 AND a = b").select(F.col("utt_id").alias("utt_id_a"), F.col("utt_id").alias("utt_id_b"))
    member = forms.where((F.col("layer") == "text") & F.col("long")).select("utt_id", F.concat_ws(" ", F.coalesce(F.col("job_id").cast("string"), F.lit("")), "looks").alias("of"), "digest")
    # Only classes that hold different texts give pairs; inside one, blocks of members meet, so that no task holds a class.
    mixed = member.groupBy("of").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("of", "n")
    numbered = member.join(mixed, "of").withColumn("b", F.pmod(F.xxhash64("utt_id"), F.ceil(F.col("n") / BLOCK)))
    blocks = numbered.groupBy("of", "b").agg(F.collect_list(F.struct("utt_id", "digest")).alias("m"))
    met = blocks.join(blocks.select("of", F.col("b").alias("b2"), F.col("m").alias("m2")), "of").where("b <= b2").repartition("of", "b", "b2")
    x = met.select("b", "b2", F.explode("m").alias("x"), "m2").select("b", "b2", "x", F.explode("m2").alias("y")).where("x.digest != y.digest AND (b < b2 OR x.utt_id < y.utt_id)")
    pairs = x.select(F.least("x.utt_id", "y.utt_id").alias("utt_id_a"), F.greatest("x.utt_id", "y.utt_id").alias("utt_id_b"))
    return pairs.unionByName(self_)
