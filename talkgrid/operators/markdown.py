"""Written documents as blocks, and clean-ups of what a generator or a recogniser wrote; built-in expressions, windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Patterns that decide results and must therefore stand as they do.
#: A heading in lenticular brackets, and an entry of one line (a short key, a colon, a value).
BRACKETED = r"^【[^】]+】$"
ENTRY = r"^[^\s#|\-*>][^:：]{0,12}[:：]\s*\S"
#: A long-vowel mark that stands for the character for one: before these characters unless kana or a Latin letter precedes, before the few unless katakana does.
ICHI = r"(?<![ぁ-ゖァ-ヺーｦ-ﾟa-zA-Zａ-ｚＡ-Ｚ])ー(?=[番緒応旦度回部方般斉括覧貫致切体瞬員式周層環同列連気杯歩段通人つ個件本枚点位種名時日年月週])"
ICHI_STRONG = r"(?<![ァ-ヺーｦ-ﾟ])ー(?=[番緒応旦般斉括覧貫瞬])"
#: What a correction must not add or remove.
QUALIFIERS = ("しない", "しません", "できない", "できません", "不要", "未定", "未確定", "保留", "検討中", "かもしれない")
#: Rows of a table's rule, numbers with what joins their digits, and clauses that go on after a full stop.
RULE_CELL, NUMBER, GOES_ON = r"^:?-{3,}:?$", r"[0-9]+(?:[.,:/][0-9]+)*", "(?:けど|ので|から|が|て)$"
SMALL_KANA, COUNTED = "ぁぃぅぇぉっゃゅょァィゥェォッャュョー", "0-9年月日時分秒円％件名回個"
_WIDE, _PLAIN = "０１２３４５６７８９．，：／", "0123456789.,:/"


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def cells(line: Column) -> Column:
    """Cells of a table's row; escaped pipes stay in their cell."""
    inner = F.regexp_replace(F.replace(_bare(line), F.lit("\\|"), F.lit("\x01")), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.replace(_bare(c), F.lit("\x01"), F.lit("|")))


def blocks(lines: DataFrame) -> DataFrame:
    """doc_id, no, kind, content, rows: the blocks of documents from their lines (doc_id, line_no, line).

    A table is a row, a rule of as many cells with a pipe, and the rows that follow; its rows are padded to one width.
    Every other line is a block: h1 to h3, check, bullet, text or blank.
    """
    order = W.partitionBy("doc_id").orderBy("line_no")
    row = lines.withColumns({"_cells": cells(F.col("line")), "_pipe": F.contains("line", F.lit("|")) & (_bare(F.col("line")) != "")})
    rule = F.col("_pipe") & F.forall("_cells", lambda c: c.rlike(RULE_CELL))
    starts = F.col("_pipe") & F.coalesce(F.lead(rule).over(order) & (F.lead(F.size("_cells")).over(order) == F.size("_cells")), F.lit(False))
    island = row.withColumns({"_starts": starts, "_island": F.sum((~F.col("_pipe")).cast("int")).over(order)})
    first = F.min(F.when(F.col("_starts"), F.col("line_no"))).over(W.partitionBy("doc_id", "_island", "_pipe"))
    placed = island.withColumn("_first", F.when(F.col("_pipe"), first)).withColumn("_table", F.coalesce(F.col("line_no") >= F.col("_first"), F.lit(False)))
    end = F.regexp_replace("line", r"\s+$", "")
    head, check, bullet = r"^(#{1,6})\s+(.*)$", r"^\s*-\s*\[[ xX]?\]\s*(.*)$", r"^\s*[-*]\s+(.*)$"
    kind = F.when(F.col("_table"), "table").when(end == "", "blank").when(end.rlike(head), F.concat(F.lit("h"), F.least(F.lit(3), F.char_length(F.regexp_extract(end, head, 1))))).when(end.rlike(check), "check").when(end.rlike(bullet), "bullet").otherwise("text")
    content = F.when(F.col("_table"), None).when(end.rlike(head), F.regexp_extract(end, head, 2)).when(end.rlike(check), F.regexp_extract(end, check, 1)).when(end.rlike(bullet), F.regexp_extract(end, bullet, 1)).otherwise(end)
    kept = placed.where(~F.col("_table") | (F.col("line_no") != F.col("_first") + 1))
    made = kept.groupBy("doc_id", F.when(F.col("_table"), F.col("_first")).otherwise(F.col("line_no")).alias("at")).agg(
        F.first(kind).alias("kind"), F.first(content).alias("content"), F.array_sort(F.collect_list(F.when(F.col("_table"), F.struct("line_no", "_cells")))).alias("_rows")
    )
    width = F.array_max(F.transform("_rows", lambda r: F.size(r["_cells"])))
    padded = F.transform("_rows", lambda r: F.concat(r["_cells"], F.array_repeat(F.lit(""), width - F.size(r["_cells"]))))
    no = F.row_number().over(W.partitionBy("doc_id").orderBy("at")) - 1
    return made.select("doc_id", no.alias("no"), "kind", "content", F.when(F.col("kind") == "table", padded).alias("rows"))


def tidied(text: Column) -> Column:
    """Blank lines around bracketed headings, kept line breaks after entries of one line, no more than one blank line in a row."""

    def line(x: Column) -> Column:
        bare = _bare(x)
        return F.when(bare.rlike(BRACKETED), F.concat(F.lit("\n"), bare, F.lit("\n"))).when(bare.rlike(ENTRY), F.concat(F.regexp_replace(x, r"\s+$", ""), F.lit("  "))).otherwise(x)

    joined = F.array_join(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), line), "\n")
    return F.concat(_bare(F.regexp_replace(joined, "\n{3,}", "\n\n")), F.lit("\n"))


def unfenced(text: Column) -> Column:
    """Without a fence of backticks around the whole, and without a thinking part."""
    plain = _bare(F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", ""))
    return F.when(plain.rlike(r"(?s)^```[^\n]*\n.*\n\s*```$"), _bare(F.regexp_extract(plain, r"(?s)^```[^\n]*\n(.*)\n\s*```$", 1))).otherwise(plain)


def kept_break(old: Column, new: Column) -> Column:
    """The new line with the two spaces at its end that the old one keeps its break with."""
    return F.when(old.endswith("  ") & ~new.endswith("  "), F.concat(F.regexp_replace(new, r"\s+$", ""), F.lit("  "))).otherwise(new)


def appended_mark(prefix: Column, body: Column, mark: str) -> Column:
    """A mark at the end of an item, or in the first filled cell of a table's row."""
    end = F.regexp_replace(body, r"\s+$", "")
    row = F.regexp_replace(body, r"^([^|]*(?:\|\s*)+[^|\s](?:[^|]*[^|\s])?)\s*\|", f"$1{mark} |")
    return F.when(_bare(body).startswith("|"), row).otherwise(F.concat(prefix, end, F.lit(mark)))


def fixed_ichi(text: Column) -> Column:
    """A long-vowel mark that was heard for the character for one, put right; '' for null."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), ICHI, "一"), ICHI_STRONG, "一")


def _found(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """`key`, spans (at, alias, display): the spellings of `names` (alias, display) in each text, the longest at a place, none inside another or a tag.

    Places and names meet by their first two characters, so no text is compared with all names; shorter names are none.
    """
    longest = names.agg(F.max(F.char_length("alias")).alias("_most"))  # one row
    rows = texts.where(F.char_length(text) >= 2).select(key, F.col(text).alias("_t")).join(F.broadcast(longest))
    at = F.explode(F.sequence(F.lit(1), F.char_length("_t") - 1))
    places = rows.select(key, "_t", "_most", at.alias("at")).select(key, "at", F.substr("_t", F.col("at"), F.col("_most")).alias("_tail"), (F.regexp_replace(F.substr("_t", F.lit(1), F.col("at") - 1), "<[^>]*>", "").contains("<") & F.substr("_t", F.col("at")).contains(">")).alias("_tag"))
    known = names.where(F.char_length("alias") >= 2).select("alias", "display", F.substring("alias", 1, 2).alias("_head"))
    met = places.withColumn("_head", F.substring("_tail", 1, 2)).join(known, "_head").where(F.startswith("_tail", F.col("alias")) & ~F.col("_tag"))
    best = met.groupBy(key, "at").agg(F.max_by(F.struct("alias", "display"), F.char_length("alias")).alias("x"))
    ordered = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.col("x.alias").alias("alias"), F.col("x.display").alias("display")))).alias("_all"))
    empty = F.struct(F.lit(1).alias("next"), F.slice("_all", 1, 0).alias("kept"))
    step = lambda acc, x: F.when(x["at"] >= acc["next"], F.struct((x["at"] + F.char_length(x["alias"])).alias("next"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    return ordered.select(key, F.aggregate("_all", empty, step, lambda a: a["kept"]).alias("spans"))


def _with_displays(names: DataFrame) -> DataFrame:
    """The names and the display names themselves, which stand for themselves wherever an alias is part of them."""
    shown = names.select(F.col("display").alias("alias"), "display").distinct()
    return names.where("alias != display").select("alias", "display").unionByName(shown).dropDuplicates(["alias"])


def aliases_applied(texts: DataFrame, key: str, columns: list[str], names: DataFrame) -> DataFrame:
    """`key` and `columns` with every known spelling written as the display name; tags and display names are left alone."""
    out = texts.select(key, *columns)
    known = _with_displays(names)
    for column in columns:
        spans = _found(texts, key, column, known).withColumnRenamed("spans", "_s")
        out = out.join(spans, key, "left").withColumn(column, F.when(F.col("_s").isNotNull(), _rewritten(F.col(column), F.col("_s"))).otherwise(F.col(column))).drop("_s")
    return out


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with the display name at every span."""
    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("done"))
    step = lambda acc, x: F.struct((x["at"] + F.char_length(x["alias"])).alias("next"), F.concat(acc["done"], F.substr(text, acc["next"], x["at"] - acc["next"]), x["display"]).alias("done"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["done"], F.substr(text, a["next"])))


def names_found(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """`key`, name: the display names of whom a text mentions, each once."""
    return _found(texts, key, text, _with_displays(names)).select(key, F.explode(F.array_distinct(F.col("spans")["display"])).alias("name"))


def numbers(text: Column) -> Column:
    """The numbers of a text, in order of size as strings, full-width digits as plain ones."""
    return F.array_sort(F.regexp_extract_all(F.translate(text, _WIDE, _PLAIN), F.lit(NUMBER), F.lit(0)))


def facts_changed(rows: DataFrame, key: str, old: str, new: str, names: DataFrame) -> DataFrame:
    """`key`, changed: whether a correction changes numbers, people, or what is denied or left open."""
    both = rows.select(key, F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col(old).alias("t")), F.struct(F.lit("new").alias("side"), F.col(new).alias("t")))).alias("x")).select(F.struct(key, "x.side").alias("_k"), "x.t")
    people = names_found(both, "_k", "t", names).groupBy(F.col(f"_k.{key}").alias(key), "name").agg(F.count(F.lit(1)).alias("n"))
    moved = people.where("n = 1").select(key).distinct().withColumn("_moved", F.lit(True))
    held = numbers(F.col(old)) != numbers(F.col(new))
    for word in QUALIFIERS:
        held = held | (F.contains(old, F.lit(word)) != F.contains(new, F.lit(word)))
    return rows.select(key, held.alias("_held")).join(moved, key, "left").select(key, (F.col("_held") | F.coalesce("_moved", F.lit(False))).alias("changed"))


def inside_word(head: Column, after: Column) -> Column:
    """Whether a boundary between two stretches lies inside a word: before a small kana, in a run of katakana, between a number and its unit."""
    kana = head.rlike("[ァ-ヺー]$") & after.rlike("^[ァ-ヺー]")
    return F.coalesce(after.rlike(f"^[{SMALL_KANA}]") & (head != "") | kana | head.rlike("[0-9０-９]$") & after.rlike(f"^[{COUNTED}]"), F.lit(False))


def glued(words: Column, gap: int = 500, most: int = 300) -> Column:
    """Heads of one or two characters that stand far before the rest of their word, moved up to it with its label.

    `words` is an array in order; it is folded from its end, as a head may be followed by one that has moved itself.
    """

    def step(done: Column, w: Column) -> Column:
        rest = F.try_element_at(done, F.lit(1))
        after = F.trim(F.array_join(F.transform(F.slice(done, 1, 3), lambda x: x["word"]), ""))
        head = F.regexp_replace(F.trim(w["word"]), "[、。，,．.]+$", "")
        far = (rest["s"] - w["e"] > gap) & F.char_length(head).between(1, 2) & ~after.rlike("^ー[一-鿿]") & inside_word(head, after)
        moved = F.struct(w["word_idx"].alias("word_idx"), (rest["s"] - F.least(w["e"] - w["s"], F.lit(most))).alias("s"), rest["s"].alias("e"), F.regexp_replace(F.rtrim(w["word"]), "[、。，,．.]+$", "").alias("word"), rest["label"].alias("label"))
        same = F.struct(*(w[f].alias(f) for f in ("word_idx", "s", "e", "word", "label")))
        return F.concat(F.array(F.when(F.coalesce(far, F.lit(False)), moved).otherwise(same)), done)

    return F.aggregate(F.reverse(words), F.slice(words, 1, 0), step)


def repaired(words: DataFrame, pause: int = 800) -> DataFrame:
    """utt_id, word_idx, s, e, word, label: words without marks inside words; a full stop after a clause that goes on soon, by the same speaker, is a comma."""
    order = W.partitionBy("utt_id").orderBy("word_idx")
    w = words.withColumns({"_next": F.lead(F.struct("word", "s", "label")).over(order), "_body": F.expr("substr(word, 1, length(word) - 1)")})
    body, nxt = F.trim("_body"), F.col("_next")
    mark = F.col("word").rlike("[、。]$") & nxt.isNotNull() & (body != "")
    inside = inside_word(body, F.trim(nxt["word"])) & ~body.rlike("[0-9]$")
    goes_on = F.col("word").endswith("。") & (nxt["s"] - F.col("e") < pause) & nxt["label"].eqNullSafe(F.col("label")) & F.col("_body").rlike(GOES_ON)
    fixed = F.when(mark & inside, F.col("_body")).when(mark & goes_on, F.concat("_body", F.lit("、"))).otherwise(F.col("word"))
    return w.select("utt_id", "word_idx", "s", "e", fixed.alias("word"), "label")
