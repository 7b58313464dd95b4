"""Operators on written documents: lines, sections, search, evidence, status, history, learning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkgrid.functions import text as X


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line of every document; line ends of any kind."""
    split = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1)
    return docs.where("text IS NOT NULL").select("doc_id", F.posexplode(split).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


def transcript_lines(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, sec, line of the lines that begin with [HH:MM:SS]."""
    stamp = r"^\[(\d{2}):(\d{2}):(\d{2})\]"
    part = lambda i: F.regexp_extract("line", stamp, i).try_cast("bigint")
    return rows.where(F.col("line").rlike(stamp)).select("doc_id", "line_no", (part(1) * 3600 + part(2) * 60 + part(3)).alias("sec"), "line")


# Sections whose items are not checked, sections whose paragraphs are items too, and what begins an item.
SKIPPED, PARAGRAPHS = "AIの意見|会議概要|考察", "要点サマリー|要約"
ITEM = r"^\s*([-*・]|\d+[.．)])\s*"


def sectioned(rows: DataFrame) -> DataFrame:
    """doc_id, line_no, section, line of the items of documents, with the heading that stands before them ('' for none).

    Items are bullets and numbered lines that say something, rows of tables but their heads and rules, and in
    summaries every other line.  Headings are bracketed or have up to three signs; sections of opinion are left out.
    """
    order = W.partitionBy("doc_id").orderBy("line_no")
    bare = F.trim("line")
    bracket, signs = F.regexp_extract(bare, "^【([^】]+)】$", 1), F.regexp_extract(bare, r"^#{1,3}\s+(.+)$", 1)
    name = F.when(bracket != "", bracket).when((signs != "") & ~bare.startswith("### 議題"), F.trim(F.regexp_replace(signs, "^[^0-9A-Za-z_一-鿿ぁ-ゖァ-ヺ]+", "")))
    read = rows.withColumns({"_bare": bare, "_name": name})
    carried = F.last("_name", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    part = F.sum(F.col("_name").isNotNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    placed = read.withColumns({"section": F.coalesce(carried, F.lit("")), "_part": part}).where(F.col("_name").isNull() & (F.col("_bare") != "") & ~F.col("section").rlike(SKIPPED))
    row = F.col("_bare").startswith("|") & ~F.col("_bare").rlike(r"^\|[\s\-:|]+\|$")
    seen = F.sum(row.cast("int")).over(W.partitionBy("doc_id", "_part").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    table = row & (F.col("_seen") > 1) & (F.trim(F.replace("_bare", F.lit("|"), F.lit(""))) != "")
    listed = F.col("_bare").rlike(ITEM + r"\S")
    says = F.trim(F.regexp_replace(F.regexp_replace("_bare", ITEM, ""), "^[（）() ]+|[（）() ]+$", "")) != ""
    other = F.col("section").rlike(PARAGRAPHS) & ~F.col("_bare").startswith("#")
    kept = F.when(F.col("_bare").startswith("|"), table).when(listed, says).otherwise(other)
    return placed.withColumn("_seen", seen).where(kept).select("doc_id", "line_no", "section", "line")


def evidence_by_time(items: DataFrame, spoken: DataFrame, within: int = 75) -> DataFrame:
    """item_id, utt_id: what was said within some seconds of an item, joined by buckets of time."""
    around = items.withColumn("_b", F.explode(F.sequence(F.floor((F.col("sec") - within) / within), F.floor((F.col("sec") + within) / within))))
    said = spoken.withColumn("_b", F.floor(F.col("sec") / within)).withColumnRenamed("sec", "_sec")
    return around.join(said, ["job_id", "_b"]).where(F.abs(F.col("sec") - F.col("_sec")) <= within).select("item_id", "utt_id").distinct()


def evidence_by_keyword(items: DataFrame, spoken: DataFrame, k: int = 3) -> DataFrame:
    """item_id, utt_id: the k lines of the item's job that hold most of its keywords, earlier ones first, and the lines beside them.

    `items` has item_id, job_id, keywords; `spoken` utt_id, job_id, no (the line's place in its job) and text.  A job's
    distinct keywords meet its lines by their first two characters; items come in only where a keyword was found.
    """
    wanted = items.select("item_id", "job_id", F.explode("keywords").alias("word")).distinct()
    words = wanted.select("job_id", "word").distinct().withColumn("_head", F.substring("word", 1, 2))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("text") - 1), lambda i: F.substr("text", i, F.lit(2))))
    places = spoken.where(F.char_length("text") >= 2).select("job_id", "utt_id", F.explode(heads).alias("_head"))
    maybe = places.join(words, ["job_id", "_head"]).select("job_id", "utt_id", "word").distinct()
    held = maybe.join(spoken.select("utt_id", "no", "text"), "utt_id").where(F.contains("text", F.col("word"))).select("job_id", "word", "utt_id", "no")
    hits = wanted.join(held, ["job_id", "word"]).groupBy("item_id", "job_id", "utt_id", "no").agg(F.count(F.lit(1)).alias("hits"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("hits"), "no"))
    best = hits.withColumn("_r", rank).where(F.col("_r") <= k)
    around = best.select("item_id", "job_id", F.explode(F.sequence(F.col("no") - 1, F.col("no") + 1)).alias("no"))
    return around.join(spoken.select("job_id", "no", "utt_id"), ["job_id", "no"]).select("item_id", "utt_id").distinct()


def supported_quotes(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """item_id, n, supported: how many lines of the quote's stamp hold it, and whether they support it.

    `quotes` has item_id, job_id, stamp, quote and claimed (the name that the item says acts, or null); `lines` job_id,
    stamp, speaker and text.  A claimed name is supported by its own words, where it speaks of itself, or if the quote
    names it.  A quote under six characters supports nothing.
    """
    said = lines.select("job_id", "stamp", "speaker", F.col("text").alias("_line"))
    met = quotes.join(said, ["job_id", "stamp"]).where(F.contains("_line", F.col("quote")))
    own = F.col("claimed").isNull() | F.contains("quote", F.col("claimed")) | (F.col("speaker").eqNullSafe(F.col("claimed")) & F.col("quote").rlike(X.FIRST_PERSON))
    found = met.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(own, F.lit(False))).alias("ok"))
    out = quotes.select("item_id", (F.char_length(F.trim("quote")) >= 6).alias("long")).join(found, "item_id", "left")
    return out.select("item_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), (F.col("long") & F.coalesce("ok", F.lit(False))).alias("supported"))


def edits_applied(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """job_id, utt_idx, text, human, and error of every row of every job, after a table of edits (job_id, utt_idx, shown, new).

    A job whose edits name a row twice, name one that does not exist, or leave one out is not changed, and error says
    why (of several the first of these).  An emptied row is deleted; a row whose cell is as it was shown keeps its state.
    """
    keyed = edits.groupBy("job_id", "utt_idx").agg(F.count(F.lit(1)).alias("_times"), F.min("shown").alias("_shown"), F.min("new").alias("_new"))
    both = rows.select("job_id", "utt_idx", "text", "human", F.lit(True).alias("_row")).join(keyed, ["job_id", "utt_idx"], "full")
    whole = W.partitionBy("job_id")
    wrong = lambda c: F.max(F.coalesce(c, F.lit(False))).over(whole)
    edited = F.max(F.col("_times").isNotNull()).over(whole)
    error = F.when(~edited, None).when(wrong(F.col("_times") > 1), "twice").when(wrong(F.col("_row").isNull()), "unknown").when(wrong(F.col("_times").isNull()), "missing")
    judged = both.withColumn("error", error)
    change = F.col("error").isNull() & F.coalesce(~F.col("_new").eqNullSafe(F.col("_shown")), F.lit(False)) & F.col("_times").isNotNull()
    text = F.when(change, F.col("_new")).otherwise(F.col("text"))
    kept = judged.where(F.col("_row")).select("job_id", "utt_idx", text.alias("text"), (change | F.coalesce("human", F.lit(False))).alias("human"), "error", change.alias("_change"))
    return kept.where("NOT (_change AND coalesce(text, '') = '')").drop("_change")


def accepted_replies(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """id, accepted: which rows (id, no, text) take the proofreader's reply (id is a group's; replies have id and reply).

    A reply is lines of "[n] text", n from 1.  Lines of other forms, of unknown n and without text are passed over; of
    several lines of one n the first that is acceptable counts.  It must be half to 1.6 times as long as the old text
    and keep its numbers and what it denies or leaves open.  A name of the speaker before a colon is taken off.
    """
    from talkgrid.operators.markdown import QUALIFIERS, numbers

    line = F.explode(F.split("reply", "\n")).alias("_line")
    parsed = replies.select("id", line).select("id", F.regexp_extract("_line", r"(?s)^\s*\[(\d+)\]\s*(.*)$", 1).try_cast("bigint").alias("no"), F.trim(F.regexp_extract("_line", r"(?s)^\s*\[(\d+)\]\s*(.*)$", 2)).alias("_body")).where("no IS NOT NULL AND _body != ''")
    met = rows.join(parsed, ["id", "no"])
    speaker = F.coalesce(F.nullif("speaker", F.lit("")), F.lit("話者"))
    body = F.when(F.startswith("_body", F.concat(speaker, F.lit(":"))) | F.startswith("_body", F.concat(speaker, F.lit("："))), F.trim(F.substr("_body", F.char_length(speaker) + 2))).otherwise(F.col("_body"))
    new = met.withColumn("_new", X.strip_marks(X.from_uncertain(body)))
    near = (F.char_length("_new") / F.greatest(F.char_length("text"), F.lit(1))).between(0.5, 1.6)
    same = numbers(F.col("_new")) == numbers(F.col("text"))
    for word in QUALIFIERS:
        same = same & (F.contains("_new", F.lit(word)) == F.contains("text", F.lit(word)))
    taken = new.where(near & same).select("id", "no").distinct().withColumn("accepted", F.lit(True))
    return rows.select("id", "no").join(taken, ["id", "no"], "left").select("id", "no", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def within_budget(rows: DataFrame, key: str, order: Sequence[str], size: Column, budget: int) -> DataFrame:
    """Rows of each key in order, up to the first that would pass the budget."""
    total = F.sum(size).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_t", total).where(F.col("_t") <= budget).drop("_t")


def search(docs: DataFrame, query: str, most: int = 200) -> DataFrame:
    """folder, doc_id, line_no, snippet: lines that hold any word of the query, of documents that hold all of them; a report of the first `most`."""
    words = [w for w in query.replace("　", " ").split(" ") if w]
    has = lambda c, w: F.contains(F.lower(c), F.lit(w.lower()))
    whole, some = F.lit(True), F.lit(False)
    for w in words:
        whole, some = whole & has(F.col("text"), w), some | has(F.col("line"), w)
    files = docs.where(whole)
    hits = lines(files.select("doc_id", "text")).where(some).join(docs.select("doc_id", F.col("source").alias("folder")), "doc_id")
    return hits.select("folder", "doc_id", "line_no", X.snippet(F.col("line"), words).alias("snippet")).orderBy(F.desc("folder"), F.desc("doc_id"), "line_no").limit(most)


def status(docs: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id, status: missing (no text), unknown (no record), current or stale (by the hash that was kept)."""
    now = F.sha2(F.col("text"), 256)
    s = F.when(F.col("text").isNull(), "missing").when(F.col("kept").isNull(), "unknown").when(F.col("kept") == now, "current").otherwise("stale")
    return docs.join(records, "doc_id", "left").select("doc_id", s.alias("status"))


def unambiguous_names(people: DataFrame) -> DataFrame:
    """alias, display: spellings that belong to one display name only; the display names themselves count."""
    # Names of one character may be a part of any word.
    spelled = people.select("display_name", F.explode(F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).where("trim(alias) != '' AND length(alias) >= 2")
    return spelled.groupBy("alias").agg(F.min("display_name").alias("display"), F.countDistinct("display_name").alias("n")).where("n = 1").select("alias", "display")


def upserted(kept: DataFrame, new: DataFrame, promote: int = 0) -> DataFrame:
    """wrong, right, count of corrections after adding new ones; `promote` is the least count of a new one."""
    seen = new.groupBy("wrong", "right").agg(F.count(F.lit(1)).alias("count"))
    both = kept.select("wrong", "right", "count", F.lit(0).alias("p")).unionByName(seen.select("wrong", "right", "count", F.lit(promote).alias("p")))
    return both.groupBy("wrong", "right").agg(F.greatest(F.sum("count"), F.max("p")).cast("bigint").alias("count"))


def first_of_each(rows: DataFrame, value: str, order: str) -> DataFrame:
    """value, first: distinct values in the order of their first appearance."""
    return rows.groupBy(value).agg(F.min(order).alias("first"))


def versions(rows: DataFrame, key: str, time: str) -> DataFrame:
    """key, version (from 1), latest (flag) of an append-only history; ties in time by row id."""
    w = W.partitionBy(key)
    n = F.row_number().over(w.orderBy(time, "id"))
    return rows.select(key, "id", n.cast("bigint").alias("version"), (n == F.count(F.lit(1)).over(w)).alias("latest"))


def compared(first: DataFrame, second: DataFrame, third: DataFrame, key: str) -> DataFrame:
    """`key` and counts over the windows that three recognitions share: first (clip_id, key, a), second (clip_id, b, sec, unsafe), third (clip_id, c).

    Windows, seconds, windows without text and unsafe ones of the second, how many the third changed and how many in more
    than marks and white space, how many the second filled that the first left empty, and the characters of each.
    """
    plain = lambda c: F.regexp_replace(c, r"[\s、。？！?!,.・…]", "")
    n = lambda c: F.sum(c.cast("int"))
    x = first.join(second, "clip_id").join(third, "clip_id")
    return x.groupBy(key).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("sec").alias("sec"), n(F.col("b") == "").alias("empty"), n(F.col("unsafe")).alias("unsafe"), n(F.col("b") != F.col("c")).alias("changed"), n(plain("b") != plain("c")).alias("reworded"),
        n((F.col("a") == "") & (F.col("b") != "")).alias("filled"), *(F.sum(F.char_length(c)).alias(f"chars_{c}") for c in "abc"),
    )
