"""The queries of this package."""

from __future__ import annotations

import os

from pyspark.sql import Window as W, functions as F

from talkgrid.llm import bpe, lookalike, names, packing, pieces, pii, sentences, spans, turns
from talkgrid.plans.registry import Registry
from talkgrid.sources.tables import table

REGISTRY = Registry()

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("TALKGRID_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


_P1 = """
WITH item AS (
  SELECT DISTINCT 'utterances.text' AS target, utt_id AS item_id, text FROM utterances
  UNION
  SELECT DISTINCT 'clips.whisper', clip_id, whisper FROM clips
)
SELECT DISTINCT target, item_id FROM item JOIN size_limits USING (target)
WHERE CASE unit WHEN 'chars' THEN length(text) WHEN 'bytes' THEN strlen(text) END > max_size
"""


def _items(spark, sf_dir):
    one = lambda name, key, text: table(spark, sf_dir, name).select(F.lit(f"{name}.{text}").alias("target"), F.col(key).alias("item_id"), F.col(text).alias("text"))
    return one("utterances", "utt_id", "text").unionByName(one("clips", "clip_id", "whisper"))


@REGISTRY.add("p1_pieces")
def p1_pieces(spark, sf_dir):
    """Ordered, overlapping pieces of every text above its limit."""
    return pieces.split_items(_items(spark, sf_dir), table(spark, sf_dir, "size_limits"))


@REGISTRY.add("p1_found", _P1)
def p1_found(spark, sf_dir):
    """The texts that had to be cut: those whose ranges add up to more than one piece."""
    offsets = pieces.piece_offsets(pieces.item_ranges(_items(spark, sf_dir), table(spark, sf_dir, "size_limits")))
    return offsets.where("piece_no = 1").select("target", "item_id")


_P1_REBUILT = """
WITH item AS (
  SELECT DISTINCT 'utterances.text' AS target, utt_id AS item_id, text FROM utterances
  UNION
  SELECT DISTINCT 'clips.whisper', clip_id, whisper FROM clips
)
SELECT DISTINCT target, item_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5, TRUE AS within, TRUE AS in_order
FROM item JOIN size_limits USING (target)
WHERE CASE unit WHEN 'chars' THEN length(text) WHEN 'bytes' THEN strlen(text) END > max_size
"""


@REGISTRY.add("p1_rebuilt", _P1_REBUILT)
def p1_rebuilt(spark, sf_dir):
    """Every cut text put together again from its pieces without what they repeat, and whether the pieces keep to their limits."""
    limits = table(spark, sf_dir, "size_limits").select("target", "max_size", "overlap_size")
    before = F.lag("to_char").over(W.partitionBy("target", "item_id").orderBy("piece_no"))
    rows = p1_pieces(spark, sf_dir).withColumn("before", F.coalesce(before, F.lit(0))).join(limits, "target")
    fresh = F.substr("text", (F.col("before") - F.col("from_char") + 1).cast("int"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("t")))), lambda p: p["t"]), "")
    # What is repeated has no more characters than units.
    ok = (F.col("from_char") <= F.col("before")) & (F.col("before") - F.col("from_char") <= F.col("overlap_size")) & (F.col("to_char") > F.col("before"))
    return rows.groupBy("target", "item_id").agg(F.max("to_char").alias("n_chars"), F.md5(parts.cast("binary")).alias("text_md5"), F.min(F.col("size") <= F.col("max_size")).alias("within"), F.min(ok).alias("in_order"))


@REGISTRY.add("p3_found")
def p3_found(spark, sf_dir):
    """Mentions of personal information in texts and memos."""
    found = pii.personal_information(table(spark, sf_dir, "utterances"))
    return found.select("utt_id", "field", F.explode("mentions").alias("m")).select("utt_id", "field", "m.kind", "m.value").distinct()


@REGISTRY.add("p3_redacted")
def p3_redacted(spark, sf_dir):
    """Texts and memos with typed placeholders."""
    return pii.personal_information(table(spark, sf_dir, "utterances")).select("utt_id", "field", "redacted")


@REGISTRY.add("p4_found")
def p4_found(spark, sf_dir):
    """Speaker turns, as the first and last utterance of each."""
    return turns.speaker_turns(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "people"), with_text=False).select("job_id", "first_utt_id", "last_utt_id")


@REGISTRY.add("p4_turns")
def p4_turns(spark, sf_dir):
    """Speaker turns with their clean text and the time they span."""
    return turns.speaker_turns(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "people"))


@REGISTRY.add("p5_found")
def p5_found(spark, sf_dir):
    """Every spelling of a registered person or firm, tied to it."""
    return names.linked_names(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "people"))


@REGISTRY.add("p6_found")
def p6_found(spark, sf_dir):
    """Sentence ends of texts and of the words that make them up."""
    return sentences.sentences(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "words"))


@REGISTRY.add("p7_found")
def p7_found(spark, sf_dir):
    """Utterances that look alike but differ in characters."""
    return lookalike.same_looks(table(spark, sf_dir, "utterances")).distinct()


@REGISTRY.add("p7_forms")
def p7_forms(spark, sf_dir):
    """The consistent form of every utterance's text."""
    once = table(spark, sf_dir, "utterances").select("utt_id", "text").dropDuplicates(["utt_id"])
    return lookalike.canonical(spark, once, ["utt_id"], "text").select("utt_id", lookalike.legible(F.col("form")).alias("form"))


@REGISTRY.add("p8_ids")
def p8_ids(spark, sf_dir):
    """Token ids of every document; the empty list for an empty or null text."""
    return bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_BPE)


@REGISTRY.add("p9_containers")
def p9_containers(spark, sf_dir):
    """The container of every document, or of each part of one that is longer than a container."""
    capacity = table(spark, sf_dir, "size_limits").where("target = 'documents.text'").first()["max_size"]
    sizes = bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_BPE, lengths_only=True)
    return packing.pack(sizes, "doc_id", "n_tokens", capacity)


@REGISTRY.add("p9_tiers")
def p9_tiers(spark, sf_dir):
    """How full the windows of every tier are, and how much of shorter tiers lies in them."""
    capacity = table(spark, sf_dir, "size_limits").where("target = 'documents.text'").first()["max_size"]
    return packing.tier_report(p9_containers(spark, sf_dir), capacity)


@REGISTRY.add("p10_found")
def p10_found(spark, sf_dir):
    """Pairs of documents that share a run of 200 characters or more."""
    return spans.shared_spans(table(spark, sf_dir, "documents"), cover=False).select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b")).distinct()


@REGISTRY.add("p10_shared")
def p10_shared(spark, sf_dir):
    """How much of every document stands in another one."""
    documents = table(spark, sf_dir, "documents")
    return spans.shared_parts(documents, spans.shared_spans(documents, pairs=False))
