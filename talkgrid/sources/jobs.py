"""Job folders: JSON and subtitle files in, published files out."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

WORD = "struct<start:double,end:double,word:string,prob:double>"
UTTERANCE = f"struct<start:double,end:double,speaker:string,text:string,marked:string,words:array<{WORD}>,human:boolean,proofread:boolean,proofread_pending:boolean>"
JOB = f"source string, duration double, meta_line string, meeting_date string, memo string, utterances array<{UTTERANCE}>, segments array<struct<start:double,end:double,text:string,words:array<{WORD}>>>"


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    read = spark.read.schema(JOB).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", name).option("recursiveFileLookup", True).json(root)
    return read.select(folder.alias("job_dir"), "*")


def read_jobs(spark: SparkSession, root: str) -> DataFrame:
    """job_dir, incomplete, source, duration, ..., utterances of every job folder.

    A folder without finished utterances but with a checkpoint is an incomplete job of unlabelled
    utterances.  A file that is no JSON, or JSON of another shape, is a job without utterances.
    """
    done = _read(spark, root, "utterances.json").drop("segments").withColumn("incomplete", F.lit(False))
    blank = F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("speaker"), s["text"].alias("text"), s["text"].alias("marked"), s["words"].alias("words"), F.lit(False).alias("human"), F.lit(False).alias("proofread"), F.lit(False).alias("proofread_pending")))
    partial = _read(spark, root, "checkpoint.json").join(done.select("job_dir"), "job_dir", "left_anti")
    return done.unionByName(partial.withColumn("utterances", blank.cast(f"array<{UTTERANCE}>")).drop("segments").withColumn("incomplete", F.lit(True)))


def exploded_utterances(jobs: DataFrame) -> DataFrame:
    """One row an utterance, with its place in the job; missing flags are false."""
    rows = jobs.select("job_dir", "incomplete", F.posexplode("utterances").alias("utt_idx", "u")).select("job_dir", "incomplete", "utt_idx", "u.*")
    return rows.na.fill(False, ["human", "proofread", "proofread_pending"])


def read_texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """folder, file, text of whole text files, with a byte order mark removed."""
    path = F.split(F.col("_metadata.file_path"), "/")
    read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(root, wholetext=True)
    return read.select(F.element_at(path, -2).alias("folder"), F.element_at(path, -1).alias("file"), F.regexp_replace("value", "^﻿", "").alias("text"))


def publish(root: str, job_dir: str, files: dict[str, str], last: str = "utterances.json") -> None:
    """Write a job's files so that a reader never sees half of them: each is written aside and renamed, `last` at the end.

    If a write fails, files written before are put back as they were.
    """
    folder = os.path.join(root, job_dir)
    os.makedirs(folder, exist_ok=True)
    staging = os.path.join(folder, f".staging-{uuid.uuid4().hex}")
    os.makedirs(staging)
    kept: dict[str, str | None] = {}
    try:
        for name, content in files.items():
            with open(os.path.join(staging, name), "w", encoding="utf-8") as out:
                out.write(content)
                out.flush()
                os.fsync(out.fileno())
        for name in sorted(files, key=lambda n: n == last):
            target = os.path.join(folder, name)
            kept[name] = os.path.join(staging, name + ".before") if os.path.exists(target) else None
            if kept[name]:
                shutil.copy2(target, kept[name])
            os.replace(os.path.join(staging, name), target)
    except OSError:
        for name, before in kept.items():
            target = os.path.join(folder, name)
            if before and os.path.exists(before):
                os.replace(before, target)
            elif before is None and os.path.exists(target):
                os.remove(target)
        raise
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def merged_settings(defaults: dict, own: dict | None) -> dict:
    """Settings over defaults, at every depth; a value of another shape than the default's is left out."""
    out = dict(defaults)
    for key, value in (own or {}).items():
        if isinstance(out.get(key), dict):
            out[key] = merged_settings(out[key], value) if isinstance(value, dict) else out[key]
        elif value is not None:
            out[key] = value
    return out


def read_settings(path: str, defaults: dict) -> dict:
    """Settings of a JSON file over defaults; a missing or broken file gives the defaults."""
    try:
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
    except (OSError, ValueError):
        own = None
    return merged_settings(defaults, own if isinstance(own, dict) else None)
