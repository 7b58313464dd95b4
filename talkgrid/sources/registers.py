"""Registers kept in YAML or JSON files: people, corrections, glossary and examples; and the lock and pause of a job folder."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from talkgrid.sources.jobs import publish

try:
    import yaml
except ImportError:  # JSON alone is read then, which YAML holds
    yaml = None

PEOPLE = "display_name string, aliases array<string>, role string"
CORRECTIONS = "wrong string, right string, count bigint"


def _load(path: str) -> dict:
    """What a file holds; nothing for a missing or broken one."""
    try:
        with open(path, encoding="utf-8") as file:
            data = yaml.safe_load(file) if yaml is not None else json.load(file)
    except (OSError, ValueError) if yaml is None else (OSError, ValueError, yaml.YAMLError):
        return {}
    return data if isinstance(data, dict) else {}


def _save(path: str, data: dict) -> None:
    text = yaml.safe_dump(data, allow_unicode=True, sort_keys=False) if yaml is not None else json.dumps(data, ensure_ascii=False)
    folder, name = os.path.split(os.path.abspath(path))
    publish(os.path.dirname(folder), os.path.basename(folder), {name: text}, last=name)


def _records(path: str, name: str) -> list[dict]:
    found = _load(path).get(name)
    return [r for r in found if isinstance(r, dict)] if isinstance(found, list) else []


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """display_name, aliases, role of everybody with a display name; aliases are trimmed, blank ones left out."""
    rows = []
    for r in _records(path, "people"):
        if r.get("display_name"):
            aliases = r.get("aliases") if isinstance(r.get("aliases"), list) else []
            rows.append((str(r["display_name"]), [str(a).strip() for a in aliases if str(a).strip()], str(r["role"]) if r.get("role") else None))
    return spark.createDataFrame(rows, PEOPLE)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """wrong, right, count; a count that is no number is 1."""
    count = lambda c: int(c) if str(c).isdigit() else 1
    return spark.createDataFrame([(str(r["wrong"]), str(r["right"]), count(r.get("count", 1))) for r in _records(path, "corrections") if r.get("wrong") and r.get("right")], CORRECTIONS)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """term, in the file's order; blank ones left out."""
    terms = _load(path).get("terms")
    return spark.createDataFrame([(str(t),) for t in (terms if isinstance(terms, list) else []) if str(t).strip()], "term string")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """before, after of corrections kept with their context."""
    return spark.createDataFrame([(r["before"], r["after"]) for r in _records(path, "examples") if isinstance(r.get("before"), str) and isinstance(r.get("after"), str)], "before string, after string")


def save_people(people: DataFrame, path: str) -> None:
    """A register is written by the driver: it is one small file that people edit."""
    _save(path, {"people": [{k: v for k, v in r.asDict().items() if v is not None} for r in people.select("display_name", "aliases", "role").toLocalIterator()]})


def save_corrections(corrections: DataFrame, path: str) -> None:
    _save(path, {"corrections": [r.asDict() for r in corrections.select("wrong", "right", "count").toLocalIterator()]})


def save_glossary(terms: DataFrame, path: str) -> None:
    _save(path, {"terms": [t for t in (r.term.strip() for r in terms.select("term").toLocalIterator() if r.term) if t]})


class JobBusy(Exception):
    """Another process works on the job."""


@contextmanager
def job_lock(folder: str) -> Iterator[None]:
    """One process at a time works on a job folder.  The system frees the lock if the process dies."""
    import fcntl

    with open(os.path.join(folder, ".lock"), "ab") as file:
        try:
            fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as error:
            raise JobBusy(folder) from error
        yield


def request_pause(folder: str) -> None:
    """Ask whoever works on the job to stop where it can go on later."""
    open(os.path.join(folder, ".pause"), "a").close()


def pause_requested(folder: str) -> bool:
    return os.path.exists(os.path.join(folder, ".pause"))


def stop_if_asked(query, folder: str) -> bool:
    """Stop a streaming query at a batch's end if a pause is asked for; its checkpoint lets it go on from there."""
    if not pause_requested(folder):
        return False
    query.processAllAvailable()
    query.stop()
    os.remove(os.path.join(folder, ".pause"))
    return True
