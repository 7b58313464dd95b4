"""Model-backed operators behind interfaces, with fakes that need no model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from talkgrid.operators.sequence import packed


class TextGenerator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, clips: list[str]) -> np.ndarray: ...


class FirstSentence:
    """A generator that gives back each prompt's first sentence."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.split("。")[0] + "。" if "。" in p else p for p in prompts]


class HashEmbedder:
    """An embedder whose vectors follow from the clip's name alone."""

    def __init__(self, size: int = 16):
        self.size = size

    def embed(self, clips: list[str]) -> np.ndarray:
        out = np.stack([np.random.default_rng(abs(hash_of(c))).normal(size=self.size) for c in clips]) if clips else np.zeros((0, self.size))
        return out / np.linalg.norm(out, axis=1, keepdims=True).clip(1e-9)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def generated(rows: DataFrame, prompt: str, generator: TextGenerator, name: str = "reply") -> DataFrame:
    """All columns of `rows` and the generator's reply to each prompt; one generator for each task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{name: generator.generate(pdf[prompt].fillna("").tolist())})

    return rows.mapInPandas(run, schema)


def embedded(rows: DataFrame, clip: str, embedder: Embedder) -> DataFrame:
    """All columns of `rows` and the embedding of each clip."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(embedding=list(embedder.embed(pdf[clip].fillna("").tolist()).astype("float32")))

    return rows.mapInPandas(run, schema)


def compacted_notes(lines: DataFrame, limit: int, generator: TextGenerator, levels: int = 2) -> DataFrame:
    """job_id, id, line: the lines of each job packed into chunks and summed up, at most `levels` times (two aggregations in all)."""
    for _ in range(levels):
        sized = lines.select("job_id", "id", F.char_length("line").alias("size"))
        chunks = packed(sized, ["job_id"], ["id"], limit)
        parts = lines.join(chunks, ["job_id", "id"]).groupBy("job_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("prompt"))
        lines = generated(parts, "prompt", generator, "line").select("job_id", F.col("chunk").alias("id"), "line")
    return lines


def two_means(vectors: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Cluster 0 or 1 of each vector by k-means on directions, from the first vector and the one least like it."""
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True).clip(1e-9)
    centres = np.stack([v[0], v[int((v @ v[0]).argmin())]])
    label = np.zeros(len(v), int)
    for _ in range(rounds):
        new = (v @ centres.T).argmax(axis=1)
        for k in (0, 1):
            if (new == k).any():
                m = v[new == k].mean(axis=0)
                centres[k] = m / max(np.linalg.norm(m), 1e-9)
        if (new == label).all():
            break
        label = new
    return label


def split_speaker(rows: DataFrame) -> DataFrame:
    """job, speaker, clip, part: the clips of one label of a job in two groups; the part that is like the whole keeps 0.  One speaker's clips of one job are a bounded group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("clip")
        v = np.stack([np.asarray(x, float) for x in pdf["embedding"]])
        label = two_means(v) if len(v) > 1 else np.zeros(len(v), int)
        mean = v.mean(axis=0)
        like = [v[label == k].mean(axis=0) @ mean if (label == k).any() else -1e9 for k in (0, 1)]
        return pdf[["job", "speaker", "clip"]].assign(part=label if like[0] >= like[1] else 1 - label)

    return rows.groupBy("job", "speaker").applyInPandas(one, "job bigint, speaker string, clip bigint, part bigint")


class SpeechRecognizer(Protocol):
    def transcribe(self, clips: list[str]) -> list[list[tuple[float, float, str]]]: ...


class NamedTurns:
    """A recogniser that hears the parts of each clip's name, a second each."""

    def transcribe(self, clips: list[str]) -> list[list[tuple[float, float, str]]]:
        return [[(float(i), i + 1.0, part) for i, part in enumerate(c.split("/")) if part] for c in clips]


def recognised(rows: DataFrame, key: str, clip: str, recognizer: SpeechRecognizer) -> DataFrame:
    """`key`, start, end, text of the segments that a recogniser hears in each clip; one recogniser for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heard = recognizer.transcribe(pdf[clip].fillna("").tolist())
            yield pd.DataFrame([(k, *segment) for k, segments in zip(pdf[key], heard) for segment in segments], columns=[key, "start", "end", "text"])

    return rows.select(key, clip).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, start double, end double, text string")


#: Vectors of one job that are compared with each other at most; of more, some evenly apart stand for all.
SAMPLE = 2_000


def _neighbours(v: np.ndarray, k: int) -> np.ndarray:
    """The symmetric graph of every vector's k likest vectors."""
    likest = np.argpartition(-(v @ v.T), min(k, len(v) - 1), axis=1)[:, : k + 1]
    graph = np.zeros((len(v), len(v)))
    np.put_along_axis(graph, likest, 0.5, axis=1)
    return graph + graph.T


def _spectrum(graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.eigh(np.diag(graph.sum(axis=1)) - graph)


def speaker_count(vectors: np.ndarray, most: int = 10) -> int:
    """How many speakers directions fall into: the largest gap between eigenvalues, with as many neighbours as make it clearest."""
    n = len(vectors)
    if n < 6:
        return 1
    found = []
    for share in (0.02, 0.05, 0.1, 0.2):
        k = min(n - 1, max(4, int(np.sqrt(n)), int(n * share)))
        values = _spectrum(_neighbours(vectors, k))[0]
        gaps = np.diff(values[: min(most, n - 1) + 1])
        found.append((k * values[-1] / max(gaps.max(), 1e-9), int(gaps.argmax()) + 1))
    return min(found)[1]


def clustered(vectors: np.ndarray, count: int | None = None, most: int = 10, rounds: int = 20) -> np.ndarray:
    """Cluster of each vector: of as many speakers as there seem to be, by the eigenvectors of the neighbours' graph."""
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True).clip(1e-9)
    some = v[np.linspace(0, len(v) - 1, min(len(v), SAMPLE)).astype(int)] if len(v) else v
    n = min(count or speaker_count(some, most), max(1, len(some)))
    if n <= 1 or len(some) < 2:
        return np.zeros(len(v), int)
    rows = _spectrum(_neighbours(some, max(4, int(np.sqrt(len(some))), len(some) // 20)))[1][:, :n]
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True).clip(1e-9)
    # Centres far from each other, one after the other; then every vector goes to the nearest and moves it.
    picked = [0]
    while len(picked) < n:
        picked.append(int(((rows @ rows[picked].T).max(axis=1)).argmin()))
    label = (rows @ rows[picked].T).argmax(axis=1)
    centres = np.stack([some[label == k].mean(axis=0) if (label == k).any() else some[picked[k]] for k in range(n)])
    of = np.zeros(len(v), int)
    for _ in range(rounds):
        new = (v @ (centres / np.linalg.norm(centres, axis=1, keepdims=True).clip(1e-9)).T).argmax(axis=1)
        centres = np.stack([v[new == k].mean(axis=0) if (new == k).any() else centres[k] for k in range(n)])
        if (new == of).all():
            break
        of = new
    return of


def clusters_of_jobs(rows: DataFrame, most: int = 10) -> DataFrame:
    """job, clip, cluster of vectors (job, clip, embedding): one recording's windows are a bounded group, a day of them some hundred thousand rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("clip")
        return pdf[["job", "clip"]].assign(cluster=clustered(np.stack([np.asarray(x, float) for x in pdf["embedding"]]), most=most))

    return rows.groupBy("job").applyInPandas(one, "job bigint, clip bigint, cluster bigint")
