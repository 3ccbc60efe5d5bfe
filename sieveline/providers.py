"""Pluggable model steps with deterministic offline defaults.

An embedder maps texts to vectors, a reranker scores a query against texts, a generator
turns a prompt into a JSON object. Each is a plain Python object sent to the workers,
which call it once per Arrow batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StringType, StructType

from sieveline.functions.wordstream import words


class Embedder(Protocol):
    width: int

    def embed(self, texts: list[str], intent: str) -> np.ndarray: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: list[str]) -> list[tuple[int, float]]: ...


class Generator(Protocol):
    def generate(self, system: str, prompt: str) -> str: ...


class HashingEmbedder:
    """Unit vectors of signed word counts, hashed to ``width`` places; the same for documents and queries."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str], intent: str) -> np.ndarray:
        w = words(texts)
        out = np.zeros((len(texts), self.width), np.float32)
        sign = np.where(w.hash >> np.uint64(63) > 0, 1.0, -1.0)
        np.add.at(out, (w.doc, (w.hash % np.uint64(self.width)).astype(np.int64)), sign)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class OverlapReranker:
    """The share of the query's words that a text has, best first; ties keep their order."""

    def rerank(self, query: str, texts: list[str]) -> list[tuple[int, float]]:
        w = words([query, *texts])
        sets = [set(w.hash[w.first[i] : w.first[i + 1]].tolist()) for i in range(len(texts) + 1)]
        scores = [len(sets[0] & s) / max(1, len(sets[0])) for s in sets[1:]]
        return sorted(enumerate(scores), key=lambda x: (-x[1], x[0]))


class EchoGenerator:
    """A generator for tests: answers every prompt with the same object."""

    def __init__(self, answer: dict):
        self.answer = answer

    def generate(self, system: str, prompt: str) -> str:
        return json.dumps(self.answer, ensure_ascii=False)


def embedded(df: DataFrame, text: str, embedder: Embedder, *, intent: str = "document", batch: int = 128) -> DataFrame:
    """Adds ``embedding``; the embedder is called with ``batch`` texts at most, nulls count as empty. An answer of the wrong shape is an error."""
    names = [*df.columns, "embedding"]
    at = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch):
                p = b.slice(s, batch)
                v = np.asarray(embedder.embed([t or "" for t in p.column(at).to_pylist()], intent), np.float32)
                if v.shape != (p.num_rows, embedder.width):
                    raise ValueError(f"embedder gave {v.shape} for {p.num_rows} texts")
                yield pa.RecordBatch.from_arrays([*p.columns, pa.array(list(v), pa.list_(pa.float32()))], names=names)

    return df.mapInArrow(work, StructType([*df.schema.fields]).add("embedding", ArrayType(FloatType())))


def generated(df: DataFrame, prompt: str, generator: Generator, *, system: str = "") -> DataFrame:
    """Adds ``answer``, the generator's JSON text, or null where it fails."""
    names = [*df.columns, "answer"]
    at = names.index(prompt)

    def one(p: str | None) -> str | None:
        try:
            return generator.generate(system, p or "")
        except Exception:
            return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(p) for p in b.column(at).to_pylist()], pa.string())], names=names)

    return df.mapInArrow(work, StructType([*df.schema.fields]).add("answer", StringType()))
