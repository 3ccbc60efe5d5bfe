"""Evaluation passages that stand inside training texts, found by winnowed word fingerprints.

Every text is read as words without case and diacritics. Of each window of ``window``
consecutive ``k``-word runs the run with the least hash is kept, so two texts that
share ``k + window - 1`` words in a row share a kept fingerprint at least. Training
and test fingerprints are joined by hash, and the hits are extended on the texts.

Nulls and edge cases: a null or empty text has no words and is never a hit; a test
item of fewer than ``min_words`` words cannot be hit; rows repeated whole count once;
ties between equal hashes keep the rightmost place, which does not change the result.
Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.wordstream import Words, kgrams, words
from sieveline.llm._batches import pieces, signed
from sieveline.session import cut

#: A side whose keys and hashes take no more bytes than this is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def _small(df: DataFrame) -> bool:
    """Whether all rows of ``df`` take BROADCAST_BYTES at most."""
    size = sum((F.octet_length(F.col(c).cast("string")) for c in df.columns), F.lit(16))
    return (df.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"] or 0) <= BROADCAST_BYTES


def winnow(w: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprints and the text each belongs to, each pair once.

    A text with fewer than ``window`` runs keeps its least one.
    """
    h, at = kgrams(w, k)
    if not len(h):
        return h, np.zeros(0, np.int64)
    doc = w.doc[at]
    least = h.copy()
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    full = np.ones(len(h), bool)
    for j in range(1, window):
        ahead = np.full(len(h), top)
        ahead[: len(h) - j] = np.where(doc[j:] == doc[: len(h) - j], h[j:], top)
        least = np.minimum(least, ahead)
    last = np.flatnonzero(np.diff(doc, append=-1))
    first = np.concatenate([[0], last[:-1] + 1])
    # windows that run past the text's end are not whole; the first window of a short text stays
    place = np.arange(len(h)) - np.repeat(first, last - first + 1)
    size = np.repeat(last - first + 1, last - first + 1)
    full = (place + window <= size) | (place == 0)
    pair = np.stack([doc[full].astype(np.uint64), least[full]])
    change = np.ones(pair.shape[1], bool)
    change[1:] = (pair[:, 1:] != pair[:, :-1]).any(axis=0)  # neighbouring windows mostly keep the same run
    return pair[1, change], pair[0, change].astype(np.int64)


def fingerprints(df: DataFrame, key: str, text: str, k: int, window: int) -> DataFrame:
    """(key, fp) of each text's kept runs."""
    kind = df.schema[key].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp, doc = winnow(words(b.column(1).to_pylist()), k, window)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), signed(fp)], names=["key", "fp"])

    rows = df.select(F.col(key), F.col(text)).filter(F.col(text).isNotNull())
    return rows.mapInArrow(work, f"key {kind.simpleString()}, fp long")


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Runs:
    """Hashes of the runs of any length of a text's words, from sums over the powers of a base."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        power, back = np.full(n, _BASE), np.full(n, _INVERSE)
        power[:1], back[:1] = 1, 1
        self.back = np.multiply.accumulate(back)
        self.upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.multiply.accumulate(power), dtype=np.uint64)])

    def of(self, length: int) -> np.ndarray:
        n = len(self.back) - length + 1
        return (self.upto[length:] - self.upto[:n]) * self.back[:n] if n > 0 else np.zeros(0, np.uint64)


def longest_shared(a: np.ndarray, b: np.ndarray, n: int) -> int:
    """The most words in a row that two texts' word hashes share, if at least ``n``, else 0.

    Found by bisection over the length, so that words which are repeated many times on both sides cost no more than others.
    """
    x, y = _Runs(a), _Runs(b)
    low, high = n - 1, min(len(a), len(b))  # runs of ``low`` words are shared, longer ones than ``high`` are not
    while low < high:
        middle = n if low < n else (low + high + 1) // 2
        if len(np.intersect1d(x.of(middle), y.of(middle))):
            low = middle
        else:
            high = middle - 1
    return low if low >= n else 0


def leaks(
    train: DataFrame, test: DataFrame, *, train_key: str = "doc_id", train_text: str = "text", test_key: str = "case_id",
    test_text: str = "item_text", min_words: int = 13, k: int = 8,
) -> DataFrame:
    """(train_key, test_key, shared_words): each training text with each test item that shares ``min_words`` words in a row.

    ``shared_words`` is the longest shared run. The test side's fingerprints, and the pairs of keys with a hit, are
    broadcast only if they take BROADCAST_BYTES at most; beyond that the joins shuffle.
    """
    window = min_words - k + 1
    if k < 1 or window < 1:
        raise ValueError("k must be between 1 and min_words")
    a = train.select(F.col(train_key).alias("t_key"), F.col(train_text).alias("t_text"))
    b = test.select(F.col(test_key).alias("e_key"), F.col(test_text).alias("e_text")).distinct()
    test_fp = cut(fingerprints(b, "e_key", "e_text", k, window).distinct()).withColumnRenamed("key", "e_key")
    train_fp = fingerprints(a, "t_key", "t_text", k, window).withColumnRenamed("key", "t_key")
    hits = cut(train_fp.join(F.broadcast(test_fp) if _small(test_fp) else test_fp, "fp").select("t_key", "e_key").distinct())
    # few hits go to the texts, so that texts without one are not shuffled
    both = a.filter(F.col("t_text").isNotNull()).join(F.broadcast(hits) if _small(hits) else hits, "t_key").join(b, "e_key")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, 256):
            wa, wb = words(p.column(2).to_pylist()), words(p.column(3).to_pylist())
            shared = [
                longest_shared(wa.hash[wa.first[i] : wa.first[i + 1]], wb.hash[wb.first[i] : wb.first[i + 1]], min_words)
                for i in range(p.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(shared, pa.int32())], names=["t_key", "e_key", "n"])

    kinds = f"t_key {train.schema[train_key].dataType.simpleString()}, e_key {test.schema[test_key].dataType.simpleString()}, n int"
    found = both.select("t_key", "e_key", "t_text", "e_text").mapInArrow(extend, kinds).filter("n > 0")
    return found.groupBy(F.col("t_key").alias(train_key), F.col("e_key").alias(test_key)).agg(F.max("n").alias("shared_words"))


def leak_report(found: DataFrame, test: DataFrame, *, test_key: str = "case_id") -> DataFrame:
    """(test_key, n_texts, longest): for each test item in how many texts it leaked; 0 where it did not."""
    n = found.groupBy(test_key).agg(F.count("*").alias("n_texts"), F.max("shared_words").alias("longest"))
    return test.select(test_key).distinct().join(n, test_key, "left").select(
        test_key, F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("longest", F.lit(0)).alias("longest")
    )
