"""Fixed-size overlapping chunks that end at the last separator in the window's second half."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators in order of preference, the size and the overlap.
SEPARATORS = ("\n\n", "\n", ". ", " ")
SIZE, OVERLAP = 2048, 200


def _places(text: str, separator: str) -> list[int]:
    """Where ``separator`` begins, also where it overlaps itself, rising."""
    return [m.start() for m in re.finditer(f"(?={re.escape(separator)})", text)]


def cut_points(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each chunk in code points.

    Boundaries are looked up in the rising places of each separator: a chunk ends after the
    last one of the first separator that ends within it and begins, counted in UTF-8 bytes
    from the chunk's start, at half the size in characters or later, else at the size. The
    next chunk starts ``overlap`` before that end, or at it where that would not go forward.
    Settings out of range stand for others: a size below 1 for the default, a negative
    overlap for none, one that is not below the size for half of it.
    """
    size = SIZE if size < 1 else size
    overlap = size // 2 if overlap >= size else max(overlap, 0)
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    byte = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
    places = [(len(p), _places(text, p)) for p in SEPARATORS] if n > size else []
    spans: list[tuple[int, int]] = []
    while not spans or spans[-1][1] < n:
        start = 0
        if spans:
            start = spans[-1][1] - overlap
            start = start if start > spans[-1][0] else spans[-1][1]
        stop, least = min(start + size, n), byte[start] + size // 2
        last = ((at[i - 1], w) for w, at in places if (i := bisect_right(at, stop - w)))
        natural = (at + w for at, w in last if at >= start and byte[at] >= least)
        spans.append((start, n if stop == n else next(natural, stop)))
    return spans if n else []


def chunked(df: DataFrame, *, key: str = "id", text: str = "content", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, pos, start, content): the chunks of each text; a null or empty text has none."""
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for p, (s, e) in enumerate(cut_points(t, size, overlap)):
                    of.append(i)
                    rows.append((p, s, t[s:e]))
            pos, start, content = zip(*rows) if rows else ((), (), ())
            arrays = [b.column(0).take(pa.array(of, pa.int64())), pa.array(pos, pa.int32()), pa.array(start, pa.int64()), pa.array(content, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "pos", "start", "content"])

    rows = df.filter(F.col(text).isNotNull()).select(key, text)
    return rows.mapInArrow(work, f"k {kind}, pos int, start long, content string").withColumnRenamed("k", key)
