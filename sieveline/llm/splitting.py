"""Oversized texts into pieces at natural boundaries, with a set overlap.

Positions where a text may be cut have a grade: paragraph end, line end, sentence end,
word end, and, where a stretch without white space is longer than the limit, positions
of a fine grid. Dynamic programming over these positions minimises the sum of grade
penalties and of squared deviations of the pieces' lengths from an even split, such
that no piece is over the limit. Word ends are offered only between stronger
boundaries that are too far apart, and forced positions only between word ends that
are; a weaker cut is thus never taken where a stronger one would do.

A piece after the first begins up to ``overlap`` code points before the cut, at the
first word start in that range, and at the cut itself where the overlap would make it
too long. Joining the pieces without their overlaps gives the text back.

Nulls and edge cases: a null text gives no piece, an empty one or one within the limit
gives itself as its only piece; rows repeated whole count once; texts of any length
are cut whole. Lengths and places are in code points of the text as stored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm._batches import pieces as small_batches

#: Grades of cuts and what each costs; the last piece ends at the text's end, which costs nothing.
GRADES = ("paragraph", "line", "sentence", "word", "forced")
PENALTIES = (0.0, 0.5, 1.0, 8.0, 1000.0)
_PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
_LINE = re.compile(r"(?:\r\n|\r|\n)\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+")
_SPACE = re.compile(r"\s+")


def _boundaries(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions to cut at, rising, and the grade of each; the text's end is the last, with grade 0."""
    n = len(text)
    grade: dict[int, int] = {}
    for g, rule in ((2, _SENTENCE), (1, _LINE), (0, _PARAGRAPH)):
        for m in rule.finditer(text):
            grade[m.end()] = g
    for p in (0, n):
        grade.pop(p, None)
    step = max(1, (limit - overlap) // 2)

    def gaps(at: list[int], most: int) -> list[tuple[int, int]]:
        edges = [0, *at, n]
        return [(a, b) for a, b in zip(edges, edges[1:]) if b - a > most]

    for a, b in gaps(sorted(grade), step):
        for m in _SPACE.finditer(text, a, b):
            for p in (m.start(), m.end()):
                if a < p < b:
                    grade.setdefault(p, 3)
            if m.end() - m.start() > step:  # white space may be cut anywhere
                for p in range(m.start() + step, m.end(), step):
                    grade.setdefault(p, 3)
    grid = max(1, (limit - overlap) // 64)
    for a, b in gaps(sorted(grade), limit):
        for p in range(a + grid, b, grid):
            grade.setdefault(p, 4)
    at = sorted(grade)
    return np.array([*at, n], np.int64), np.array([*(grade[p] for p in at), 0], np.int64)


def _overlap_start(text: str, cut: int, overlap: int) -> int:
    """The first word start within ``overlap`` code points before ``cut``."""
    low = max(0, cut - overlap)
    if low == 0 or text[low - 1].isspace():
        return low
    m = _SPACE.search(text, low, cut)
    return m.end() if m else low


def split_text(text: str, limit: int = 2048, overlap: int = 200) -> list[tuple[int, int, int, str]]:
    """(start, first new position, end, grade of the cut at the end) of each piece of one text."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n, "end")]
    at, grade = _boundaries(text, limit, overlap)
    even = n / -(-(n - overlap) // (limit - overlap))
    m = len(at)
    cost = np.full(m, np.inf)
    back = np.full(m, -2)
    begin = np.zeros(m, np.int64)
    # starts: with the overlap and, where that would be too long, without it
    full = np.array([_overlap_start(text, int(p), overlap) for p in at])
    penalty = np.array(PENALTIES)[grade]
    for j in range(m):
        lo = int(np.searchsorted(at, at[j] - limit))
        options = []
        if at[j] <= limit:
            options.append((((at[j] - even) / even) ** 2, -1, 0))
        if lo < j:
            i = np.arange(lo, j)
            length = at[j] - full[i]
            fits = length <= limit
            new = at[j] - at[i]
            size = np.where(fits, length, new)
            c = cost[i] + ((size - even) / even) ** 2 + np.where(fits, 0.0, 0.25)
            b = int(np.argmin(c))
            options.append((float(c[b]), lo + b, int(full[i[b]] if fits[b] else at[i[b]])))
        if options:
            c, b, s = min(options)
            cost[j], back[j], begin[j] = c + penalty[j], b, s
    out = []
    j = m - 1
    while j >= 0:
        b = int(back[j])
        out.append((int(begin[j]), int(at[b]) if b >= 0 else 0, int(at[j]), GRADES[grade[j]] if j < m - 1 else "end"))
        j = b
    return out[::-1]


def split(df: DataFrame, *, key: str = "id", text: str = "content", limit: int = 2048, overlap: int = 200) -> DataFrame:
    """(key, piece, n_pieces, start, new_from, cut, n_chars, content): every text's pieces in order.

    ``start`` is the piece's first code point in the text, ``new_from`` where what the
    piece before does not hold begins, ``cut`` the grade of the boundary at its end.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below the limit")
    kind = df.schema[key].dataType.simpleString()
    names = ["k", "piece", "n_pieces", "start", "new_from", "cut", "n_chars", "content"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            of: list[int] = []
            rows: list[tuple] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                parts = split_text(t, limit, overlap)
                of += [i] * len(parts)
                rows += [(p, len(parts), s, f, g, e - s, t[s:e]) for p, (s, f, e, g) in enumerate(parts)]
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    rows = df.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text)).distinct()
    schema = f"k {kind}, piece int, n_pieces int, start long, new_from long, cut string, n_chars long, content string"
    return rows.mapInArrow(work, schema).withColumnRenamed("k", key)


def oversized(df: DataFrame, *, key: str = "id", text: str = "content", limit: int = 2048, overlap: int = 200) -> DataFrame:
    """(key, cut): each text over the limit and whether any of its cuts had to be ``forced``, else ``natural``."""
    long = df.filter(F.length(text) > limit)
    cuts = split(long, key=key, text=text, limit=limit, overlap=overlap)
    return cuts.groupBy(key).agg(F.when(F.max((F.col("cut") == "forced").cast("int")) == 1, "forced").otherwise("natural").alias("cut"))
