"""Vectorised tokenising for Arrow batches: texts to word hashes without a Python loop per word.

A batch of texts is laid out as one array of code points; a table maps each code
point to the one that stands for it, or to a separator. Words are the longest runs
between separators, and their 64-bit hashes are sums over (code point, place), so
that they agree on every executor and in every run.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

_UNKNOWN, _SEP, _DROP = -1, 0, -2
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int, salt: int = 1) -> np.ndarray:
    """``n`` odd 64-bit numbers, the same in every process."""
    base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    return mix64(base) | np.uint64(1)


def _folded(cp: int) -> int:
    """Letter or digit without case and diacritics; a combining mark is dropped; the rest separates."""
    ch = chr(cp)
    if unicodedata.category(ch) == "Mn":
        return _DROP
    if not ch.isalnum():
        return _SEP
    low = ch.lower()
    bare = [c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c) != "Mn"]
    out = bare[0] if bare else low[0]
    return ord({"đ": "d"}.get(out, out))


def _lowered(cp: int) -> int:
    ch = chr(cp)
    return ord(ch.lower()[0]) if ch.isalnum() else _SEP


_TABLES: dict[str, np.ndarray] = {}


def _table(kind: str) -> np.ndarray:
    if kind not in _TABLES:
        _TABLES[kind] = np.full(0x110000, _UNKNOWN, dtype=np.int32)
    return _TABLES[kind]


def map_codes(codes: np.ndarray, kind: str) -> np.ndarray:
    """Code points to their representatives; each code point is looked up once per process."""
    table = _table(kind)
    out = table[codes]
    if (missing := out == _UNKNOWN).any():
        rule = _folded if kind == "fold" else _lowered
        for cp in np.unique(codes[missing]):
            table[cp] = rule(int(cp))
        out = table[codes]
    return out


@dataclass
class Words:
    """Words of a batch in order: ``hash`` and ``doc`` (index of the text) of each; ``first`` has
    the place of each text's first word, with one more entry at the end."""

    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def words(texts: list[str | None], kind: str = "fold") -> Words:
    """Word hashes of a batch. ``kind``: ``fold`` ignores case and diacritics, ``lower`` is NFC and lower case.

    A null text has no words.
    """
    if kind == "lower":
        texts = ["" if t is None else unicodedata.normalize("NFC", t) for t in texts]
    else:
        texts = ["" if t is None else t for t in texts]
    n = len(texts)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=n) + 1
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if n == 0:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64))
    of = np.repeat(np.arange(n, dtype=np.int64), lengths)
    rep = map_codes(codes, kind)
    keep = rep != _DROP
    if not keep.all():
        rep, of = rep[keep], of[keep]
    inside = rep != _SEP
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    if len(starts) == 0:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
    idx = np.flatnonzero(inside)
    word_of = np.cumsum((inside & ~before)[idx]) - 1
    place = idx - starts[word_of]
    pows = multipliers(int(place.max()) + 1, salt=7)
    value = mix64(rep[idx].astype(np.uint64) + np.uint64(0x51ED27)) * pows[place]
    first_char = np.flatnonzero(np.diff(word_of, prepend=-1))
    h = mix64(np.add.reduceat(value, first_char))
    doc = of[starts]
    first = np.searchsorted(doc, np.arange(n + 1))
    return Words(h, doc, first)


def kgrams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of one text, and the place of each run's first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    m = multipliers(k, salt=11)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += w.hash[at + j] * m[j]
    return mix64(h), at
