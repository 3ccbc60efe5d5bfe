"""Values that were cut off: by a field limit or in transfer.

Two kinds of evidence are joined into the odds that a value was cut.

*Its length.* Lengths of one source's field are log-normal, and values cut at a limit
are right-censored observations. Candidate limits are lengths, in code points or bytes,
at which unfinished values heap up. For each source and field the distribution is fitted
by maximum likelihood with the values at limits as censored ones; the posterior that a
value of that length is a censored longer one is the censored share's survival beyond
the limit against the density at it. Elsewhere the prior is the share of values that
stop unfinished off the limits, as transfers break anywhere.

*Its ending.* Every position of every text is a context of one to four tokens, rare
tokens by their shape (letter case, digits, length), after which a sentence ended or
went on. How often the value's last tokens end a sentence elsewhere, a longer context
backing off to a shorter one, tells a finished text without a full stop, or with a note
after it, from one that stops within a sentence; tokens seen nowhere else stop within a
word. Marks like an ellipsis after the stop are taken off first.

Counted over all texts: contexts, tokens, lengths. Only contexts that some value ends in
are counted, found by a bitmap of fixed size; a full bitmap would only count more.
Tokens in at least ``common`` of the texts are kept as they are; a text of S tokens on
average has S / ``common`` such at most, which bounds what is broadcast.

Nulls and edge cases: null and blank values are never cut; a null source is a source;
rows repeated whole count once; values are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import erfc, exp, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.wordstream import mix64, multipliers
from sieveline.llm._batches import pieces, signed
from sieveline.session import cut as cut_lineage
from sieveline.session import stage

_BITS = 24
_TRAIL = np.array([ord(c) for c in ".,!?…;:\"”’»)]}–-"], np.uint32)
_TERMINAL = np.array([ord(c) for c in "!?…"], np.uint32)
_OTHER = np.array([ord(c) for c in ",;:–-"], np.uint32)
#: Marks that are put after a stop.
MARKS = ("[...]", "[…]", "(...)", "...", "…")


def without_marks(text: str) -> tuple[str, int]:
    """A text without marks and white space at its end, and its length without the marks and what stands before them.

    Where there is no mark the length is that of the text as it is.
    """
    bare, n = text.rstrip(), len(text)
    while mark := next((m for m in MARKS if bare.endswith(m)), None):
        bare = bare[: -len(mark)].rstrip()
        n = len(bare)
    return bare, n


@dataclass
class Tokens:
    """Tokens of a batch between white space, in order; their cores are without trailing marks."""

    doc: np.ndarray
    literal: np.ndarray
    shape: np.ndarray
    stop: np.ndarray  # a full stop follows the token's core
    terminal: np.ndarray  # another end mark follows it
    other: np.ndarray  # another mark follows it, as a comma
    last: np.ndarray  # the last of its line
    upper: np.ndarray  # begins with a capital or a sign
    digits: np.ndarray  # holds a digit
    part_of: np.ndarray  # of each proper beginning of a core: the token
    part_literal: np.ndarray
    part_shape: np.ndarray


_SPACES = np.array([chr(c).isspace() for c in range(0x3100)])
_LOWER = np.array([ord(chr(c).lower()[0]) for c in range(0x3100)], np.uint32)
_KINDS = np.array([1 if chr(c).isdigit() else 2 if chr(c).isupper() else 3 if chr(c).isalpha() else 16 + c for c in range(0x3100)], np.uint32)


def tokens(texts: list[str]) -> Tokens:
    n = len(texts)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
    of = np.repeat(np.arange(n), lengths)
    small = np.minimum(codes, 0x30FF)
    inside = ~_SPACES[small]
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & ~before)
    if not len(start):
        z, u, f = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        return Tokens(z, u, u, f, f, f, f, f, f, z, u, u)
    idx = np.flatnonzero(inside)
    tok = np.cumsum((inside & ~before)[idx]) - 1
    first = np.flatnonzero(np.diff(tok, prepend=-1))
    place = idx - start[tok]
    char = codes[idx]
    core_end = np.maximum.reduceat(np.where(np.isin(char, _TRAIL), -1, place), first)
    core_end = np.where(core_end < 0, np.maximum.reduceat(place, first), core_end)  # all marks: the token is its core
    core = place <= core_end[tok]
    pows = multipliers(int(place.max()) + 1, salt=17)[place]
    kind = _KINDS[small[idx]]

    def sums(value: np.ndarray) -> np.ndarray:
        """Running sums within each token's core."""
        total = np.cumsum(np.where(core, value * pows, np.uint64(0)))
        base = np.concatenate([[np.uint64(0)], total])[first]
        return total - base[tok]

    lit, shp = sums(mix64(_LOWER[small[idx]].astype(np.uint64) + np.uint64(77))), sums(mix64(kind.astype(np.uint64) + np.uint64(0x9000)))
    final = np.concatenate([first[1:], [len(idx)]]) - 1
    part = np.flatnonzero(place < core_end[tok])

    def trailing(marks: np.ndarray) -> np.ndarray:
        return np.add.reduceat((~core & np.isin(char, marks)).astype(np.int32), first) > 0

    breaks = np.concatenate([[0], np.cumsum(codes == 10)])
    last = np.ones(len(start), bool)
    last[:-1] = breaks[start[1:]] > breaks[start[:-1]]
    stop, terminal, other = trailing(np.array([46], np.uint32)), trailing(_TERMINAL), trailing(_OTHER)
    digits = np.add.reduceat((kind == 1).astype(np.int32), first) > 0
    hashed = mix64(lit), mix64(shp + np.uint64(5))
    return Tokens(of[start], hashed[0][final], hashed[1][final], stop, terminal, other, last, kind[first] != 3, digits, tok[part], hashed[0][part], hashed[1][part])


def _known(t: Tokens, common: np.ndarray) -> np.ndarray:
    """Which tokens are kept as they are; numbers and dates never are."""
    if not len(common):
        return np.zeros(len(t.doc), bool)
    return (common[np.minimum(np.searchsorted(common, t.literal), len(common) - 1)] == t.literal) & ~t.digits


def _before(t: Tokens, cls: np.ndarray) -> list[np.ndarray]:
    """For contexts of 1 to 4 tokens, what the tokens before the last add to the key; contexts stay within the line."""
    m = multipliers(5, salt=29)
    line = np.concatenate([[0], np.cumsum(t.last)[:-1]])
    out = [np.zeros(len(cls), np.uint64)]
    alive = np.ones(len(cls), bool)
    for k in range(1, 4):
        back, same = np.zeros(len(cls), np.uint64), np.zeros(len(cls), bool)
        back[k:], same[k:] = cls[:-k], line[k:] == line[:-k]
        alive = alive & same
        out.append(out[-1] + np.where(alive, back, np.uint64(999)) * m[k])
    return out


def _key(last: np.ndarray, before: np.ndarray, k: int, part: bool) -> np.ndarray:
    return mix64(last * multipliers(1, salt=29)[0] + before + np.uint64(k + 10 * part))


def contexts(t: Tokens, common: np.ndarray, asked: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ended): the contexts of 1 to 4 tokens that end in a token, and whether a sentence ended there, and those that end in a
    proper beginning of a token, where none ended; of them those whose key is ``asked`` for.

    Who asks for a context asks for its last token alone as well, so longer ones are looked at only after tokens asked for.
    """
    known = _known(t, common)
    cls = np.where(known, t.literal, t.shape)
    before = _before(t, cls)
    upper_next = np.ones(len(cls), bool)
    upper_next[:-1] = t.upper[1:]
    dotted = t.stop & ~t.terminal & ~t.other
    ended = np.where(dotted, t.last | upper_next, t.terminal | (t.last & ~t.other))
    part = np.where(known[t.part_of], t.part_literal, t.part_shape)
    keys, ends = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for last, of, is_part in ((cls, np.arange(len(cls)), False), (part, t.part_of, True)):
        for k, b in enumerate(before):
            key = _key(last, b[of], k, is_part)
            hit = np.flatnonzero(asked(key))
            keys.append(key[hit])
            ends.append(np.zeros(len(hit), bool) if is_part else ended[of[hit]])
            if k == 0:
                last, of = last[hit], of[hit]
    return np.concatenate(keys), np.concatenate(ends)


def _rows(df: DataFrame, key: str, fields: tuple[str, ...], source: str) -> DataFrame:
    """(id, field, source, text): one row per distinct value of each field."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    long = df.select(F.col(key).alias("id"), F.col(source).alias("source"), cells.alias("x"))
    return long.select("id", "source", "x.field", "x.text").filter(F.col("text").rlike(r"\S")).distinct()


def _common_tokens(rows: DataFrame, common: float) -> np.ndarray:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1024):
            t = tokens(b.column(0).to_pylist())
            pair = np.unique(np.stack([t.literal, t.doc.astype(np.uint64)]), axis=1) if len(t.doc) else np.zeros((2, 0), np.uint64)
            u, n = np.unique(pair[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(u), pa.array(n.astype(np.int64))], names=["token", "n"])

    n = rows.count()
    counts = rows.select("text").mapInArrow(work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    kept = counts.filter(F.col("n") >= F.lit(max(5.0, common * n))).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(kept.view(np.uint64))


def _endings(rows: DataFrame, common: float) -> DataFrame:
    """(id, field, source, chars, bytes, bare, stopped, p_end): how likely a sentence ends after the value's last tokens, and its sizes,
    of which ``bare`` is without a mark at the end."""
    sc = rows.sparkSession.sparkContext
    vocabulary = sc.broadcast(_common_tokens(rows, common))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1024):
            texts = b.column(3).to_pylist()
            bare, length = zip(*map(without_marks, texts))
            t = tokens([x.rpartition("\n")[2] for x in bare])
            at = np.flatnonzero(np.diff(t.doc, append=-1)) if len(t.doc) else np.zeros(0, np.int64)
            known = _known(t, vocabulary.value)
            cls = np.where(known, t.literal, t.shape)
            before = [x[at] for x in _before(t, cls)]
            doc = pa.array(t.doc[at])
            sizes = np.array([(len(x), len(x.encode("utf-8", "surrogatepass")), n) for x, n in zip(texts, length)], np.int32)[t.doc[at]]
            arrays = [*(b.column(i).take(doc) for i in range(3)), *(pa.array(np.ascontiguousarray(c)) for c in sizes.T)]
            arrays += [pa.array((t.stop | t.terminal)[at]), pa.array(t.other[at])]
            for last, part in ((cls, False), (t.literal, True), (t.shape, True)):
                arrays += [signed(_key(last[at], before[k], k, part)) for k in range(4)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "field", "source", "chars", "bytes", "bare", "stopped", "open", *keys])

    keys = [f"{what}{k}" for what in "xls" for k in range(4)]
    kind, of = rows.schema["id"].dataType.simpleString(), rows.schema["source"].dataType.simpleString()
    schema = f"id {kind}, field string, source {of}, chars int, bytes int, bare int, stopped boolean, open boolean, " + ", ".join(f"{k} long" for k in keys)
    tail = stage(rows.select("id", "field", "source", "text").mapInArrow(tails, schema).withColumn("r", F.monotonically_increasing_id()))
    wanted = tail.select(F.explode(F.array(*keys)).alias("key")).distinct()
    # a bitmap of fixed size says which contexts may be asked for; other bits of the key choose the bit
    words_ = wanted.select(F.shiftrightunsigned("key", 64 - _BITS).alias("bit")).distinct()
    word = words_.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(pmod(bit, 64))))").alias("v"))
    bitmap = np.zeros(1 << (_BITS - 6), np.uint64)
    filled = word.toPandas()  # a word of the bitmap a row at most
    bitmap[filled["w"].to_numpy(np.int64)] = filled["v"].to_numpy(np.int64).view(np.uint64)
    asked = sc.broadcast(bitmap)

    def in_bitmap(key: np.ndarray) -> np.ndarray:
        bit = key >> np.uint64(64 - _BITS)
        return (asked.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            k, ended = contexts(tokens(b.column(0).to_pylist()), vocabulary.value, in_bitmap)
            u, inv = np.unique(k, return_inverse=True)
            arrays = [signed(u), pa.array(np.bincount(inv, ended, len(u)).astype(np.int64)), pa.array(np.bincount(inv, minlength=len(u)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "e", "n"])

    counts = rows.select("text").mapInArrow(count, "key long, e long, n long").groupBy("key").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    each = tail.select("r", F.posexplode(F.array(*keys)).alias("k", "key")).join(counts, "key")
    by = each.groupBy("r").agg(
        *[F.max(F.when(F.col("k") == i, F.col("e"))).alias(f"e{i}") for i in range(4)],
        *[F.max(F.when(F.col("k") == i, F.col("n"))).alias(f"n{i}") for i in range(12)],
    )
    by = tail.drop(*keys).join(by, "r", "left").na.fill(0, [f"e{i}" for i in range(4)] + [f"n{i}" for i in range(12)])
    # the value's own end is left out of the counts; words that go on where the value stops count against an end
    p = F.lit(0.05)
    for k, weight in enumerate((2.0, 6.0, 6.0, 6.0)):
        e, n = F.greatest(F.col(f"e{k}") - 1, F.lit(0)), F.greatest(F.col(f"n{k}") - 1, F.lit(0))
        p = (e + weight * p) / (F.greatest(n, e) + F.col(f"n{k + 4}") + F.col(f"n{k + 8}") + weight)
    unseen = (F.col("n0") <= 1) & ~F.col("stopped")
    p_end = F.when(F.col("open"), 0.005).when(unseen, 0.003).otherwise(p)
    return by.select("id", "field", "source", "chars", "bytes", "bare", "stopped", p_end.alias("p_end"))


def _phi(z: float) -> float:
    return exp(-z * z / 2) / sqrt(2 * pi)


def _beyond(z: float) -> float:
    return max(erfc(z / sqrt(2)) / 2, 1e-12)


def fit_censored(log_len: np.ndarray, n: np.ndarray, censored: np.ndarray, prior: tuple[float, float] | None = None, rounds: int = 60) -> tuple[float, float]:
    """(mean, deviation) of right-censored normal observations by maximum likelihood (expectation-maximisation).

    ``prior`` counts as eight uncensored observations, so that small sources are near the whole.
    """
    x, w, c = log_len.astype(float), n.astype(float), censored.astype(bool)
    pm, ps, pw = (*prior, 8.0) if prior else (0.0, 0.0, 0.0)
    total = w.sum() + pw
    mu = ((w * x).sum() + pw * pm) / total
    sd = max(0.05, sqrt(max(0.0, ((w * (x - mu) ** 2).sum() + pw * (ps**2 + (pm - mu) ** 2)) / total)))
    for _ in range(rounds if c.any() else 0):
        z = (x - mu) / sd
        h = np.array([_phi(v) / _beyond(v) for v in z])
        e1 = np.where(c, mu + sd * h, x)
        e2 = np.where(c, mu * mu + sd * sd + sd * (x + mu) * h, x * x)
        new = ((w * e1).sum() + pw * pm) / total
        var = ((w * e2).sum() + pw * (ps**2 + pm**2)) / total - new * new
        done = abs(new - mu) < 1e-6
        mu, sd = new, max(0.05, sqrt(max(var, 0.0)))
        if done:
            break
    return mu, sd


def scored(df: DataFrame, *, key: str = "id", fields: tuple[str, ...] = ("content", "prevention"), source: str = "source", common: float = 0.002) -> DataFrame:
    """(id, field, source, n_chars, limit, p_end, p_cut): every value with its odds of being cut.

    ``limit`` is the candidate limit it stands at, as ``chars:1024`` or ``bytes:1000``.
    """
    rows = stage(_rows(df, key, fields, source))  # read three times: for its tokens, its endings and its contexts
    v = cut_lineage(_endings(rows, common).withColumn("unfinished", (F.col("p_end") < 0.2) & ~F.col("stopped")))
    # lengths at which unfinished values heap up
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")]))
    heap = v.select("field", "unfinished", units.alias("x")).groupBy("field", "x.unit", "x.length").agg(F.count("*").alias("n"), F.count_if("unfinished").alias("u"))
    near = Window.partitionBy("field", "unit").orderBy("length").rangeBetween(-12, 12)
    around = (F.sum("u").over(near) - F.col("u")) / 24.0
    limits = heap.withColumn("around", around).filter((F.col("u") >= 3) & (F.col("u") >= 4 * F.col("around") + 2) & (F.col("u") * 2 >= F.col("n")))
    limits = cut_lineage(limits.select("field", "unit", "length", (F.col("u") / F.col("n")).alias("heaped")))
    at = v.select("id", "field", "source", units.alias("x")).select("id", "field", "source", "x.unit", "x.length").join(limits, ["field", "unit", "length"])
    best = at.groupBy("id", "field", "source").agg(F.max_by(F.struct(F.concat_ws(":", "unit", "length").alias("limit"), "heaped"), "heaped").alias("l"))
    same = (F.col("v.id") == F.col("b.id")) & (F.col("v.field") == F.col("b.field")) & F.col("v.source").eqNullSafe(F.col("b.source"))
    v = v.alias("v").join(best.alias("b"), same, "left").select("v.*", F.col("l.limit").alias("limit"), F.col("l.heaped").alias("heaped"))
    v = cut_lineage(v.withColumn("censored", F.col("limit").isNotNull() & F.col("unfinished")))
    # one distribution per source and field from counts of lengths, near that of the field where there are few
    counts = v.groupBy("field", "source", "chars", "censored").agg(F.count("*").alias("n"))
    whole = {}
    bins = counts.groupBy("field", F.round(F.log("chars"), 2).alias("x"), "censored").agg(F.sum("n").alias("n")).toPandas()  # by hundredths of a logarithm: some thousand rows
    for f, part in bins.groupby("field"):
        whole[f] = fit_censored(part["x"].to_numpy(), part["n"].to_numpy(), part["censored"].to_numpy())

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf["field"].iloc[0]
        mu, sd = fit_censored(np.log(pdf["chars"].to_numpy(float)), pdf["n"].to_numpy(), pdf["censored"].to_numpy(), whole[f])
        n, c = int(pdf["n"].sum()), int(pdf.loc[pdf["censored"], "n"].sum())
        return pd.DataFrame({"field": [f], "source": [pdf["source"].iloc[0]], "mu": [mu], "sd": [sd], "share": [(c + 0.5) / (n + 10)]})

    fitted = counts.groupBy("field", "source").applyInPandas(fit, "field string, source string, mu double, sd double, share double")
    off = v.filter("limit IS NULL").groupBy("field").agg(((F.count_if("unfinished") + 1) / (F.count("*") + 20)).alias("broken"))

    @F.pandas_udf("double")
    def censoring(chars: pd.Series, mu: pd.Series, sd: pd.Series, share: pd.Series) -> pd.Series:
        z = (np.log(chars.to_numpy(float)) - mu.to_numpy()) / sd.to_numpy()
        beyond = np.array([_beyond(x) for x in z])
        density = np.exp(-z * z / 2) / (sqrt(2 * pi) * sd.to_numpy() * chars.to_numpy(float))
        s = share.to_numpy()
        return pd.Series(s * beyond / (s * beyond + (1 - s) * density + 1e-300))

    j = v.join(F.broadcast(off), "field").alias("v").join(fitted.alias("f"), (F.col("v.field") == F.col("f.field")) & F.col("v.source").eqNullSafe(F.col("f.source")))
    j = j.select("v.*", "mu", "sd", "share").withColumn("prior", F.when(F.col("limit").isNotNull(), censoring("chars", "mu", "sd", "share")).otherwise(F.col("broken")))
    marked = F.col("bare") < F.col("chars")
    # of cut values few stop after an end mark, of finished ones few without
    shown = F.when(F.col("stopped"), F.lit(log(0.03 / 0.95))).when(marked, F.lit(log(0.2 / 0.004))).otherwise(F.lit(log(0.75 / 0.05)))
    ending = F.log((1 - F.col("p_end")) / F.col("p_end")) - log(0.95 / 0.05)
    logit = F.log(F.col("prior") / (1 - F.col("prior") + 1e-12)) + shown + ending
    return j.select("id", "field", "source", F.col("chars").alias("n_chars"), "limit", "stopped", "p_end", "prior", (1 / (1 + F.exp(-logit))).alias("p_cut"))


def cut_values(df: DataFrame, *, least: float = 0.5, **options) -> DataFrame:
    """(id, field, limit, p_cut): the values that were cut."""
    return scored(df, **options).filter(F.col("p_cut") >= least).select("id", "field", "limit", "p_cut")


def cut_shares(df: DataFrame, *, least: float = 0.5, **options) -> DataFrame:
    """(source, field, n_values, n_cut, share): how often each source's fields were cut."""
    by = scored(df, **options).groupBy("source", "field")
    return by.agg(F.count("*").alias("n_values"), F.count_if(F.col("p_cut") >= least).alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_values"))
