"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF word shingles.

1. Exact copies become one class each; a class is represented by its least key.
2. Document frequencies of all shingles are counted over all texts. Inverse document
   frequencies are clipped at both ends: shingles in fewer texts than the share ``rare``
   weigh alike, so only the others need be known to the workers. A text has S shingles
   on average, thus at most S / ``rare`` shingles are that frequent, and that bounds
   what is broadcast. The commonest weigh LEAST_WEIGHT of a rare one.
3. Every class gets ``bands * rows`` consistent weighted samples of its shingles, weight
   term frequency times inverse document frequency; two texts agree in a sample with a
   chance equal to their weighted Jaccard similarity.
   For the plain measure a shingle weighs by its inverse document frequency alone, in levels between
   LEAST_PLAIN and 1. So a pair of plain similarity s has a weighted one of at least
   ``weighted_bound(s)``, however common the shingles of a group are, and bands and rows
   follow from that bound at the threshold. Rows of bands carry the number of shingles
   and one bit of each of 128 of the samples; pairs whose sizes rule the threshold out, or
   whose bits differ too often for it, are no candidates.
4. Classes that agree in a whole band are candidates. Bands that many classes share, as
   samples of the classes tell, are cut into blocks, and each pair of blocks is a key of
   its own in the equi-join, so no task compares a hot band alone. Each candidate pair
   is verified on the texts by weighted or plain Jaccard similarity.
5. Pairs of classes become pairs of keys. Classes of up to ``expand`` keys in a table are
   written out there; a larger one takes part through its least key, and its copies are
   linked to that key, so no link between different texts is lost and output stays linear in copies.

Nulls and edge cases: null texts and texts with fewer words than a shingle take part in
no pair, nor do texts all of whose shingles weigh nothing; rows repeated whole count
once; texts of any length are read whole; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.wordstream import kgrams, mix64, multipliers, words
from sieveline.llm._batches import pieces, signed
from sieveline.llm.components import components
from sieveline.session import cut, stage

_LEVELS = 4096
#: The weight of the commonest shingle as a share of a rare one's. Shingles of a group that holds a large part of all
#: texts are common; with a weight near 0 small edits would outweigh all that the group shares.
LEAST_WEIGHT = 0.35
#: Bands and rows of the weighted measure: a pair of weighted similarity s is a candidate with chance 1 - (1 - s ** 5) ** 44.
WEIGHTED_BANDS = (44, 5)
#: The weight of the commonest shingle as a share of a rare one's by the plain measure.
LEAST_PLAIN = 0.95
#: Weights by the plain measure are rounded to so many levels.
PLAIN_LEVELS = 8
#: Chance at the least of a pair at the threshold to be a candidate by the plain measure.
PLAIN_RECALL = 0.992
#: Classes in a band beyond which it is cut into blocks of this size, and the share of the classes looked at to find such bands.
HOT_BAND, HOT_SHARE = 4096, 64
#: The hottest bands, so many at most, are told to the tasks (16 bytes each); the others stay whole, which changes no result.
MOST_HOT = 1 << 20


def _gamma2_quantiles(n: int) -> np.ndarray:
    """Mid-quantiles of the Gamma(2, 1) distribution, whose distribution function is 1 - (1 + x) exp(-x)."""
    q = (np.arange(n) + 0.5) / n
    x = np.full(n, 1.7)
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(80):
        below = 1 - (1 + x) * np.exp(-x) < q
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
        x = (lo + hi) / 2
    return x


class Sampler:
    """Consistent weighted samples; the random variates of a shingle come from its hash, through tables of quantiles."""

    def __init__(self, samples: int):
        g = _gamma2_quantiles(_LEVELS)
        self.r, self.inverse_r, self.log_c = g.astype(np.float32), (1 / g).astype(np.float32), np.log(g).astype(np.float32)
        self.beta = ((np.arange(_LEVELS) + 0.5) / _LEVELS).astype(np.float32)
        self.by_sample = multipliers(samples, salt=101)

    def samples(self, ids: np.ndarray, log_weight: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row of sample hashes for each text; its shingles are ids[starts : starts + sizes], sizes above 0."""
        out = np.empty((len(starts), len(self.by_sample)), np.uint64)
        log_weight = log_weight.astype(np.float32)
        low = np.uint64(_LEVELS - 1)
        of = np.repeat(np.arange(len(starts)), sizes)
        for k, m in enumerate(self.by_sample):
            x = ids * m
            i = (x >> np.uint64(52)).astype(np.int32)
            beta = self.beta[((x >> np.uint64(28)) & low).astype(np.int32)]
            t = np.floor(log_weight * self.inverse_r[i] + beta)
            a = self.log_c[((x >> np.uint64(40)) & low).astype(np.int32)] - self.r[i] * (t - beta + np.float32(1))
            least = np.minimum.reduceat(a, starts)
            at = np.flatnonzero(a == least[of])
            first = at[np.flatnonzero(np.diff(of[at], prepend=-1))]
            out[:, k] = ids[first] * np.uint64(0x9E3779B97F4A7C15) + t[first].astype(np.int64).view(np.uint64) * m
        return mix64(out)


class GlobalSampler:
    """Consistent weighted samples where a shingle weighs the same in every text, in one of a few levels of weight.

    The step that the samples of ``Sampler`` carry with a shingle then follows from the shingle, so a sample is the shingle
    alone, and what a level makes of the variates r and beta is a table. A sample is the least of one number a
    shingle, whose upper half is what consistent sampling minimises and whose lower half names the shingle.
    """

    R, B, C, UNIT = 128, 128, 4096, 1 << 26

    def __init__(self, samples: int, weights: np.ndarray):
        r = _gamma2_quantiles(self.R)[None, :, None]
        beta = ((np.arange(self.B) + 0.5) / self.B)[None, None, :]
        t = np.floor(np.log(weights)[:, None, None] / r + beta)
        self.drop = np.rint(r * (t - beta + 1) * self.UNIT).astype(np.uint32).ravel()
        self.top = np.rint((np.log(_gamma2_quantiles(self.C)) + 40) * self.UNIT).astype(np.uint32)
        self.by_sample = multipliers(samples, salt=101)

    def samples(self, ids: np.ndarray, level: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of sample hashes for each text; its shingles are those from its start to the next text's."""
        out = np.empty((len(starts), len(self.by_sample)), np.uint64)
        base = level.astype(np.int64) << 14
        for k, m in enumerate(self.by_sample):
            x = ids * m
            a = self.top[((x >> np.uint64(38)) & np.uint64(self.C - 1)).view(np.int64)]
            a -= self.drop[(x >> np.uint64(50)).view(np.int64) + base]
            x &= np.uint64(0xFFFFFFFF)
            x |= a.astype(np.uint64) << np.uint64(32)
            out[:, k] = np.minimum.reduceat(x, starts)
        out &= np.uint64(0xFFFFFFFF)
        return mix64(out * self.by_sample)


def weighted_bound(s: float) -> float:
    """The least weighted similarity of a pair of plain similarity ``s`` if weights are between LEAST_PLAIN and 1."""
    return s * LEAST_PLAIN / (s * LEAST_PLAIN + 1 - s)


def plain_bands(threshold: float) -> tuple[int, int]:
    """(bands, rows) that find a pair at the plain ``threshold`` with a chance of PLAIN_RECALL: five rows, or fewer where that takes more than 128 bands."""
    w = min(weighted_bound(threshold), 0.99)
    for rows in range(5, 0, -1):
        bands = int(np.ceil(np.log(1 - PLAIN_RECALL) / np.log1p(-(w**rows))))
        if bands <= 128:
            break
    return bands, rows


def most_differing(threshold: float) -> int:
    """Of 128 bits, each of one sample: the most in which a pair at the plain ``threshold`` differs, but for one pair in some 7,000."""
    p = (1 - weighted_bound(threshold)) / 2
    return int(128 * p + 3.65 * np.sqrt(128 * p * (1 - p)))


def in_blocks(band: np.ndarray, c: np.ndarray, hot: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, band, side): rows whose band is ``hot`` (rising) go to each pair of its blocks that they are in, under a band of the pair's own.

    A row is in one block, by its class ``c``. It is on side 1 of the pairs whose first block that is and on side 2 of those whose
    second block it is, so that any two rows meet once with the first on side 1. Other rows are on side 0.
    """
    if not len(hot):
        return np.arange(len(band)), band, np.zeros(len(band), np.int8)
    at = np.minimum(np.searchsorted(hot, band), len(hot) - 1)
    nb = np.where(hot[at] == band, blocks[at], 0)
    cold, many = np.flatnonzero(nb == 0), np.flatnonzero(nb)
    row = np.repeat(many, nb[many])
    n = nb[row]
    own = (mix64(c[row].astype(np.int64).view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
    other = np.arange(len(row)) - np.repeat(np.cumsum(nb[many]) - nb[many], nb[many])
    pair = lambda i, j: mix64(band[row].view(np.uint64) + mix64((i * n + j + 1).view(np.uint64))).view(np.int64)
    side = np.repeat(np.array([0, 1, 2], np.int8), [len(cold), len(row), len(row)])
    return np.concatenate([cold, row, row]), np.concatenate([band[cold], pair(own, other), pair(other, own)]), side


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, times): the distinct shingles of each text of a small batch, in order."""
    w = words(texts, "lower")
    h, at = kgrams(w, k)
    if len(texts) > 1024:
        raise ValueError("a batch has 1024 texts at most")
    key = np.sort((w.doc[at].astype(np.uint64) << np.uint64(54)) | (h >> np.uint64(10)))
    new = np.flatnonzero(np.diff(key, prepend=np.uint64(0) if len(key) and key[0] else np.uint64(1)))
    if len(key) and (not len(new) or new[0] != 0):
        new = np.concatenate([[0], new])
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(54)).astype(np.int64), key & np.uint64((1 << 54) - 1), times


def _weights(ids: np.ndarray, times: np.ndarray, frequent: np.ndarray, idf: np.ndarray, top: float) -> np.ndarray:
    w = np.full(len(ids), top)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, ids), len(frequent) - 1)
        w = np.where(frequent[at] == ids, idf[at], top)
    return w * times


def _frequencies(classes: DataFrame, k: int) -> DataFrame:
    """(shingle, n): in how many texts each shingle is, copies counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids, n = (np.concatenate(x) for x in zip(*kept))
            u, inv = np.unique(ids, return_inverse=True)
            return pa.RecordBatch.from_arrays([signed(u), pa.array(np.bincount(inv, n, len(u)).astype(np.int64))], names=["shingle", "n"])

        for b in pieces(batches):
            doc, ids, _ = shingles(b.column(0).to_pylist(), k)
            kept.append((ids, b.column(1).to_numpy()[doc].astype(np.float64)))
            held += len(ids)
            if held > 1_500_000:
                yield flush()
                kept, held = [], 0
        if kept:
            yield flush()

    return classes.select("content", "m").mapInArrow(work, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def text_classes(df: DataFrame, text: str) -> DataFrame:
    """(h1, h2, c, m, content): one row per distinct text with its least key ``c`` and its number of keys ``m``."""
    keyed = df.filter(F.col(text).isNotNull()).select("c", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.col(text)).alias("h2"), F.col(text).alias("content"))
    sizes = keyed.select("h1", "h2", "c").distinct().groupBy("h1", "h2").agg(F.count("*").alias("m"))  # apart, so that texts are shuffled once
    out = keyed.groupBy("h1", "h2").agg(F.min("c").alias("c"), F.min("content").alias("content"))
    return out.join(sizes, ["h1", "h2"]).select("h1", "h2", "c", "m", "content")


def similar_classes(
    classes: DataFrame, *, words_per_shingle: int, threshold: float, measure: str, bands: int, rows: int, rare: float
) -> DataFrame:
    """(a, b, similarity): pairs of class keys whose texts are alike at least by ``threshold``."""
    plain = measure == "plain"
    top = float(np.log(1 / rare))
    n = classes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    common = _frequencies(classes, words_per_shingle).filter(F.col("n") >= F.lit(rare * n)).toPandas()
    frequent = common["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    frequent, times_ = frequent[order], common["n"].to_numpy(np.float64)[order]
    idf = np.log(max(1, n) / np.maximum(1, times_))
    idf = np.clip(idf, 0.0 if plain else LEAST_WEIGHT * top, top)
    if plain:  # as levels of the narrow range
        idf = np.rint(idf / top * (PLAIN_LEVELS - 1))
    range_ = top * np.linspace(LEAST_PLAIN, 1, PLAIN_LEVELS)
    shared = classes.sparkSession.sparkContext.broadcast((frequent, idf, top))

    def sign(batches: Iterator[pa.RecordBatch], hot: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sampler = GlobalSampler(bands * rows, range_) if plain else Sampler(bands * rows)
        frequent, idf, top = shared.value
        m = multipliers(rows, salt=303)
        for b in pieces(batches):
            doc, ids, times = shingles(b.column(1).to_pylist(), words_per_shingle)
            if not len(doc):
                continue
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            sizes = np.diff(np.append(starts, len(doc)))
            weight = _weights(ids, np.ones(len(ids)) if plain else times, frequent, idf, PLAIN_LEVELS - 1 if plain else top)
            h = sampler.samples(ids, weight, starts) if plain else sampler.samples(ids, np.log(weight), starts, sizes)
            # a bit of each of the first 128 samples
            low = np.resize((h[:, :128] & np.uint64(1)).T, (128, len(h))).T
            bits, more_bits = ((low[:, x : x + 64] << np.arange(64, dtype=np.uint64)).sum(axis=1) for x in (0, 64))
            h = (h.reshape(len(starts), bands, rows) * m).sum(axis=2) + np.arange(bands, dtype=np.uint64)
            band = signed(mix64(h).ravel()).to_numpy()
            at, band, side = in_blocks(band, b.column(0).to_numpy()[np.repeat(doc[starts], bands)], *hot)
            of = at // bands
            more = [signed(bits[of]), signed(more_bits[of]), pa.array(sizes[of].astype(np.int32))] if plain else []
            arrays = [b.column(0).take(pa.array(doc[starts][of])), pa.array(band), pa.array(side), *more]
            yield pa.RecordBatch.from_arrays(arrays, names=["c", "band", "side", "bits", "more_bits", "size"][: 3 + len(more)])

    schema = "c long, band long, side byte" + ", bits long, more_bits long, size int" * plain
    no_hot = np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = classes.filter(F.pmod(F.xxhash64("c"), F.lit(HOT_SHARE)) == 0).select("c", "content").mapInArrow(partial(sign, hot=no_hot), schema)
    counts = some.groupBy("band").agg(F.ceil(F.count("*") * HOT_SHARE / HOT_BAND).alias("nb")).filter("nb > 1")
    found = counts.orderBy(F.desc("nb")).limit(MOST_HOT).toPandas().sort_values("band")
    hot = found["band"].to_numpy(np.int64), found["nb"].to_numpy(np.int64)
    signed_ = classes.select("c", "content").mapInArrow(partial(sign, hot=hot), schema)
    meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.c") < F.col("y.c"))
    meet &= (F.col("x.side") * 3 + F.col("y.side")).isin(0, 5)  # 0 with 0, 1 with 2; a condition on one side alone would keep both from sharing a shuffle
    if plain:
        meet &= F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * F.lit(threshold - 1e-9)
        differ = sum(F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in ("bits", "more_bits"))
        meet &= differ <= most_differing(threshold)
    pairs = signed_.alias("x").join(signed_.alias("y"), meet)
    pairs = pairs.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()
    texts = classes.select("c", "content")
    both = pairs.join(texts.withColumnsRenamed({"c": "a", "content": "ta"}), "a").join(texts.withColumnsRenamed({"c": "b", "content": "tb"}), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, idf, top = shared.value
        for p in pieces(batches, 512):
            n = p.num_rows
            doc, ids, times = shingles([*p.column(2).to_pylist(), *p.column(3).to_pylist()], words_per_shingle)
            w = np.ones(len(ids)) if plain else _weights(ids, times, frequent, idf, top)
            pair, second = doc % n, doc >= n
            order = np.lexsort((second, ids, pair))
            pair, ids, w = pair[order], ids[order], w[order]
            same = np.flatnonzero((pair[1:] == pair[:-1]) & (ids[1:] == ids[:-1]))
            both_ = np.bincount(pair[same], np.minimum(w[same], w[same + 1]), n)
            either = np.bincount(pair, w, n) - both_
            sim = np.divide(both_, either, out=np.zeros(n), where=either > 0)
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(sim)], names=["a", "b", "similarity"])

    checked = both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long, similarity double")
    return checked.filter(F.col("similarity") >= threshold)


def _keyed(tables: dict[str, DataFrame], key: str, text: str) -> DataFrame:
    """(c, t, id, content) of all tables; ``c`` numbers the records of all tables apart."""
    parts = [
        df.select((F.col(key) * len(tables) + t).alias("c"), F.lit(t).alias("t"), F.col(key).alias("id"), F.col(text).alias("content"))
        for t, df in enumerate(tables.values())
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("id IS NOT NULL AND content IS NOT NULL")


def _wordy(text, k: int):
    """Whether a text has at least ``k`` words."""
    return F.size(F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x != "")) >= k


def near_pairs(
    tables: dict[str, DataFrame], *, key: str = "id", text: str = "content", words_per_shingle: int = 5, threshold: float = 0.8,
    measure: str = "weighted", bands: int | None = None, rows: int | None = None, rare: float = 0.001, expand: int = 32,
) -> DataFrame:
    """(rec_table, id_a, id_b, similarity): pairs of keys of one table whose texts are alike, smaller key first."""
    if measure not in ("weighted", "plain"):
        raise ValueError("measure is weighted or plain")
    usual = WEIGHTED_BANDS if measure == "weighted" else plain_bands(threshold)
    bands, rows = bands or usual[0], rows or usual[1]
    rows_ = _keyed(tables, key, text)
    members = rows_.select(F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(1), F.col("content")).alias("h2"), "t", "id").distinct()
    classes = stage(text_classes(rows_.select("c", "content"), "content"))
    alike = cut(
        similar_classes(classes, words_per_shingle=words_per_shingle, threshold=threshold, measure=measure, bands=bands, rows=rows, rare=rare)
    )
    # members that are written out: all of a small class, the least of each table of a large one
    m = members.join(classes.select("h1", "h2", "c"), ["h1", "h2"]).select("c", "t", "id")
    first = m.groupBy("c", "t").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    m = m.join(first.select("c", "t", "m"), ["c", "t"])
    out = m.filter(F.col("m") <= expand).select("c", "t", "id").unionByName(first.filter(F.col("m") > expand).select("c", "t", "id"))
    cross = (
        alike.join(out.withColumnsRenamed({"c": "a", "id": "ia"}), "a")
        .join(out.withColumnsRenamed({"c": "b", "id": "ib"}), ["b", "t"])
        .select("t", "ia", "ib", "similarity")
    )
    copied = classes.filter("m > 1").filter(_wordy("content", words_per_shingle)).select("c")
    mc = m.filter("m > 1").join(copied, "c", "left_semi")
    small = mc.filter(F.col("m") <= expand).select("c", "t", F.col("id").alias("ia"))
    inner = small.join(small.withColumnRenamed("ia", "ib"), ["c", "t"]).filter("ia < ib")
    star = mc.filter(F.col("m") > expand).join(first.select("c", "t", F.col("id").alias("ia")), ["c", "t"]).select("c", "t", "ia", F.col("id").alias("ib"))
    copies = inner.select("t", "ia", "ib").unionByName(star.select("t", "ia", "ib")).withColumn("similarity", F.lit(1.0))
    pairs = cross.unionByName(copies).filter("ia <> ib")
    name = F.element_at(F.array(*[F.lit(x) for x in tables]), F.col("t") + 1)
    return pairs.groupBy(name.alias("rec_table"), F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def near_groups(tables: dict[str, DataFrame], *, key: str = "id", **options) -> DataFrame:
    """(rec_table, id, group_id, n_links): every record that has a near duplicate in its table, with the least key of its group.

    ``n_links`` counts the record's partners as near_pairs writes them.
    """
    pairs = cut(near_pairs(tables, key=key, **options))
    coded = pairs.select(F.struct("rec_table", F.col("id_a").alias("id")).alias("a"), F.struct("rec_table", F.col("id_b").alias("id")).alias("b"))
    groups = components(coded)
    ends = coded.select(F.col("a").alias("node")).unionByName(coded.select(F.col("b").alias("node")))
    links = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    return groups.join(links, "node").select("node.rec_table", "node.id", F.col("component.id").alias("group_id"), "n_links")
