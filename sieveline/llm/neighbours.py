"""The k most similar vectors of every vector, by an inverted multi-index.

Both halves of the unit vectors, turned so that both hold alike much of the variance, are
quantised separately by k-means codebooks, so K centroids a half give K * K cells. A
query visits cells in the order of the summed distances of their two centroids, by the
multi-sequence heap over its sorted half distances, until the cells it has visited hold
``quota`` entries (or ``share`` of all, if that is more); how many entries each cell holds
is known to all tasks. All entries of the visited cells are compared exactly. The heaps of
a batch of queries lie in arrays and step together.

On the cluster: first-half centroids that lie close together form a region. Vectors are
filed under the region of their cell, queries are sent to the regions of their cells with
the list of cells to look at there, and a region with many vectors or queries is split
into a grid of blocks. A task thus holds about ``block_rows`` vectors and ``query_rows``
queries, and beyond ``min_regions`` regions grow in number, not in size. Equal vectors are one entry with its
least keys, so copies cost nothing in the search.

Fitted on a bounded sample: rotation and codebooks, on about ``sample_rows`` vectors with
the least hash, which also tells how many queries a region is to expect. Everything else
covers all rows. The defaults compare a query with a tenth of all vectors at least: where
the vectors fill some fifty dimensions evenly, as in the test tables, true neighbours are
that far from each other, and a fixed quota would lose more of them the more vectors
there are. Where only close neighbours count (``min_cosine``), a small quota is enough.

Nulls and edge cases: vectors that are null, of
another width, all zero, or have a null or non-finite element take no part; equal
cosines go to the smaller key; a vector with fewer than k others has as many
neighbours as there are; rows repeated whole count once; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm._batches import hashed_sample, pieces
from sieveline.session import stage

def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids of a sample that is in memory; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32).copy()
    for _ in range(rounds):
        a = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances but for the term that all centroids share."""
    return (c * c).sum(1) - 2 * (x @ c.T)


class CellHeaps:
    """The multi-sequence heaps of a batch of queries, one row a query; all queries step together.

    Entries are pairs (i, j) of places in the sorted half distances. A pair (i, j) brings (i, j + 1) when it is
    taken, and (i + 1, 0) as well where j is 0, so that every pair comes in once.
    """

    def __init__(self, d1: np.ndarray, d2: np.ndarray):
        self.o1, self.o2 = (np.argsort(d, axis=1, kind="stable").astype(np.int32) for d in (d1, d2))
        self.s1, self.s2 = np.take_along_axis(d1, self.o1, 1), np.take_along_axis(d2, self.o2, 1)
        n, room = len(d1), 7
        self.key, self.i, self.j = np.full((n, room), np.inf, np.float32), np.zeros((n, room), np.int32), np.zeros((n, room), np.int32)
        self.size = np.ones(n, np.int64)
        self.key[:, 0] = self.s1[:, 0] + self.s2[:, 0]

    def keep(self, rows: np.ndarray) -> None:
        """Goes on with some of the queries."""
        for name in ("o1", "o2", "s1", "s2", "key", "i", "j", "size"):
            setattr(self, name, getattr(self, name)[rows])

    def _swap(self, r: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        for x in (self.key, self.i, self.j):
            x[r, a], x[r, b] = x[r, b], x[r, a]

    def _push(self, r: np.ndarray, i: np.ndarray) -> None:
        """Brings the pair (i, 0) to the heaps ``r``."""
        if not len(r):
            return
        at = self.size[r]
        if at.max() >= self.key.shape[1]:
            more = ((0, 0), (0, self.key.shape[1] + 1))
            self.key, self.i, self.j = np.pad(self.key, more, constant_values=np.inf), np.pad(self.i, more), np.pad(self.j, more)
        self.key[r, at], self.i[r, at], self.j[r, at] = self.s1[r, i] + self.s2[r, 0], i, 0
        self.size[r] += 1
        while len(r):
            up = (at - 1) >> 1
            rises = at > 0
            rises[rises] = self.key[r[rises], at[rises]] < self.key[r[rises], up[rises]]
            r, at, up = r[rises], at[rises], up[rises]
            self._swap(r, at, up)
            at = up

    def _sink(self) -> None:
        """Lets the roots sink to their places."""
        r, at = np.arange(len(self.key)), np.zeros(len(self.key), np.int64)
        room = self.key.shape[1]
        while len(r):
            inside = 2 * at + 1 < room
            r, at = r[inside], at[inside]
            left, right = 2 * at + 1, np.minimum(2 * at + 2, room - 1)
            a, b = self.key[r, left], self.key[r, right]
            child = np.where(b < a, right, left)
            sinks = np.minimum(a, b) < self.key[r, at]
            r, at, child = r[sinks], at[sinks], child[sinks]
            self._swap(r, at, child)
            at = child

    def take(self) -> np.ndarray:
        """Each query's next cell, i * K + j in terms of centroids; -1 where there is none."""
        r = np.arange(len(self.key))
        i, j = self.i[:, 0].copy(), self.j[:, 0].copy()
        some = self.size > 0
        cell = np.where(some, self.o1[r, i].astype(np.int64) * self.o2.shape[1] + self.o2[r, j], -1)
        goes = some & (j + 1 < self.o2.shape[1])
        g = r[goes]
        self.j[g, 0] += 1
        self.key[g, 0] = self.s1[g, i[goes]] + self.s2[g, j[goes] + 1]
        ends = r[some & ~goes]  # the last entry comes to the root where a row has ended
        last = self.size[ends] - 1
        for x in (self.key, self.i, self.j):
            x[ends, 0] = x[ends, last]
        self.key[ends, last] = np.inf
        self.size[ends] = last
        self._sink()
        new = some & (j == 0) & (i + 1 < self.o1.shape[1])
        self._push(r[new], i[new] + 1)
        return cell


def visited(d1: np.ndarray, d2: np.ndarray, entries: np.ndarray, quota: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell) in the order of the heaps until a query's cells hold ``quota`` of the ``entries``; cells without any are left out."""
    heaps, who, got = CellHeaps(d1, d2), np.arange(len(d1)), np.zeros(len(d1), np.int64)
    queries, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(who):
        cell = heaps.take()
        n = np.where((cell >= 0) & (got < quota), entries[np.maximum(cell, 0)], 0)
        queries.append(who[n > 0])
        cells.append(cell[n > 0])
        got += n
        on = (got < quota) & (cell >= 0)
        if on.sum() < 0.8 * len(on):  # those that are done are taken out now and then
            heaps.keep(on)
            who, got = who[on], got[on]
    return np.concatenate(queries), np.concatenate(cells)


def _vectors(col: pa.Array, width: int) -> np.ndarray:
    """Binary cells of float32 as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, width)


def balanced_rotation(sample: np.ndarray) -> np.ndarray:
    """Axes along the directions of most variance, dealt so that both halves hold alike much of it."""
    _, axes = np.linalg.eigh(np.cov(sample.astype(np.float64).T) if len(sample) > 1 else np.eye(sample.shape[1]))
    place = np.arange(axes.shape[1])[::-1]
    turn = np.argsort(np.isin(np.arange(len(place)) % 4, (1, 2)), kind="stable")  # 1st, 4th, 5th, 8th ... to the first half
    return np.ascontiguousarray(axes[:, place[turn]], np.float32)


def usable(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(id, v): the records whose vector can be compared."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = df.filter((F.size(vector) == width) & fine & F.exists(vector, lambda x: x != 0) & F.col(key).isNotNull())
    return v.select(F.col(key).alias("id"), F.col(vector).alias("v"))


def neighbours(
    df: DataFrame, *, key: str = "id", vector: str = "embedding", width: int = 64, k: int = 5, queries=None, quota: int = 2048, share: float = 0.1,
    min_cosine: float | None = None, cell_rows: int = 16, max_centroids: int = 1024, sample_rows: int = 20_000, block_rows: int = 60_000, query_rows: int = 150_000, min_regions: int = 8,
) -> DataFrame:
    """(id, neighbour, cosine, rank): for every query the ``k`` most similar other vectors found.

    ``queries`` is a predicate over the column ``id``, all rows by default. A query is compared with the entries of
    the nearest cells that hold ``quota`` of them or ``share`` of all, whichever is more. ``min_cosine`` leaves
    out less similar neighbours. More than ``max_centroids`` a half are not fitted; cells then hold more entries, and
    no result changes by that but for the order in which they are visited.
    """
    rows = usable(df, key, vector, width)
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2")]
    members = rows.select("id", *hashes).distinct()
    classes = rows.select("id", "v", *hashes).groupBy("h1", "h2").agg(F.min("id").alias("c"), F.min("v").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4096):
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["c", "v"])

    vectors = stage(classes.select("c", "v").mapInArrow(unit, "c long, v binary"))
    n = vectors.count()
    out_schema = "c long, nc long, cosine float"
    if n:
        sample = np.stack([np.frombuffer(r["v"], np.float32) for r in sorted(hashed_sample(vectors, ["c"], sample_rows).collect())])
        half = width // 2
        kk = int(np.clip(round((n / cell_rows) ** 0.5), 1, max_centroids))
        turn = balanced_rotation(sample)
        turned = sample @ turn
        c1, c2 = kmeans(turned[:, :half], kk), kmeans(turned[:, half:], kk, seed=1)
        most = max(quota, int(np.ceil(share * n)))
        groups = kmeans(c1, min(len(c1), max(min_regions, round(n / block_rows))), seed=2)
        region = _distances(c1, groups).argmin(1).astype(np.int32)  # of each first-half centroid
        sc = vectors.sparkSession.sparkContext
        index = sc.broadcast((turn, c1, c2, region))

        def file_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn, c1, c2, region = index.value
            for b in pieces(batches, 4096):
                x = _vectors(b.column(1), width) @ turn
                i, j = _distances(x[:, :half], c1).argmin(1), _distances(x[:, half:], c2).argmin(1)
                arrays = [pa.array(region[i]), b.column(0), pa.array((i * len(c2) + j).astype(np.int32)), b.column(1)]
                yield pa.RecordBatch.from_arrays(arrays, names=["g", "c", "cell", "v"])

        filed = stage(vectors.mapInArrow(file_, "g int, c long, cell int, v binary"))
        held = filed.groupBy("cell").agg(F.count("*").alias("n")).toPandas()  # as many rows as cells at most
        entries = np.zeros(len(c1) * len(c2), np.int32)
        entries[held["cell"].to_numpy()] = held["n"].to_numpy()
        known = sc.broadcast(entries)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Queries to the regions of their cells, with the cells to look at there."""
            turn, c1, c2, region = index.value
            for b in pieces(batches, 2048):
                x = _vectors(b.column(1), width) @ turn
                q, cell = visited(_distances(x[:, :half], c1), _distances(x[:, half:], c2), known.value, most)
                g = region[cell // len(c2)]
                order = np.lexsort((cell, g, q))
                q, g, cell = q[order], g[order], cell[order].astype(np.int32)
                first = np.flatnonzero(np.diff(q * (int(region.max()) + 1) + g, prepend=-1))
                lists = [cell[s:e].tobytes() for s, e in zip(first, np.append(first[1:], len(q)))]
                at = pa.array(q[first])
                arrays = [pa.array(g[first]), b.column(0).take(at), pa.array(lists, pa.binary()), b.column(1).take(at)]
                yield pa.RecordBatch.from_arrays(arrays, names=["g", "c", "cells", "v"])

        asking, n_asking = vectors, n
        if queries is not None:
            wanted = members.filter(queries).select("h1", "h2").distinct()
            asking = stage(vectors.join(classes.select("h1", "h2", "c").join(wanted, ["h1", "h2"], "left_semi").select("c"), "c", "left_semi"))
            n_asking = asking.count()
        asked = asking.mapInArrow(ask, "g int, c long, cells binary, v binary")

        # how many queries a region gets is told from some of the sample; it only decides into how many blocks it is split
        some = turned[:1024]
        q, cell = visited(_distances(some[:, :half], c1), _distances(some[:, half:], c2), entries, most)
        to = np.unique(np.stack([q, region[cell // len(c2)]]), axis=1)[1]
        expected = np.bincount(to, minlength=len(groups)) * (1.1 * n_asking / len(some)) + 1
        by_region = filed.groupBy("g").agg(F.count("*").alias("n")).collect()  # as many rows as regions
        sizes = [(r["g"], -(-r["n"] // block_rows), int(-(-expected[r["g"]] // query_rows))) for r in by_region]
        sizes = F.broadcast(vectors.sparkSession.createDataFrame(sizes, "g int, ni int, nq int"))

        def every(n: str):
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        left = filed.join(sizes, "g").withColumn("bi", F.pmod(F.xxhash64("c"), F.col("ni")).cast("int")).withColumn("bq", every("nq"))
        right = asked.join(sizes, "g").withColumn("bq", F.pmod(F.xxhash64("c"), F.col("nq")).cast("int")).withColumn("bi", every("ni"))
        floor_ = -2.0 if min_cosine is None else min_cosine - 1e-6

        def block(a: pa.Table, q: pa.Table) -> pa.Table:
            kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if a.num_rows and q.num_rows:
                ids, cell = a["c"].to_numpy(), a["cell"].to_numpy()
                order = np.argsort(cell, kind="stable")
                ids, cell, x = ids[order], cell[order], _vectors(a["v"], width)[order]
                qid, y = q["c"].to_numpy(), _vectors(q["v"], width)
                lists = q["cells"].to_pylist()
                probe = np.frombuffer(b"".join(lists), np.int32)
                of = np.repeat(np.arange(len(qid)), np.fromiter((len(z) // 4 for z in lists), np.int64, len(lists)))
                present = np.unique(cell)
                worst = np.full(len(qid), floor_, np.float32)
                by = np.argsort(probe, kind="stable")
                probe, of = probe[by], of[by]
                held = 0
                lo, hi = np.searchsorted(probe, present, "left"), np.searchsorted(probe, present, "right")
                mlo, mhi = np.searchsorted(cell, present, "left"), np.searchsorted(cell, present, "right")
                for s, e, ms, me in zip(lo, hi, mlo, mhi):
                    for p in range(s, e, 4096):
                        qs = of[p : min(e, p + 4096)]
                        yq, wq = y[qs], worst[qs][:, None]
                        for m in range(ms, me, 512):
                            sim = yq @ x[m : min(me, m + 512)].T
                            r, c = np.nonzero(sim >= wq)
                            if len(r) > 4 * k * len(qs) and sim.shape[1] > k + 1:
                                # no bounds yet: k + 1 of each row, one of which may be the query, are all it can add
                                top = np.argpartition(sim, sim.shape[1] - k - 1, axis=1)[:, -k - 1 :]
                                best_ = np.take_along_axis(sim, top, 1)
                                worst[qs] = np.maximum(worst[qs], best_.min(axis=1))
                                r, c = np.repeat(np.arange(len(qs)), k + 1), top.ravel()
                                ok = sim[r, c] >= wq[r, 0]
                                r, c = r[ok], c[ok]
                            if len(r):
                                kept.append((qs[r], ids[m + c], sim[r, c]))
                                held += len(r)
                    if held > 1_000_000:
                        kept = [best(*(np.concatenate(z) for z in zip(*kept)), qid, k, worst)]
                        held = len(kept[0][0])
                if kept:
                    f = best(*(np.concatenate(z) for z in zip(*kept)), qid, k, worst)
                    return pa.table({"c": qid[f[0]], "nc": f[1], "cosine": f[2].astype(np.float32)})
            return pa.table({"c": pa.array([], pa.int64()), "nc": pa.array([], pa.int64()), "cosine": pa.array([], pa.float32())})

        def best(q, i, s, qid, k, worst):
            """The k best of each query, not itself; ``worst`` gets the cosine of the k-th."""
            other = qid[q] != i
            q, i, s = q[other], i[other], s[other]
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            last = rank == k - 1
            worst[q[last]] = np.maximum(worst[q[last]], s[last])
            return q[rank < k], i[rank < k], s[rank < k]

        keys = ["g", "bi", "bq"]
        found = left.select(*keys, "c", "cell", "v").groupBy(*keys).cogroup(right.select(*keys, "c", "cells", "v").groupBy(*keys)).applyInArrow(block, out_schema)
    else:
        found = classes.sparkSession.createDataFrame([], out_schema)
    best_classes = found.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("cosine"), "nc"))).filter(F.col("rank") <= k)
    # from classes of equal vectors to their keys: the k + 1 least keys of a class suffice
    of_class = members.join(classes.select("h1", "h2", "c"), ["h1", "h2"]).select("c", "id")
    few = of_class.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("id"))).filter(F.col("r") <= k + 1).select("c", F.col("id").alias("neighbour"))
    askers = of_class if queries is None else of_class.filter(queries)
    outer = best_classes.select("c", "nc", "cosine").join(few.withColumnRenamed("c", "nc"), "nc").join(askers, "c").select("id", "neighbour", F.col("cosine").cast("double").alias("cosine"))
    several = of_class.groupBy("c").agg(F.count("*").alias("m")).filter("m > 1").select("c")
    inner = askers.join(several, "c", "left_semi").join(few, "c").filter("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("cosine"))
    top = outer.unionByName(inner).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
    return top.filter(F.col("rank") <= k)
