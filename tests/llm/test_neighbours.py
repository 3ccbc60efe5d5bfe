import numpy as np
from pyspark.sql import functions as F

from sieveline.llm import neighbours as N

SCHEMA = "id long, embedding array<float>, c long, v string"


def make(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in r], 1, "x") for i, r in enumerate(x)], SCHEMA)


def brute(x, k):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 5)
    np.fill_diagonal(s, -2)
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k]] for i in range(len(x))}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 1500)] + rng.normal(size=(1500, 16)) * 0.4
    want = brute(x, 5)
    got = {}
    for r in N.neighbours(make(spark, x), width=16, quota=300, share=0.0, cell_rows=20, block_rows=400, query_rows=500).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    hits = sum(len(set(got[i].values()) & set(want[i])) for i in range(1500))
    assert hits / (5 * 1500) >= 0.9 and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())


def test_all_cells_give_the_exact_answer_for_some_queries(spark):
    x = np.random.default_rng(1).normal(size=(300, 8))
    want = brute(x, 3)
    rows = N.neighbours(make(spark, x), width=8, k=3, share=1.0, queries=F.col("id") % 20 == 0, block_rows=50, query_rows=4).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == {i: want[i] for i in range(0, 300, 20)}


def test_copies_bad_vectors_and_few_rows(spark):
    v = [1.0, 0.0, 0.0, 0.0]
    rows = [(i, v, 1, "x") for i in range(10)] + [(3, v, 1, "x"), (20, [0.9, 0.1, 0.0, 0.0], 1, "x"), (30, None, 1, "x"), (31, [0.0] * 4, 1, "x"), (32, [1.0], 1, "x"), (33, [None, 1.0, 1.0, 1.0], 1, "x"), (34, [float("inf"), 0.0, 0.0, 0.0], 1, "x")]
    got = {}
    for r in N.neighbours(spark.createDataFrame(rows, SCHEMA), width=4).orderBy("rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got[0] == [1, 2, 3, 4, 5] and got[9] == [0, 1, 2, 3, 4] and got[20] == [0, 1, 2, 3, 4] and set(got) == {*range(10), 20}
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert N.neighbours(one, width=4).count() == 0 and N.neighbours(one.limit(0), width=4).count() == 0
    assert N.neighbours(spark.createDataFrame(rows, SCHEMA), width=4, min_cosine=0.999).filter("id = 20 OR neighbour = 20").count() == 0


def test_heaps_give_cells_by_summed_distance():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random((40, 7)).astype(np.float32), rng.random((40, 9)).astype(np.float32)
    heaps = N.CellHeaps(d1, d2)
    sums = (d1[:, :, None] + d2[:, None, :]).reshape(40, -1)
    got = np.stack([heaps.take() for _ in range(63)], axis=1)
    assert all(sorted(r) == list(range(63)) for r in got)
    assert (np.diff(np.take_along_axis(sums, got, 1), axis=1) >= 0).all() and (heaps.take() == -1).all()


def test_visiting_ends_with_the_quota_and_skips_empty_cells():
    rng = np.random.default_rng(3)
    d1, d2 = rng.random((50, 6)).astype(np.float32), rng.random((50, 5)).astype(np.float32)
    entries = rng.integers(0, 4, 30)
    for quota in (1, 7, 20, 1000):
        q, cell = N.visited(d1, d2, entries, quota)
        for i in range(50):
            order = np.argsort((d1[i][:, None] + d2[i][None, :]).ravel(), kind="stable")
            upto = np.searchsorted(np.cumsum(entries[order]), quota) + 1
            want = [c for c in order[:upto] if entries[c]]
            assert cell[q == i].tolist() == want
    q, cell = N.visited(d1[:0], d2[:0], entries, 5)
    assert not len(q) and not len(cell)


def test_recall_at_the_defaults(spark):
    x = np.random.default_rng(5).normal(size=(6000, 48))
    want = brute(x, 5)
    got = {}
    for r in N.neighbours(make(spark, x), width=48, quota=100, queries=F.col("id") % 20 == 0, block_rows=2000).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    rows = range(0, 6000, 20)
    # noise without any structure is the worst case; a tenth of the entries finds far more than a tenth of the neighbours
    assert sum(len(got[i] & set(want[i])) for i in rows) / (5 * len(rows)) > 0.5


def test_both_halves_hold_alike_much_variance():
    x = np.random.default_rng(6).normal(size=(500, 16)) * np.linspace(3, 0.2, 16)
    t = N.balanced_rotation(x.astype(np.float32))
    v = (x @ t).var(0)
    assert np.allclose(t.T @ t, np.eye(16), atol=1e-5) and 0.7 < v[:8].sum() / v[8:].sum() < 1.4
