from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import proportions as P

TARGETS = "target_set string, sample_permille int, scam_type string, target_permille int, min_rows int"


def rows(spark, counts, extra=()):
    data = [(i * 100 + j, t, "x") for i, (t, n) in enumerate(counts.items()) for j in range(n)]
    return spark.createDataFrame([*data, *extra], "id long, scam_type string, category string")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=3, max_size=3), st.lists(st.integers(0, 15), min_size=3, max_size=3), st.integers(0, 100), st.integers(0, 5))
def test_repair_is_feasible_and_not_worse_than_any_single_exchange(have, floors, size, seed):
    names = "abc"
    h, f, p = dict(zip(names, have)), dict(zip(names, floors)), {"a": 500, "b": 300, "c": 200}
    start, take = P.repair(h, p, f, size, seed)
    low = {c: min(h[c], f[c]) for c in names}
    assert all(low[c] <= take[c] <= h[c] for c in names)
    assert sum(take.values()) == max(sum(low.values()), min(size, sum(have)))
    total = max(1, sum(take.values()))
    off = lambda t: sum(abs(t[c] - p[c] * total / 1000) for c in names)
    assert sum(start.values()) == sum(take.values()) and off(take) <= off(start) + 1e-6
    every = [dict(zip(names, x)) for x in product(*(range(low[c], h[c] + 1) for c in names[:2]), [0])]
    every = [t | {"c": sum(take.values()) - t["a"] - t["b"]} for t in every]
    assert off(take) <= min(off(t) for t in every if low["c"] <= t["c"] <= h["c"]) + 1e-6
    assert abs(P.least_deviation(h, p, f, sum(take.values())) - P.deviation(take, p)) < 1e-6
    for a in names:
        for b in names:
            if a != b and take[a] > low[a] and take[b] < h[b]:
                assert off(take | {a: take[a] - 1, b: take[b] + 1}) >= off(take) - 1e-6


def test_sample_and_report(spark):
    df = rows(spark, {"loan_scam": 60, "fake_job": 30, "other": 3}, [(9001, " Loan-Scam ", "x"), (9002, None, "x"), (9003, "nope", "x"), (1, "loan_scam", "x")])
    t = spark.createDataFrame([("s", 500, "loan_scam", 400, 2), ("s", 500, "fake_job", 400, 2), ("s", 500, "other", 200, 5)], TARGETS)
    drawn, plan = P.sample(df, t)
    got = {r["category"]: r["count"] for r in drawn.groupBy("category").count().collect()}
    assert got == {"loan_scam": 22, "fake_job": 22, "other": 3} or sum(got.values()) == 47 and got["other"] == 3
    assert drawn.distinct().count() == drawn.count() == 47
    assert [(r["scam_type"], r["available"], r["needed"]) for r in P.shortfalls(drawn, plan).collect()] == [("other", 3, 10)]


def test_draw_spans_buckets(spark):
    df = rows(spark, {"loan_scam": 95, "fake_job": 50})
    t = spark.createDataFrame([("s", 400, "loan_scam", 700, 0), ("s", 400, "fake_job", 300, 0)], TARGETS)
    pooled = P.pool(df)
    plan = P.plan(pooled, t)
    want = {(r["category"], r["take"]) for r in plan.collect()}
    got = {(r["category"], r["count"]) for r in P.draw(pooled, plan, bucket_rows=4).groupBy("category").count().collect()}
    assert got == want


def test_quality_of_the_drawn_sample(spark):
    df = rows(spark, {"loan_scam": 95, "fake_job": 50, "other": 40})
    t = spark.createDataFrame([("s", 400, "loan_scam", 700, 0), ("s", 400, "fake_job", 200, 0), ("s", 400, "other", 100, 20)], TARGETS)
    q = P.quality(*P.sample(df, t)).first()
    assert q["drawn"] == q["sample_size"] == 74 and q["deviation"] <= q["start_deviation"] and abs(q["deviation"] - 12.6) < 1e-9


def test_empty_pool_and_targets(spark):
    t = spark.createDataFrame([("s", 400, "loan_scam", 1000, 3)], TARGETS)
    drawn, plan = P.sample(rows(spark, {}), t)
    assert drawn.count() == 0 and P.shortfalls(drawn, plan).count() == 1
    drawn, plan = P.sample(rows(spark, {"loan_scam": 3}), t.limit(0))
    assert drawn.count() == 0 and plan.count() == 0
