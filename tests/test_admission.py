import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import admission as A
from sieveline.streaming import daily_counts, token_buckets

SCHEMA = "request_id long, rate_key string, received_at timestamp"
T0 = dt.datetime(2026, 1, 1, 0, 0)


def requests(spark, rows):
    return spark.createDataFrame([(i, k, None if s is None else T0 + dt.timedelta(seconds=s)) for i, k, s in rows], SCHEMA)


def test_budget_admits_the_first_of_each_local_day(spark):
    df = requests(spark, [(1, "a", 0), (2, "a", 5), (3, "a", 5), (3, "a", 5), (4, "a", 17 * 3600), (5, "a", None)])
    got = {r["request_id"]: r["admitted"] for r in A.with_budget(df, 2).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False}
    days = {str(r["day"]): (r["n_requests"], r["n_admitted"]) for r in A.budget_by_day(df, 2).collect()}
    assert days == {"2026-01-01": (3, 2), "2026-01-02": (1, 1)}


def test_a_budget_of_nothing_still_admits_one(spark):
    df = requests(spark, [(1, "a", 0), (2, "a", 1)])
    assert [r["request_id"] for r in A.with_budget(df, 0).filter("admitted").collect()] == [1]


def test_budget_of_an_empty_table(spark):
    assert A.with_budget(requests(spark, []), 3).count() == 0


def sequential(rows, per_minute, burst):
    state, out = {}, {}
    for i, k, s in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens, last = state.get(k, (float(burst), None))
        tokens, last, ok = A.take(tokens, last, int(s * 1e6), per_minute / 60, burst)
        state[k] = (tokens, last)
        out[i] = ok
    return out


def test_bucket_lets_the_burst_through_then_blocks(spark):
    df = requests(spark, [(i, "a", 0) for i in range(12)] + [(99, "b", 0), (100, None, 0)])
    got = {r["request_id"]: r["admitted"] for r in A.with_bucket(df, 60, 10).collect()}
    assert [got[i] for i in range(12)] == [True] * 10 + [False] * 2 and got[99] and got[100]


def test_bucket_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[int(rng.integers(2))], float(s)) for i, s in enumerate(np.round(np.cumsum(rng.exponential(2.0, 400)) * (1 + (np.arange(400) % 97 == 0)), 3))]
    got = {r["request_id"]: r["admitted"] for r in A.with_bucket(requests(spark, rows), 20, 3).collect()}
    assert got == sequential(rows, 20, 3)


def test_no_limit_admits_all(spark):
    assert A.with_bucket(requests(spark, [(i, "a", 0) for i in range(30)]), 0, 1).filter("NOT admitted").count() == 0


@pytest.mark.parametrize(
    "addr,key",
    [("203.0.113.9", "203.0.113.9"), ("::ffff:203.0.113.9", "203.0.113.9"), ("2001:db8:1:2:3:4:5:6", "2001:db8:1:2::/64"), ("not an address", "not an address"), (None, None)],
)
def test_rate_key(spark, addr, key):
    assert A.key_of(addr) == key
    assert spark.createDataFrame([(addr,)], "a string").select(A.rate_key("a")).first()[0] == key


def run(spark, df, folder, build, mode):
    df.write.parquet(f"{folder}/in")
    stream = build(spark.readStream.schema(df.schema).parquet(f"{folder}/in"))
    q = stream.writeStream.outputMode(mode).format("parquet" if mode == "append" else "memory").queryName("counts")
    if mode == "append":
        q = q.option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
    q = q.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out") if mode == "append" else spark.table("counts")


def test_streamed_buckets_equal_the_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], i * 0.7) for i in range(60)]
    df = requests(spark, rows)
    got = {r["request_id"]: r["admitted"] for r in run(spark, df.coalesce(1), str(tmp_path), lambda s: token_buckets(s, 20, 3), "append").collect()}
    assert got == sequential(rows, 20, 3)


def test_streamed_days(spark, tmp_path):
    df = requests(spark, [(1, "a", 0), (2, "a", 3600 * 16), (3, "a", 3600 * 18)])
    got = run(spark, df, str(tmp_path), daily_counts, "complete")
    assert sorted((str(r[0]), r[1]) for r in got.select(F.col("day_start"), "n").collect()) == [("2025-12-31 17:00:00", 2), ("2026-01-01 17:00:00", 1)]


def runs(spark, parts, folder, build, mode):
    """All rows that one stream writes, run once after each part."""
    out = []
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(df.schema).parquet(f"{folder}/in"))
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/cp").foreachBatch(lambda b, _: out.extend(b.collect()))
        q.trigger(availableNow=True).start().awaitTermination()
    return out


def test_streamed_buckets_return_late_rows_and_rows_without_a_key(spark, tmp_path):
    first = [(i, "ab"[i % 2], 36000 + i * 0.7) for i in range(40)] + [(100, None, 36000), (101, "a", None)]
    second = [(200 + i, "ab"[i % 2], 36040 + i * 0.7) for i in range(40)]
    late = [(300 + i, "a", i) for i in range(8)] + [(310, "new", 5)]
    parts = [requests(spark, first), requests(spark, [*second, *late, (400, None, 3)])]
    got = runs(spark, parts, str(tmp_path), lambda s: token_buckets(s, 20, 3, late="1 hour"), "append")
    batch = {r["request_id"]: r["admitted"] for r in A.with_bucket(requests(spark, [*first, *second, (400, None, 3)]), 20, 3).collect()}
    assert len(got) == len({r[0] for r in got}) == len(batch) + len(late)
    assert {r["request_id"]: r["admitted"] for r in got if r["request_id"] in batch} == batch
    assert {r["request_id"] for r in got if r["late"]} == {i for i, _, _ in late} and all(r["admitted"] for r in got if r["late"])


def test_streamed_days_count_requests_of_three_days_ago(spark, tmp_path):
    parts = [requests(spark, [(1, "a", 0), (2, "a", 75 * 3600)]), requests(spark, [(3, "a", 1)])]
    got = runs(spark, parts, f"{tmp_path}/a", daily_counts, "update")
    assert max(r["n"] for r in got if str(r["day_start"]) == "2025-12-31 17:00:00") == 2
    parts = [requests(spark, [(1, "a", 0), (2, "a", 9e6)]), requests(spark, [(3, "a", 1)])]
    got = runs(spark, parts, f"{tmp_path}/b", lambda s: daily_counts(s, late=None), "update")
    assert max(r["n"] for r in got if str(r["day_start"]) == "2025-12-31 17:00:00") == 2
