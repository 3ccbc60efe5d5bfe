"""Daily budgets and per-key rate limits over logged requests."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ZONE = "Asia/Ho_Chi_Minh"


def local_day(ts: str):
    """The local date of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def with_budget(requests: DataFrame, cap: int, *, ts: str = "received_at", key: str = "request_id") -> DataFrame:
    """Requests with ``day`` and ``admitted``: the first ``cap`` of each local day, by time and then key.

    At least one is admitted each day, as the first of a day is let in before any count is
    kept. Only each day's last admitted request is found by ranking, which keeps ``cap`` rows
    of a day per partition; the flag is a comparison with it, so no day is sorted in one task.
    Rows repeated whole count once; requests without a time are not admitted.
    """
    n = max(cap, 1)
    rows = requests.dropDuplicates([key]).withColumn("day", local_day(ts))
    w = Window.partitionBy("day").orderBy(ts, key)
    edge = rows.filter(F.col(ts).isNotNull()).select("day", ts, key).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    edge = edge.groupBy("day").agg(F.max(F.struct(F.col(ts).alias("t"), F.col(key).alias("k"))).alias("edge"))
    flag = F.coalesce(F.struct(F.col(ts).alias("t"), F.col(key).alias("k")) <= F.col("edge"), F.lit(False))
    return rows.join(edge, "day", "left").withColumn("admitted", flag).drop("edge")


def budget_by_day(requests: DataFrame, cap: int, **columns) -> DataFrame:
    """(day, n_requests, n_admitted)."""
    return with_budget(requests, cap, **columns).filter("day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n_requests"), F.count_if("admitted").alias("n_admitted"))


def key_of(addr: str | None) -> str | None:
    """The rate key of an address: an IPv4 address whole, also inside IPv6, an IPv6 address by its /64, anything else as it is."""
    if addr is None:
        return None
    try:
        ip = ipaddress.ip_address(addr)
    except ValueError:
        return addr
    if ip.version == 6 and ip.ipv4_mapped:
        return str(ip.ipv4_mapped)
    return str(ip) if ip.version == 4 else str(ipaddress.ip_network((ip, 64), strict=False))


def rate_key(addr: str):
    """The rate key column of an address column."""
    return F.pandas_udf(lambda s: s.map(key_of), StringType())(addr)


def take(tokens: float, last: int | None, now: int, rate: float, burst: int) -> tuple[float, int, bool]:
    """(tokens, last, admitted) after a request at ``now`` microseconds; a refused request takes no token."""
    if last is not None:
        tokens = min(float(burst), tokens + max(0, now - last) / 1e6 * rate)
    ok = tokens >= 1.0
    return (tokens - 1.0 if ok else tokens), now, ok


def with_bucket(requests: DataFrame, per_minute: int, burst: int, *, by: str = "rate_key", ts: str = "received_at", key: str = "request_id") -> DataFrame:
    """(key, by, ts, admitted): a token bucket per rate key, in order of time and then request key.

    A bucket is full again after burst / rate seconds without a request, so a key's requests
    fall into independent islands. Time is cut into bins of that length; runs of occupied
    bins, found on counts of bins, are the islands. Rows are partitioned and sorted by island
    and pass through as a stream with the state of one bucket, so neither a hot key nor a
    long island is ever held in memory. A limit of 0 or less admits all. Rows repeated whole
    count once; requests without a key or time are admitted, as no bucket applies.
    """
    rows = requests.dropDuplicates([key]).select(key, by, ts)
    if per_minute <= 0:
        return rows.withColumn("admitted", F.lit(True))
    rate = per_minute / 60.0
    bin_us = int(np.ceil(burst / rate * 1e6))
    limited = rows.filter(F.col(by).isNotNull() & F.col(ts).isNotNull()).withColumn("us", F.unix_micros(ts)).withColumn("bin", F.floor(F.col("us") / bin_us))
    bins = limited.select(by, "bin").distinct()
    island = F.col("bin") - F.row_number().over(Window.partitionBy(by).orderBy("bin"))
    placed = limited.join(bins.withColumn("island", island), [by, "bin"]).select(by, "island", "us", key)
    kind = dict(rows.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tokens, last = None, float(burst), None
        for b in batches:
            out = []
            for k, i, us in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (k, i) != current:
                    current, tokens, last = (k, i), float(burst), None
                tokens, last, ok = take(tokens, last, us, rate, burst)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(out, pa.bool_())], names=[key, "admitted"])

    ordered = placed.repartition(by, "island").sortWithinPartitions(by, "island", "us", key)
    flags = ordered.mapInArrow(work, f"{key} {kind[key]}, admitted boolean")
    return rows.join(flags, key, "left").withColumn("admitted", F.coalesce("admitted", F.lit(True)))
