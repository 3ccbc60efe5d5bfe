"""Structured Streaming variants of the admission operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sieveline.operators.admission import take


#: Above the longest time that a request of the test tables is logged late, 75 hours.
LATE = "4 days"
#: Groups into which requests without a key or time are spread.
SLOTS = 64


def daily_counts(requests: DataFrame, *, ts: str = "received_at", late: str | None = LATE) -> DataFrame:
    """(day_start, n): requests of each local day (UTC+7) as tumbling windows.

    ``late`` is how late a request may come: in append and update mode a day is closed when the watermark
    has passed it. None closes no day, so that no request is ever left out; state then is a row a day, and the
    output mode is update or complete.
    """
    w = F.window(ts, "1 day", startTime="17 hours")
    rows = requests if late is None else requests.withWatermark(ts, late)
    return rows.groupBy(w).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day_start"), "n")


def token_buckets(
    requests: DataFrame, per_minute: int, burst: int, *, by: str = "rate_key", ts: str = "received_at", key: str = "request_id", ttl: str = "10 minutes", late: str = LATE
) -> DataFrame:
    """(key, admitted, late): a token bucket per rate key whose state is dropped ``ttl`` after the watermark passed its last request.

    Every request comes out. Those of one micro-batch are taken in order of time and key; one that is earlier than
    what a previous micro-batch decided takes from the tokens that are left, without a refill. One that the
    watermark (``late`` behind the latest) has passed is admitted, flagged ``late`` and takes no token, as its bucket
    may be dropped. Requests without a key or time are admitted, as no bucket applies.
    """
    kinds = dict(requests.dtypes)
    rate = per_minute / 60.0

    def work(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        if k[1] >= 0:
            yield pd.DataFrame({key: rows[key].to_numpy(), "admitted": True, "late": False})
            return
        rows = rows.sort_values(["us", key])
        passed = (rows["us"] < state.getCurrentWatermarkMs() * 1000).to_numpy()
        tokens, last = state.get if state.exists else (float(burst), None)
        ok = []
        for us, is_late in zip(rows["us"].tolist(), passed.tolist()):
            admitted = True
            if not is_late:
                before = last
                tokens, last, admitted = take(tokens, last, us, rate, burst)
                last = last if before is None else max(before, last)
            ok.append(admitted)
        if last is not None:
            state.update((tokens, last))
            state.setTimeoutTimestamp(max(int(last / 1000), state.getCurrentWatermarkMs() + 1) + ttl_ms)
        yield pd.DataFrame({key: rows[key].to_numpy(), "admitted": ok, "late": passed})

    n, unit = ttl.split()
    ttl_ms = int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]
    free = F.col(by).isNull() | F.col(ts).isNull()
    stream = requests.withColumn("us", F.unix_micros(ts)).withColumn("slot", F.when(free, F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")).otherwise(-1))
    # Spark drops rows that the watermark has passed: it is drawn from a copy of each row, and the row itself has no event time
    stream = stream.withColumn("copy", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("seen", F.when(F.col("copy"), F.coalesce(ts, F.timestamp_seconds(F.lit(0)))))
    stream = stream.withWatermark("seen", late).filter("seen IS NULL")
    return stream.select(by, "slot", key, "us", "seen").groupBy(by, "slot").applyInPandasWithState(
        work, f"{key} {kinds[key]}, admitted boolean, late boolean", "tokens double, last long", "append", GroupStateTimeout.EventTimeTimeout
    )
