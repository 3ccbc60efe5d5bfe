"""Small helpers around ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that work arrays stay small whatever Arrow's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signed(h: np.ndarray) -> pa.Array:
    """uint64 hashes as Spark longs."""
    return pa.array(h.view(np.int64))


def hashed_sample(df: DataFrame, by: list[str], rows: int, *, seed: int = 0) -> DataFrame:
    """About ``rows`` rows of ``df``, those with the least hash of ``by``; all of them if there are no more.

    Chosen by a threshold on the hash, so that no task sends more than its part. Of rows with equal ``by`` one is
    kept, so that copies cannot make the sample larger.
    """
    n = df.count()
    if n <= rows:
        return df
    some = df.withColumn("sample_hash", F.xxhash64(F.lit(seed), *by)).filter(F.pmod("sample_hash", F.lit(1 << 30)) < F.lit(int((1 << 30) * rows / n)))
    return some.dropDuplicates(["sample_hash"]).drop("sample_hash")
