"""Session helpers: where intermediate results that cut lineage are written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine that names none (tests, a laptop) gets a temporary folder; on a cluster
    it is an error, as each machine would see a folder of its own.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[[^,\]]*(,[^,\]]*)?\])?$", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``columns`` worked out once for each row.

    The optimiser puts a column's expression wherever the column is used, also into filters, so one that is costly
    and used often would be worked out as often; a generator is what it does not look through.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("once")).select(*rest, "once.*")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut.

    Used where a result is read more than once, so that a lost executor costs a
    re-read and not the whole computation before it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read back.

    Like ``cut``, for wide or long-lived intermediate results: it takes less room
    than a checkpoint, prunes columns on reading and knows its size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
