"""Readers for the given tables, corpus folders and recorded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text): whole files, one row each."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def records(spark: SparkSession, glob: str, schema: StructType | str) -> DataFrame:
    """One JSON document per file, with the file's path; what a file lacks is null."""
    return spark.read.schema(schema).json(glob, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def strict_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds ``parsed`` and ``problem``: a JSON object is taken only if all its fields are known and of the right type.

    ``problem`` is ``empty``, ``malformed``, ``wrong type`` or ``unknown field``, else null.
    """
    known = StructType.fromDDL(schema).fieldNames()
    raw = F.col(column)
    names = F.json_object_keys(raw)
    loose = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    unknown = F.size(F.array_except(names, F.array(*[F.lit(k) for k in known]))) > 0
    wrong = F.lit(False)
    for k in known:
        given = F.get_json_object(raw, f"$.{k}")
        wrong = wrong | (given.isNotNull() & loose[k].isNull())
    problem = (
        F.when(raw.isNull() | (F.trim(raw) == ""), "empty").when(names.isNull(), "malformed").when(unknown, "unknown field").when(wrong, "wrong type")
    )
    return df.withColumn("problem", problem).withColumn("parsed", F.when(F.col("problem").isNull(), loose))
