"""Reports as rows of text in order, and the files of an evaluation run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import joined_ids, one_line, plural
from sieveline.operators.corpus import with_ids

#: The order of an audit.
AUDIT_ORDER = ("scam_type", "neg_similarity", "a_id", "b_id")


def _end(chunk: str, doc: str, url: str) -> Column:
    return F.concat(F.lit("chunk "), F.col(chunk).cast("string"), F.lit(" (doc "), F.col(doc).cast("string"), F.lit("  "), F.coalesce(url, F.lit("")), F.lit(")"))


def audit_lines(pairs: DataFrame) -> DataFrame:
    """(scam_type, neg_similarity, a_id, b_id, part, line): an audit's pairs as text, to be ordered by these columns as they stand.

    A header for each type with its number of pairs, and for each pair a line with both ends and one for
    each preview. Only the header needs a count, so no type is brought to one task.
    """
    p = pairs.withColumn("neg_similarity", -F.col("similarity"))
    pair = F.concat(
        F.lit("  "), F.format_string("%.3f", "similarity"), F.lit("  "), F.rpad("kind", 7, " "), F.lit("  "), _end("a_id", "a_doc", "a_url"), F.lit("  ~  "), _end("b_id", "b_doc", "b_url"),
    )
    preview = [F.concat(F.lit(f"         {side}: "), one_line(F.coalesce(c, F.lit("")))) for side, c in (("A", "a_preview"), ("B", "b_preview"))]
    lines = p.select(*AUDIT_ORDER, F.posexplode(F.array(pair, *preview)).alias("part", "line"))
    n = p.groupBy("scam_type").agg(F.count("*").alias("n"))
    header = F.concat(F.lit("["), "scam_type", F.lit("]  ("), F.col("n").cast("string"), F.lit(" pair"), plural("n"), F.lit(")"))
    heads = n.select("scam_type", F.lit(-2.0).alias("neg_similarity"), F.lit(-1).cast("long").alias("a_id"), F.lit(-1).cast("long").alias("b_id"), F.lit(0).alias("part"), header.alias("line"))
    return heads.unionByName(lines)


def prune_lines(report: DataFrame, *, dry_run: bool = True, block: int = 1000) -> DataFrame:
    """(part, first, line): a prune report (what, id, url, remaining) as text, ids in blocks of at most ``block`` a line.

    ``report`` has the rows of ``corpus.prune_report``. To be ordered by part and first.
    """
    ids = report.filter("what IN ('deleted', 'missing')").select("what", "id")
    # numbered by offsets of partitions: a line's length is bounded whatever is deleted
    placed = with_ids(ids.select("what", F.col("id").alias("chunk")), ["what", "chunk"])
    lines = placed.groupBy("what", F.floor((F.col("id") - 1) / block).alias("b")).agg(F.sort_array(F.collect_list("chunk")).alias("ids"))
    verb = "would delete " if dry_run else "deleted "
    n = F.size("ids").cast("string")
    text = F.when(F.col("what") == "deleted", F.concat(F.lit(verb), n, F.lit(" chunk"), plural(F.size("ids")), F.lit(": "), joined_ids("ids"))).otherwise(
        F.concat(F.lit("WARNING: "), n, F.lit(" requested id"), plural(F.size("ids")), F.lit(" not found: "), joined_ids("ids"))
    )
    part = F.when(F.col("what") == "deleted", 0).otherwise(1)
    left = report.filter("what IN ('emptied', 'contentless')")
    who = F.concat(F.lit("WARNING: document "), F.col("id").cast("string"), F.lit(" ("), F.coalesce("url", F.lit("")), F.lit(") is left with "))
    state = F.when(F.col("what") == "emptied", F.concat(who, F.lit("0 chunks"))).otherwise(
        F.concat(who, F.col("remaining").cast("string"), F.lit(" chunk"), plural("remaining"), F.lit(" but no content chunk"))
    )
    return lines.select(part.alias("part"), F.col("ids")[0].alias("first"), text.alias("line")).unionByName(
        left.select(F.when(F.col("what") == "emptied", 2).otherwise(3).alias("part"), F.col("id").alias("first"), state.alias("line"))
    )


def write_run(path: str, dataset: DataFrame, arms: dict[str, DataFrame], judged: DataFrame, *, key: str = "case_id") -> None:
    """The files of a run below ``path``: the dataset, what each arm answered and what was judged, as JSON lines.

    Arms are partitions of one table. What a case has been answered already is left as it is, and so a run goes on where it stopped.
    """
    dataset.write.mode("overwrite").json(f"{path}/dataset")
    for name, df in arms.items():
        remaining(df, _read(df.sparkSession, f"{path}/arms/arm={name}", key), key=key).write.mode("append").json(f"{path}/arms/arm={name}")
    remaining(judged, _read(judged.sparkSession, f"{path}/judged", key), key=key).write.mode("append").json(f"{path}/judged")


def _read(spark, path: str, key: str) -> DataFrame | None:
    """The keys written below ``path``, or None where nothing has been written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(f"{key} string").json(path) if there else None


def remaining(cases: DataFrame, done: DataFrame | None, *, key: str = "case_id", limit: int | None = None) -> DataFrame:
    """The cases that are not done yet; with ``limit`` the first so many cases by key are looked at only, done or not."""
    some = cases if limit is None else cases.orderBy(key).limit(limit)
    return some if done is None else some.join(done.select(key), key, "left_anti")
