"""Evaluation of rankings and verdicts, and reports over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import bullets


def judged(ranking: DataFrame, expected: DataFrame, *, item: str, k: int = 0) -> DataFrame:
    """(query_id, hit, reciprocal_rank): whether and where the expected ``item`` is among the first ``k`` ranks (all if k < 1).

    ``ranking`` is (query_id, ``item``, rank), ``expected`` (query_id, expected). A query
    without ranks, or with a null expectation, is a miss.
    """
    r = ranking.filter(F.col("rank") <= k) if k > 0 else ranking
    first = r.join(expected, "query_id").filter(F.col(item) == F.col("expected")).groupBy("query_id").agg(F.min("rank").alias("first"))
    out = expected.select("query_id").distinct().join(first, "query_id", "left")
    return out.select("query_id", F.col("first").isNotNull().alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def summary(judgements: DataFrame) -> DataFrame:
    """One row (n, recall, mrr); zeros where there is nothing to judge."""
    return judgements.agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"),
    )


def confusion(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., expected, got, n)."""
    return cases.groupBy(*(by or []), "expected", "got").agg(F.count("*").alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def rates(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, accuracy, fpr, fnr) of cases (is_scam, expected, got).

    A false positive is a benign case judged red, a false negative a scam judged green;
    yellow is neither. Rates over nothing are 0.
    """
    g = cases.groupBy(*by) if by else cases.groupBy()
    c = F.count_if
    return g.agg(
        F.count("*").alias("n"),
        _ratio(c(F.col("expected") == F.col("got")), F.count("*")).alias("accuracy"),
        _ratio(c(~F.col("is_scam") & (F.col("got") == "red")), c(~F.col("is_scam"))).alias("fpr"),
        _ratio(c(F.col("is_scam") & (F.col("got") == "green")), c(F.col("is_scam"))).alias("fnr"),
    )


def votes(rows: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """Two votes of swapped order resolved: the arm both name, else ``tie``; adds ``winner`` and ``consistent``."""
    same = F.col(first).eqNullSafe(F.col(second)) & F.col(first).isNotNull()
    return rows.withColumn("winner", F.when(same, F.col(first)).otherwise("tie")).withColumn("consistent", same)


def extremes(rows: DataFrame, value: str, key: str, n: int = 3) -> DataFrame:
    """The ``n`` rows with the greatest and the ``n`` others with the least ``value``, with column ``end``; ties go to the smaller key."""
    some = rows.filter(F.col(value).isNotNull())
    top = some.orderBy(F.desc(value), key).limit(n).withColumn("end", F.lit("best"))
    low = some.join(top.select(key), key, "left_anti").orderBy(value, key).limit(n).withColumn("end", F.lit("worst"))
    return top.unionByName(low.select(*top.columns))


def specs(strata: DataFrame, total: int, styles: tuple[str, ...], *, benign: tuple[str, ...] = (), each_benign: int = 10) -> DataFrame:
    """(case_id, stratum, is_scam, expected, i, style): ``total`` cases over the sorted strata (stratum), the first ones taking the
    remainder, and ``each_benign`` for each benign category in the given order; styles turn over all cases. Null strata are none.

    The windows run over one row a stratum.
    """
    names = strata.filter("stratum IS NOT NULL").select("stratum").distinct()
    every, upto = Window.partitionBy(), Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    placed = names.withColumn("at", F.row_number().over(Window.orderBy("stratum")) - 1).withColumn("m", F.count("*").over(every))
    base = F.floor(F.lit(total) / F.col("m"))
    placed = placed.withColumn("n", (base + (F.col("at") < F.lit(total) - base * F.col("m")).cast("int")).cast("int"))
    placed = placed.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).select("stratum", F.lit(True).alias("is_scam"), "n", "before")
    if benign:
        calm = F.posexplode(F.array(*[F.lit(b) for b in benign])).alias("at", "stratum")
        first = F.when(F.col("any") > 0, total).otherwise(0)
        some = names.agg(F.count("*").alias("any")).select("any", calm)
        placed = placed.unionByName(some.select("stratum", F.lit(False).alias("is_scam"), F.lit(each_benign).alias("n"), (first + F.col("at") * each_benign).alias("before")))
    rows = placed.filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    style = F.element_at(F.array(*[F.lit(x) for x in styles]), ((F.col("before") + F.col("i") - 1) % len(styles) + 1).cast("int"))
    name = F.concat(F.when(F.col("is_scam"), "scam-").otherwise("benign-"), "stratum", F.lit("-"), F.format_string("%02d", "i"))
    return rows.select(name.alias("case_id"), "stratum", "is_scam", F.when(F.col("is_scam"), "red").otherwise("green").alias("expected"), "i", style.alias("style"))


def assembled(cases: DataFrame, *arms: tuple[str, DataFrame], key: str = "case_id") -> DataFrame:
    """Cases with the verdict of each arm that has one: a left join per arm, columns ``got_<name>``."""
    out = cases
    for name, df in arms:  # as many joins as arms
        out = out.join(df.select(key, F.col("got").alias(f"got_{name}")).dropDuplicates([key]), key, "left")
    return out


def cited(rows: DataFrame, items: str = "items", indices: str = "indices") -> DataFrame:
    """Adds ``sources``: the items that 1-based ``indices`` name, each once, in order; places out of range are left out."""
    ok = F.filter(F.array_distinct(F.coalesce(F.col(indices), F.array().cast("array<int>"))), lambda i: (i >= 1) & (i <= F.size(items)))
    return rows.withColumn("sources", F.transform(ok, lambda i: F.element_at(items, i)))


def tally(rows: DataFrame, status: str = "status") -> DataFrame:
    """(status, n)."""
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def write_report(detail: DataFrame, columns: list[str], path: str) -> None:
    """The full detail as JSON lines and the given columns as CSV with a header, under ``path``."""
    detail.write.mode("overwrite").json(f"{path}/results")
    detail.select(*columns).write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def top_within(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rn") <= n)


def judge_input(cases: DataFrame, first: DataFrame, second: DataFrame, *, key: str = "case_id") -> DataFrame:
    """(key, message, facts, first, second): the cases that both arms (key, answer) have answered, with the facts as lines."""
    a, b = (df.select(key, F.col("answer").alias(n)).dropDuplicates([key]) for n, df in (("first", first), ("second", second)))
    facts = bullets(F.coalesce("key_facts", F.array().cast("array<string>")), none="(không có)")
    return cases.select(key, F.col("item_text").alias("message"), facts.alias("facts")).join(a, key).join(b, key)


def answer_text(raw: str, verdict: str, **lists: str) -> Column:
    """An arm's answer as a judge reads it: its raw text, or the verdict and its lists (heading=column) as lines."""
    parts = [F.concat(F.lit("Mức độ rủi ro: "), F.coalesce(verdict, F.lit("")), F.lit("\n"))]
    for heading, column in lists.items():
        parts.append(F.when(F.size(column) > 0, F.concat(F.lit(heading + ":\n"), bullets(column))).otherwise(""))
    return F.when(F.coalesce(raw, F.lit("")) != "", F.col(raw)).otherwise(F.concat(*parts))


def preference(raw: Column | str, if_a: str, if_b: str) -> Column:
    """The arm in the slot that a judge prefers; anything but ``A`` and ``B`` is a tie, and so is null."""
    r = F.col(raw) if isinstance(raw, str) else raw
    return F.when(r == "A", if_a).when(r == "B", if_b).otherwise("tie")


def resolved(calls: DataFrame, first: str, second: str, *, key: str = "case_id") -> DataFrame:
    """(key, preferred, order_consistent, first_score, second_score) of judge calls (key, order, preferred, score_a, score_b).

    In order 1 slot A holds ``first``, in order 2 ``second``. Both orders must name the same arm, or it is a tie;
    scores are those of order 1. A case with one order only has not been judged.
    """
    pref = F.when(F.col("order") == 1, preference("preferred", first, second)).otherwise(preference("preferred", second, first))
    two = calls.filter("order IN (1, 2)").groupBy(key).agg(
        *[F.min(F.when(F.col("order") == o, pref)).alias(f"p{o}") for o in (1, 2)],
        *[F.min(F.when(F.col("order") == 1, F.col(c))).alias(n) for c, n in (("score_a", "first_score"), ("score_b", "second_score"))],
    )
    both = two.filter("p1 IS NOT NULL AND p2 IS NOT NULL").withColumn("order_consistent", F.col("p1") == F.col("p2"))
    return both.select(key, F.when(F.col("order_consistent"), F.col("p1")).otherwise("tie").alias("preferred"), "order_consistent", "first_score", "second_score")


def judge_summary(judged_: DataFrame, crossed: DataFrame, first: str, second: str, *, key: str = "case_id") -> DataFrame:
    """One row of ``resolved`` cases: n_judged, wins of each arm, ties, mean scores, share of consistent orders, and how often another
    judge (``crossed``) prefers the same; shares and means over nothing are 0."""
    j = judged_.join(crossed.select(key, F.col("preferred").alias("cross")), key, "full")
    n, c = F.count_if(F.col("preferred").isNotNull()), F.count_if
    return j.agg(
        n.alias("n_judged"),
        c(F.col("preferred") == first).alias("first_wins"), c(F.col("preferred") == second).alias("second_wins"), c(F.col("preferred") == "tie").alias("ties"),
        F.coalesce(F.avg("first_score"), F.lit(0.0)).alias("first_mean"), F.coalesce(F.avg("second_score"), F.lit(0.0)).alias("second_mean"),
        _ratio(c("order_consistent"), n).alias("order_consistent_rate"),
        c(F.col("cross").isNotNull()).alias("n_crossed"),
        _ratio(c(F.col("cross") == F.col("preferred")), c(F.col("cross").isNotNull())).alias("cross_agreement_rate"),
    )


def summary_rows(cases: DataFrame) -> DataFrame:
    """The twelve text columns of a run's summary, one row a case; what a case lacks is empty, scores have two digits.

    ``cases`` is (case_id, scam_type, style, expected, got_first, got_second, preferred, order_consistent, first_score, second_score).
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("scam_type", "style", "expected", "got_first", "got_second", "preferred", "order_consistent")}
    right = {c: F.coalesce(F.col(f"got_{c}") == F.col("expected"), F.lit(False)).cast("string").alias(f"{c}_correct") for c in ("first", "second")}
    score = {c: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.2f", F.col(c))).alias(c) for c in ("first_score", "second_score")}
    return cases.select(
        "case_id", text["scam_type"], text["style"], text["expected"], text["got_first"], text["got_second"], right["first"], right["second"],
        score["first_score"], score["second_score"], text["preferred"], text["order_consistent"],
    )
