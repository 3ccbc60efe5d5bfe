"""Samples with target shares per category, by swap repair.

Records are counted by category signature (here the category itself). For every target
set a random sample that satisfies the minimums is drawn as signature counts; then one
record at a time is exchanged between two signatures, always the exchange that lowers
the deviation from the target most, until none lowers it. Only counts are exchanged:
they are few, whatever the number of records. The records are then drawn at random:
within each category those with the least hash values, found through counts of hash
buckets, so no category is ever sorted in one task.

Nulls and edge cases: records whose category is null or outside the known ones are not
in the pool; a record repeated counts once; a category with too few records gives all
it has and is reported; with an empty pool the sample is empty.
"""

from __future__ import annotations

import random
from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.session import cut

#: The categories of the domain.
SCAM_TYPES = (
    "impersonation_authority", "impersonation_service", "tech_fraud", "recovery_scam", "investment_fraud", "loan_scam", "fake_job",
    "ecommerce_scam", "package_delivery", "prize_gift", "romance_scam", "vacation_contract", "other",
)


def category(col: str):
    """A label trimmed, in lower case, with ``_`` for blanks and hyphens."""
    return F.regexp_replace(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")), r"[- ]", "_")


def pool(df: DataFrame, *, key: str = "id", label: str = "scam_type") -> DataFrame:
    """(key, category): each record of a known category once; of several labels of one key the least counts."""
    known = df.select(F.col(key), category(label).alias("category")).filter(F.col("category").isin(*SCAM_TYPES))
    return known.groupBy(key).agg(F.min("category").alias("category"))


def deviation(take: dict[str, int], permille: dict[str, int]) -> float:
    """How many records of a sample lie in categories beyond their shares: half the sum of all deviations from the targets."""
    total = sum(take.values())
    return sum(abs(take[c] - permille[c] * total / 1000) for c in permille) / 2


def random_start(have: dict[str, int], floors: dict[str, int], size: int, seed: int = 0) -> dict[str, int]:
    """Records of each category of a random sample that satisfies the minimums where the pool can.

    It has ``size`` records if the pool does; minimums that add up to more come first and make it larger.
    """
    names = sorted(floors)
    room = {c: have.get(c, 0) for c in names}
    take = {c: min(room[c], floors[c]) for c in names}
    rng = random.Random(seed)
    left = max(0, min(size, sum(room.values())) - sum(take.values()))
    # the rest is drawn category by category in random order with random amounts, then whatever is still missing
    for most in (lambda: rng.randint(0, left), lambda: left):
        for c in rng.sample(names, len(names)):
            n = min(room[c] - take[c], most())
            take[c] += n
            left -= n
    return take


def repair(have: dict[str, int], permille: dict[str, int], floors: dict[str, int], size: int, seed: int = 0) -> tuple[dict[str, int], dict[str, int]]:
    """(random start, repaired): records to take of each category before and after the exchanges.

    Exchanges keep the number of records and the minimums, and take no more than there is. Large ones come
    first, single records last, until no exchange lowers the deviation from the targets.
    """
    names = sorted(permille)
    room = {c: have.get(c, 0) for c in names}
    start = random_start(have, {c: floors.get(c, 0) for c in names}, size, seed)
    take = dict(start)
    total = sum(take.values())
    want = {c: permille[c] * total / 1000 for c in names}

    def gain(a: str, b: str, n: int) -> float:
        """How much less deviation n records of b instead of a give."""
        before = abs(take[a] - want[a]) + abs(take[b] - want[b])
        return before - abs(take[a] - n - want[a]) - abs(take[b] + n - want[b])

    step = 1 << max(0, total.bit_length() - 1)
    while step:
        moves = [
            (gain(a, b, step), a, b)
            for a in names
            for b in names
            if a != b and take[a] - step >= min(room[a], floors.get(a, 0)) and take[b] + step <= room[b]
        ]
        best = max(moves, default=(0.0, "", ""))
        if best[0] > 1e-9:
            take[best[1]] -= step
            take[best[2]] += step
        else:
            step //= 2
    return start, take


def least_deviation(have: dict[str, int], permille: dict[str, int], floors: dict[str, int], total: int) -> float:
    """The least deviation that any sample of ``total`` records within the minimums and the pool has: the targets, moved into what each
    category allows, and what is then missing or too much filled up record by record where it costs least."""
    low = {c: min(have.get(c, 0), floors.get(c, 0)) for c in permille}
    take = {c: min(max(round(permille[c] * total / 1000), low[c]), have.get(c, 0)) for c in permille}
    over = sum(take.values()) - total
    while over:
        sign = -1 if over > 0 else 1
        open_ = [c for c in take if (take[c] > low[c] if over > 0 else take[c] < have.get(c, 0))]
        if not open_:
            break
        # costs of the next record rise per category, so the cheapest first is best; as many at once as cost alike
        far = {c: sign * (permille[c] * total / 1000 - take[c]) for c in open_}
        c = max(far, key=far.get)
        room = (take[c] - low[c]) if over > 0 else have.get(c, 0) - take[c]
        n = max(1, min(abs(over), room, int(far[c]) if far[c] >= 1 else (room if far[c] <= -1 else 1)))
        take[c] += sign * n
        over += sign * n
    return deviation(take, permille)


def plan(pooled: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(target_set, category, available, needed, sample_size, permille, start, take, least_deviation): counts of the random start and of the repaired
    sample, and the least deviation of the set that any sample of that size could have.

    Collected are the pool's counts by category and the target rows, both as many as categories and sets.
    """
    have = {r["category"]: r["n"] for r in pooled.groupBy("category").agg(F.count("*").alias("n")).collect()}
    n_pool = sum(have.values())
    sets: dict[str, list] = {}
    for r in targets.distinct().collect():
        if r["target_set"] is not None and r["scam_type"] is not None:
            sets.setdefault(r["target_set"], []).append(r)
    rows = []
    for name in sorted(sets):
        of = sorted(sets[name], key=lambda r: r["scam_type"])
        size = floor(n_pool * (of[0]["sample_permille"] or 0) / 1000)
        permille = {r["scam_type"]: r["target_permille"] or 0 for r in of}
        need = {r["scam_type"]: max(r["min_rows"] or 0, -(-permille[r["scam_type"]] * size // 1000)) for r in of}
        start, take = repair(have, permille, {r["scam_type"]: r["min_rows"] or 0 for r in of}, size, seed)
        least = least_deviation(have, permille, {r["scam_type"]: r["min_rows"] or 0 for r in of}, sum(take.values()))
        rows += [(name, c, have.get(c, 0), need[c], size, permille[c], start[c], take[c], float(least)) for c in permille]
    schema = "target_set string, category string, available long, needed long, sample_size long, permille int, start long, take long, least_deviation double"
    return targets.sparkSession.createDataFrame(rows, schema)


def draw(pooled: DataFrame, planned: DataFrame, *, key: str = "id", seed: int = 0, bucket_rows: int = 5000) -> DataFrame:
    """(target_set, key, category): the planned numbers of records, drawn by hash.

    Counts per (category, hash bucket) tell in which bucket the last record taken lies; buckets before
    it are taken whole and only that one is ordered. The number of buckets grows with the pool.
    """
    buckets = max(1, -(-planned.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0] // bucket_rows))
    h = F.xxhash64(F.lit(seed), F.col(key))
    keyed = pooled.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    counts = keyed.groupBy("category", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("category").orderBy("bucket"))
    edges = (
        counts.withColumn("upto", upto)
        .join(F.broadcast(planned.filter("take > 0").select("target_set", "category", "take")), "category")
        .filter(F.col("upto") - F.col("n") < F.col("take"))
        .select("target_set", "category", "bucket", F.when(F.col("upto") > F.col("take"), F.col("take") - F.col("upto") + F.col("n")).alias("part"))
    )
    picked = keyed.join(edges, ["category", "bucket"])
    whole = picked.filter(F.col("part").isNull())
    w = Window.partitionBy("target_set", "category", "bucket").orderBy("h", key)
    part = picked.filter(F.col("part").isNotNull()).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= F.col("part")).drop("rn")
    return whole.unionByName(part).select("target_set", key, "category")


def shortfalls(drawn: DataFrame, planned: DataFrame) -> DataFrame:
    """(target_set, scam_type, available, needed, drawn): where the sample cannot have the records needed, told from the drawn sample.

    A category has less than needed in the pool exactly if it is short after the repair has given it everything there
    is to give; one that is short in the sample although the pool holds enough is not among them.
    """
    n = drawn.groupBy("target_set", "category").agg(F.count("*").alias("drawn"))
    j = planned.join(n, ["target_set", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    short = j.filter((F.col("drawn") < F.col("needed")) & (F.col("available") < F.col("needed")))
    return short.select("target_set", F.col("category").alias("scam_type"), "available", "needed", "drawn")


def quality(drawn: DataFrame, planned: DataFrame) -> DataFrame:
    """(target_set, sample_size, drawn, start_deviation, deviation, least_deviation): the records drawn, and how many lie beyond their
    category's share at the random start, in the drawn sample and at best."""
    n = drawn.groupBy("target_set", "category").agg(F.count("*").alias("n"))
    j = planned.join(n, ["target_set", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = j.groupBy("target_set").agg(F.sum("n").alias("drawn"))
    off = lambda c: F.sum(F.abs(F.col(c) - F.col("permille") * F.col("drawn") / 1000)) / 2
    q = j.join(total, "target_set").groupBy("target_set").agg(F.first("sample_size").alias("sample_size"), F.first("drawn").alias("drawn"), off("start").alias("start_deviation"), off("n").alias("deviation"), F.first("least_deviation").alias("least_deviation"))
    return q


def sample(df: DataFrame, targets: DataFrame, *, key: str = "id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, plan) of every target set."""
    pooled = cut(pool(df, key=key))
    planned = plan(pooled, targets, seed)
    return draw(pooled, planned, key=key, seed=seed), planned
