"""Exact similarity joins of vectors in blocks, and what is built on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.vector import usable
from sieveline.schemas import EMBEDDING_WIDTH
from sieveline.session import cut


def similar_pairs(rows: DataFrame, by: list[str], *, least: float, strict: bool = False, width: int = EMBEDDING_WIDTH, block_rows: int = 4096, digits: int = 6) -> DataFrame:
    """(a, b, similarity) for rows (id, embedding, ``by``...) with equal ``by``, a < b and cosine at least ``least``.

    Exact. A group is cut into blocks by hash and every pair of blocks is one task's
    work, a product of two matrices of ``block_rows`` rows at most, so a group of any
    share of the table is spread evenly; only pairs that reach the threshold leave the
    task. The work is quadratic in a group's size. Rows whose ``by`` holds a null or whose
    vector cannot be compared form no pair; ids repeated count once.
    """
    some = rows.filter(usable("embedding", width)).dropna(subset=by).select("id", "embedding", F.xxhash64(*by).alias("g"), F.to_json(F.struct(*by)).alias("gk")).dropDuplicates(["id"])
    sizes = some.groupBy("g", "gk").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("nb"))
    placed = some.join(sizes, ["g", "gk"]).withColumn("bk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    spread = placed.withColumn("o", other).select(
        "gk", F.least("bk", "o").alias("lo"), F.greatest("bk", "o").alias("hi"), "bk", "id", "embedding"
    )

    def block(t: pa.Table) -> pa.Table:
        x = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        ids, bk = t["id"].to_numpy(), t["bk"].to_numpy()
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        left, right = np.flatnonzero(bk == lo), np.flatnonzero(bk == hi)
        out = []
        for s in range(0, len(left), 1024):
            i = left[s : s + 1024]
            sim = np.round(x[i] @ x[right].T, digits)
            r, c = np.nonzero((sim > least) if strict else (sim >= least))
            a, b = ids[i[r]], ids[right[c]]
            keep = a < b if lo == hi else a != b
            out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], sim[r, c][keep]))
        a, b, s = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": a, "b": b, "similarity": s})

    return spread.groupBy("gk", "lo", "hi").applyInArrow(block, "a long, b long, similarity double")


def duplicate_audit(chunks: DataFrame, documents: DataFrame, *, least: float = 0.95, scam_type: str = "", preview_len: int = 80) -> DataFrame:
    """Pairs of chunks of one kind and type but of different documents that are alike, with previews; ``in_audit_order`` orders them."""
    d = documents.dropDuplicates(["id"]).select(F.col("id").alias("document_id"), "url", "scam_type")
    c = chunks.dropDuplicates(["id"]).join(d, "document_id")
    if scam_type:
        c = c.filter(F.col("scam_type") == scam_type)
    pairs = similar_pairs(c.select("id", "embedding", "kind", "scam_type"), ["kind", "scam_type"], least=least)
    side = c.select("id", "document_id", "url", "kind", "scam_type", F.substring("content", 1, preview_len).alias("preview"))
    a = side.withColumnsRenamed({"id": "a", "document_id": "a_doc", "url": "a_url", "preview": "a_preview"})
    b = side.select(F.col("id").alias("b"), F.col("document_id").alias("b_doc"), F.col("url").alias("b_url"), F.col("preview").alias("b_preview"))
    return pairs.join(a, "a").join(b, "b").filter("a_doc <> b_doc").withColumnsRenamed({"a": "a_id", "b": "b_id"}).select(
        "scam_type", "kind", "similarity", "a_id", "a_doc", "a_url", "a_preview", "b_id", "b_doc", "b_url", "b_preview"
    )


def in_audit_order(pairs: DataFrame) -> DataFrame:
    """By type, then the most alike first, then the ids."""
    return pairs.orderBy("scam_type", F.desc("similarity"), "a_id", "b_id")


def audit_summary(pairs: DataFrame) -> DataFrame:
    """(scam_type, n_pairs, n_chunks): pairs and different chunks involved by type."""
    n = pairs.groupBy("scam_type").agg(F.count("*").alias("n_pairs"))
    ends = pairs.select("scam_type", F.col("a_id").alias("id")).unionByName(pairs.select("scam_type", F.col("b_id").alias("id"))).distinct()
    return n.join(ends.groupBy("scam_type").agg(F.count("*").alias("n_chunks")), "scam_type")


def greedy_kept(chunks: DataFrame, *, most: float = 0.95) -> DataFrame:
    """(id, document_id, kept): the chunks left when each query chunk too similar to an earlier kept one of its document is dropped.

    Content chunks and chunks without a usable vector are kept. Order is by id. The greedy
    rule looks at kept chunks only, so it is solved in rounds over the links of similar
    pairs: a chunk all of whose earlier partners are dropped is kept, one with a kept earlier
    partner is dropped, until all are decided. Copies of a vector are not linked with each
    other. No document's chunks need be in one place.
    """
    rows = chunks.dropDuplicates(["id"])
    queries = rows.filter("kind = 'query'").select("id", "embedding", "document_id")
    # equal vectors of a document are one class: a copy is dropped whether its first is kept or was too similar to another
    firsts = cut(queries.filter(usable("embedding")).groupBy("document_id", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    copied = firsts.filter(F.lit(most < 1.0) & (F.col("n") > 1) & F.col("document_id").isNotNull()).select("document_id", "embedding", F.col("id").alias("first"))
    copies = queries.join(copied, ["document_id", "embedding"]).filter("id <> first").select("id", F.lit(False).alias("kept"))
    links = cut(similar_pairs(firsts.select("id", "embedding", "document_id"), ["document_id"], least=most, strict=True).select("a", "b"))
    nodes = links.select(F.col("b").alias("id")).unionByName(links.select(F.col("a").alias("id"))).distinct()
    state = cut(nodes.withColumn("s", F.lit(0)))  # 0 open, 1 kept, 2 dropped
    while state.filter("s = 0").limit(1).count():
        earlier = links.join(state.withColumnRenamed("id", "a"), "a").groupBy("b").agg(
            F.max((F.col("s") == 1).cast("int")).alias("hit"), F.max((F.col("s") == 0).cast("int")).alias("open")
        )
        nxt = state.join(earlier.withColumnRenamed("b", "id"), "id", "left").na.fill(0, ["hit", "open"])
        state = cut(nxt.select("id", F.when(F.col("s") != 0, F.col("s")).when(F.col("hit") == 1, 2).when(F.col("open") == 0, 1).otherwise(0).alias("s")))
    dropped = state.filter("s = 2").select("id", F.lit(False).alias("kept")).unionByName(copies)
    return rows.select("id", "document_id").join(dropped, "id", "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
