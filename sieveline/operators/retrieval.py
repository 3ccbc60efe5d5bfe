"""Batch hybrid retrieval: exact vector and keyword arms, collapsed to documents and fused by reciprocal ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import tokens
from sieveline.functions.vector import score, usable
from sieveline.schemas import EMBEDDING_WIDTH
from sieveline.session import stage

CANDIDATES, RRF_K, TOP_K, RERANK_POOL = 80, 60, 5, 20
#: Queries are scored in blocks of this many, so that what is sent to the workers is bounded (8 MB at width 64).
QUERY_BLOCK = 16_384
_STEP = 1024  # rows and queries of one product of matrices


def _nearest(parts: list[tuple[np.ndarray, ...]], k: int, worst: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest different chunks of each query among (query, chunk, distance, document); ``worst`` gets the last one's distance."""
    q, i, d, doc = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((i, d, q))
    q, i, d, doc = q[order], i[order], d[order], doc[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])  # a chunk repeated whole has the same distance again
    q, i, d, doc = q[once], i[once], d[once], doc[once]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    last = rank == k - 1
    worst[q[last]] = d[last]
    return q[rank < k], i[rank < k], d[rank < k], doc[rank < k]


def vector_arm(queries: DataFrame, chunks: DataFrame, *, k: int = CANDIDATES, width: int = EMBEDDING_WIDTH, digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, document_id, distance, rank): the ``k`` nearest chunks of every query, exactly.

    ``queries`` (query_id, embedding) is a stated set, scored block by block against
    all chunks: a block goes to the workers, every partition keeps its ``k`` best for
    each query, and the parts are merged by a ranked window; the chunks themselves are
    never shuffled. Distances are rounded to ``digits`` and ties go to the smaller id.
    Vectors that cannot be compared, and rows repeated whole, do not count.
    """
    rows = chunks.filter(usable("embedding", width)).select("id", "document_id", "embedding")
    asked = queries.filter(usable("embedding", width)).select("query_id", "embedding").dropDuplicates(["query_id"])
    n = asked.count()
    blocks = -(-n // QUERY_BLOCK)
    schema = "query_id string, chunk_id long, document_id long, distance double"
    parts = []
    for b in range(blocks):
        some = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = sorted(some.collect(), key=lambda r: str(r["query_id"]))
        if not got:
            continue
        m = np.array([r["embedding"] for r in got], np.float64)
        shared = rows.sparkSession.sparkContext.broadcast(([str(r["query_id"]) for r in got], (m / np.sqrt((m * m).sum(1, keepdims=True))).T))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, m = shared.value
            worst = np.full(m.shape[1], np.inf)
            kept: list[tuple[np.ndarray, ...]] = []
            held = 0
            for batch in batches:
                for at in range(0, batch.num_rows, _STEP):
                    p = batch.slice(at, _STEP)
                    ids, one = np.unique(p.column(0).to_numpy(), return_index=True)
                    x = p.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)[one]
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    doc = p.column(1).to_numpy(zero_copy_only=False)[one]
                    for s in range(0, m.shape[1], _STEP):
                        d = np.round(1 - x @ m[:, s : s + _STEP], digits) + 0.0
                        bound = worst[s : s + _STEP]
                        if len(d) > k and not np.isfinite(bound).all():
                            np.minimum(bound, np.partition(d, k - 1, axis=0)[k - 1], out=bound)
                        r, q = np.nonzero(d <= bound)
                        kept.append((q + s, ids[r], d[r, q], doc[r]))
                        held += len(r)
                    if held > 2_000_000:
                        kept = [_nearest(kept, k, worst)]
                        held = len(kept[0][0])
            if kept:
                q, i, d, doc = _nearest(kept, k, worst)
                yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in q], pa.string()), pa.array(i), pa.array(doc), pa.array(d)], names=["query_id", "chunk_id", "document_id", "distance"])

        parts.append(rows.mapInArrow(work, schema))
    if not parts:
        parts = [rows.sparkSession.createDataFrame([], schema)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def keyword_arm(queries: DataFrame, chunks: DataFrame, *, k: int = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, document_id, hits, rank): chunks that hold every word of a query, best first.

    ``queries`` is (query_id, text), whole texts of any length. Words are folded; the score
    is how often the query's distinct words occur in the chunk; ties go to the smaller id; a
    query without words matches nothing. Queries of the same words are one class. A class is
    joined with the chunks that hold its rarest word only, and those are checked for all
    its words, so common words never bring chunks and queries together. Rows repeated
    whole count once.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.array_sort(F.array_distinct(tokens("text"))).alias("words")).filter(F.size("words") > 0)
    asked = stage(asked.distinct().withColumn("class", F.xxhash64("words")))
    classes = asked.dropDuplicates(["class", "words"]).select("class", "words")
    vocabulary = classes.select(F.explode("words").alias("word")).distinct()
    rows = chunks.filter(F.col("content").isNotNull()).select(F.col("id").alias("chunk_id"), "document_id", tokens("content").alias("tokens"))
    index = stage(rows.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("word")).join(vocabulary, "word", "left_semi").distinct())
    frequency = index.groupBy("word").agg(F.count("*").alias("n"))
    known = classes.select("class", F.size("words").alias("need"), F.explode("words").alias("word")).join(frequency, "word")
    rarest = known.groupBy("class").agg(F.first("need").alias("need"), F.count("*").alias("have"), F.min_by("word", F.struct("n", "word")).alias("word"))
    meet = index.join(rarest.filter("have = need").select("class", "word"), "word").select("class", "chunk_id")
    both = meet.join(classes, "class").join(rows, "chunk_id").filter(F.size(F.array_except("words", "tokens")) == 0)
    hits = F.size(F.filter("tokens", lambda t: F.array_contains(F.col("words"), t))).cast("long")
    full = both.select("class", "words", "chunk_id", "document_id", hits.alias("hits")).distinct()
    best = full.withColumn("rank", F.row_number().over(Window.partitionBy("class", "words").orderBy(F.desc("hits"), "chunk_id"))).filter(F.col("rank") <= k)
    return best.join(asked, ["class", "words"]).select("query_id", "chunk_id", "document_id", "hits", "rank")


def collapse(matches: DataFrame) -> DataFrame:
    """The best-ranked match of each document of a query, ranked anew; takes and gives ``rank``."""
    one = Window.partitionBy("query_id", "document_id").orderBy("rank")
    best = matches.withColumn("rn", F.row_number().over(one)).filter("rn = 1").drop("rn")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def fuse(*arms: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, document_id, score, rank): the sum of 1 / (k + rank) over the arms' collapsed ranks; ties go to the smaller document."""
    both = arms[0].select("query_id", "document_id", "rank")
    for a in arms[1:]:
        both = both.unionByName(a.select("query_id", "document_id", "rank"))
    fused = both.groupBy("query_id", "document_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "document_id")
    return fused.withColumn("rank", F.row_number().over(w))


def hybrid(queries: DataFrame, chunks: DataFrame, *, top_k: int | None = TOP_K, candidates: int = CANDIDATES) -> DataFrame:
    """Fused ranking of both arms for queries (query_id, text, embedding); the first ``top_k`` documents, or all."""
    fused = fuse(collapse(vector_arm(queries, chunks, k=candidates)), collapse(keyword_arm(queries, chunks, k=candidates)))
    return fused if top_k is None else fused.filter(F.col("rank") <= top_k)


def rerank(ranked: DataFrame, scored, *, pool: int = RERANK_POOL, top_k: int = TOP_K) -> DataFrame:
    """The first ``pool`` of each query in the order of column ``scored``, which overwrites ``score``; ties keep their order."""
    w = Window.partitionBy("query_id").orderBy(F.desc(scored), "rank")
    some = ranked.filter(F.col("rank") <= pool).withColumn("score", scored.cast("double"))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))).filter(F.col("rank") <= top_k)


def with_documents(ranked: DataFrame, documents: DataFrame) -> DataFrame:
    """Ranked documents with title, body, type and URL of the document, never of the chunk."""
    d = documents.dropDuplicates(["id"]).select(F.col("id").alias("document_id"), "title", "content", "prevention", "scam_type", "url")
    return ranked.join(d, "document_id")


def distance_score(matches: DataFrame) -> DataFrame:
    """Matches of the vector arm with ``score`` between 0 and 1 for their distance."""
    return matches.withColumn("score", F.round(score(F.col("distance")), 6))
