"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm import boilerplate, leakage, near_duplicates, neighbours, packing, proportions, splitting, text_statistics, truncation
from sieveline.operators import retrieval


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark, sf):
    return splitting.oversized(_table(spark, sf, "scam_documents"))


def p1_pieces(spark, sf):
    return splitting.split(_table(spark, sf, "scam_documents"))


def p1_checks(spark, sf):
    """The pieces of each text: none over the limit, no overlap beyond what is set, and joined without overlaps they are the text again."""
    p = splitting.split(_table(spark, sf, "scam_documents"))
    new = F.substring(F.col("content"), (F.col("new_from") - F.col("start") + 1).cast("int"), F.length("content"))
    by = p.groupBy("id").agg(
        F.max("n_chars").alias("longest"), F.max(F.col("new_from") - F.col("start")).alias("overlap"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", new.alias("x")))), lambda s: s["x"]), "").alias("whole")
    )
    return by.select("id", (F.col("longest") <= 2048).alias("short"), (F.col("overlap") <= 200).alias("little_overlap"), F.md5("whole").alias("whole"))


def _texts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {name: _table(spark, sf, name) for name in ("scam_documents", "chunks")}


def p2_found(spark, sf):
    return boilerplate.body_lines(_table(spark, sf, "fetched_docs"), _table(spark, sf, "scam_documents")).select("fetch_id", "line_no")


def p2_bodies(spark, sf):
    return boilerplate.body_lines(_table(spark, sf, "fetched_docs"), _table(spark, sf, "scam_documents"))


def p3_found(spark, sf):
    pairs = near_duplicates.near_pairs(_texts(spark, sf), words_per_shingle=3, threshold=0.6, measure="plain")
    return pairs.select("rec_table", "id_a", "id_b")


def p3_groups(spark, sf):
    """The groups that the pairs of p3_found form."""
    return near_duplicates.near_groups(_texts(spark, sf), words_per_shingle=3, threshold=0.6, measure="plain")


def p3_pairs(spark, sf):
    """Pairs by the weighted measure at the defaults, five words and 0.8."""
    return near_duplicates.near_pairs(_texts(spark, sf)).select("rec_table", "id_a", "id_b", F.round("similarity", 6).alias("similarity"))


def _sample(spark, sf):
    return proportions.sample(_table(spark, sf, "scam_documents"), _table(spark, sf, "sample_targets"))


def p4_found(spark, sf):
    return proportions.shortfalls(*_sample(spark, sf)).select("target_set", "scam_type")


def p4_sample(spark, sf):
    return _sample(spark, sf)[0]


def p4_report(spark, sf):
    drawn, planned = _sample(spark, sf)
    n = drawn.groupBy("target_set", "category").agg(F.count("*").alias("drawn"))
    return planned.join(n, ["target_set", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).drop("start", "least_deviation")


def p4_quality(spark, sf):
    """Whether each sample is what was asked for: its size, its minimums, no record twice, and a deviation as small as can be and no larger than at the start."""
    drawn, planned = _sample(spark, sf)
    q = proportions.quality(drawn, planned)
    q = q.select("target_set", "drawn", (F.col("deviation") <= F.col("start_deviation") + 1e-9).alias("repaired"), (F.col("deviation") <= F.col("least_deviation") + 1e-9).alias("best"))
    twice = drawn.groupBy("target_set").agg((F.count("*") == F.count_distinct("id")).alias("no_record_twice"))
    return q.join(twice, "target_set")


def p5_found(spark, sf):
    near = neighbours.neighbours(_table(spark, sf, "chunks"), min_cosine=0.9, quota=1536, share=0.0)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p5_neighbours(spark, sf):
    """Queries are the ids divisible by 20, against all rows."""
    return neighbours.neighbours(_table(spark, sf, "chunks"), queries=F.col("id") % 20 == 0)


def p5_recall(spark, sf):
    """Whether the search finds nine tenths of the true five neighbours of its queries, which a comparison with all vectors tells."""
    c = _table(spark, sf, "chunks")
    asked = c.filter("id % 20 = 0").select(F.col("id").cast("string").alias("query_id"), "embedding")
    near = retrieval.vector_arm(asked, c, k=6, digits=9).filter("query_id <> chunk_id")
    true = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("r <= 5").select(F.col("query_id").cast("long").alias("id"), F.col("chunk_id").alias("neighbour"))
    found = p5_neighbours(spark, sf).select("id", "neighbour", F.lit(True).alias("found"))
    hit = true.join(found, ["id", "neighbour"], "left").agg(F.count("*").alias("n_true"), F.count("found").alias("n_found"))
    return hit.select("n_true", (F.col("n_found") >= 0.9 * F.col("n_true")).alias("reached"))


def p6_found(spark, sf):
    return truncation.cut_values(_table(spark, sf, "scam_documents")).select("id", "field").distinct()


def p6_shares(spark, sf):
    return truncation.cut_shares(_table(spark, sf, "scam_documents"))


def p7_found(spark, sf):
    return packing.pack(_table(spark, sf, "documents")).filter("n_pieces > 1").select("doc_id").distinct()


def p7_containers(spark, sf):
    return packing.pack(_table(spark, sf, "documents"))


def p7_blocks(spark, sf):
    """What each block of the packing needs, how many containers it takes and how many more than the least that could do."""
    return packing.block_report(packing.pack(_table(spark, sf, "documents")))


def p7_checks(spark, sf):
    """The packing as a whole: all tokens of all texts are in containers, none holds too much, whole texts are whole, and hardly any room is left."""
    p = packing.pack(_table(spark, sf, "documents"))
    used = p.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    texts = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("n"), F.first("n_pieces").alias("n_pieces"))
    t = texts.agg(F.count("*").alias("n_texts"), F.sum("size").alias("n_tokens"), F.count_if((F.col("n") != F.col("n_pieces")) | ((F.col("n") > 1) & (F.col("size") <= 4096))).alias("n_torn"))
    c = used.agg(F.count_if(F.col("used") > 4096).alias("n_over"), (F.count("*") <= F.ceil(F.sum("used") / 4096) * 1.01 + 1).alias("tight"))
    return t.join(c)


def p8_found(spark, sf):
    return leakage.leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark_cases")).select("doc_id", "case_id")


def p8_report(spark, sf):
    cases = _table(spark, sf, "benchmark_cases")
    return leakage.leak_report(leakage.leaks(_table(spark, sf, "documents"), cases), cases)


def p9_found(spark, sf):
    return text_statistics.forms(_table(spark, sf, "documents")).filter("form <> 'prose'").select("doc_id", "form")


def p9_statistics(spark, sf):
    return text_statistics.text_statistics(_table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


# runs of thirteen words of the texts (ga) and of the cases (gb), with the place of the first
_FOLDED_WORDS = r"regexp_split_to_array(trim(regexp_replace(replace(strip_accents(lower({})), 'đ', 'd'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w"
_LEAKS = f"""
            a AS (SELECT DISTINCT doc_id, {_FOLDED_WORDS.format("text")} FROM documents WHERE text IS NOT NULL),
            b AS (SELECT DISTINCT case_id, {_FOLDED_WORDS.format("item_text")} FROM benchmark_cases),
            ga AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest([array_to_string(w[i:i + 12], ' ') for i in range(1, len(w) - 11)]) AS g FROM a WHERE len(w) >= 13),
            gb AS (SELECT case_id, unnest(range(1, len(w) - 11)) AS i, unnest([array_to_string(w[i:i + 12], ' ') for i in range(1, len(w) - 11)]) AS g FROM b WHERE len(w) >= 13)"""


_PAIRS = r"""
            t AS (
              SELECT DISTINCT 'scam_documents' AS tab, id, content FROM scam_documents UNION SELECT DISTINCT 'chunks', id, content FROM chunks),
            w AS (
              SELECT tab, id, list_filter(regexp_split_to_array(lower(nfc_normalize(content)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
              FROM t WHERE content IS NOT NULL),
            s AS (SELECT DISTINCT tab, id, unnest([hash(w[i], w[i + 1], w[i + 2]) for i in range(1, len(w) - 1)]) AS s FROM w WHERE len(w) >= 3),
            f AS (SELECT s, count(*) AS n FROM s GROUP BY s),
            o AS (
              SELECT tab, id, s, row_number() OVER (PARTITION BY tab, id ORDER BY f.n, s) AS rn, count(*) OVER (PARTITION BY tab, id) AS size
              FROM s JOIN f USING (s)),
            -- of two sets that are alike by 0.6, the rarest parts share an element
            p AS (SELECT * FROM o WHERE rn <= size - ceil(0.6 * size) + 1),
            c AS (SELECT DISTINCT tab, a.id AS id_a, b.id AS id_b, a.size AS na, b.size AS nb FROM p a JOIN p b USING (tab, s) WHERE a.id < b.id),
            x AS (
              SELECT c.tab, id_a, id_b, na, nb, count(*) AS n FROM c JOIN s a ON a.tab = c.tab AND a.id = id_a JOIN s b ON b.tab = c.tab AND b.id = id_b AND b.s = a.s
              GROUP BY ALL),
            pairs AS (SELECT tab AS rec_table, id_a, id_b FROM x WHERE n >= 0.6 * (na + nb - n))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
            SELECT DISTINCT id, CASE WHEN regexp_matches(content, '\S{1000}\S{1000}\S{49}') THEN 'forced' ELSE 'natural' END AS cut
            FROM scam_documents WHERE length(content) > 2048""",
        "p3_found": f"WITH {_PAIRS} SELECT rec_table, id_a, id_b FROM pairs",
        "p3_groups": f"""WITH RECURSIVE {_PAIRS},
            e AS (SELECT rec_table, id_a AS x, id_b AS y FROM pairs UNION ALL SELECT rec_table, id_b, id_a FROM pairs),
            g AS (SELECT DISTINCT rec_table, x AS id, x AS of FROM e UNION SELECT g.rec_table, e.y, g.of FROM g JOIN e ON e.rec_table = g.rec_table AND e.x = g.id)
            SELECT rec_table, id, min(of) AS group_id, (SELECT count(*) FROM e WHERE e.rec_table = g.rec_table AND e.x = g.id) AS n_links FROM g GROUP BY rec_table, id""",
        "p5_found": r"""
            WITH v AS (
              SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM chunks
              WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            n AS (
              SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id
              QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) <= 5)
            SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM n WHERE c >= 0.9""",
        "p1_checks": "SELECT DISTINCT id, true AS short, true AS little_overlap, md5(content) AS whole FROM scam_documents WHERE content IS NOT NULL",
        "p7_checks": """SELECT count(*) AS n_texts, sum(octet_length(encode(text)) + 1)::BIGINT AS n_tokens, 0::BIGINT AS n_torn, 0::BIGINT AS n_over, true AS tight
            FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)""",
        "p8_report": f"""WITH {_LEAKS},
            -- runs of a text and a case on one diagonal that follow each other
            m AS (SELECT doc_id, case_id, ga.i AS i, ga.i - gb.i AS d FROM ga JOIN gb USING (g)),
            r AS (SELECT doc_id, case_id, d, i - row_number() OVER (PARTITION BY doc_id, case_id, d ORDER BY i) AS run FROM (SELECT DISTINCT * FROM m)),
            l AS (SELECT doc_id, case_id, max(n) AS n FROM (SELECT doc_id, case_id, count(*) + 12 AS n FROM r GROUP BY doc_id, case_id, d, run) GROUP BY doc_id, case_id)
            SELECT b.case_id, count(l.doc_id) AS n_texts, coalesce(max(l.n), 0)::INT AS longest FROM (SELECT DISTINCT case_id FROM benchmark_cases) b LEFT JOIN l USING (case_id) GROUP BY b.case_id""",
        "p5_recall": """WITH v AS (SELECT DISTINCT id FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
            SELECT (count(*) FILTER (WHERE id % 20 = 0) * least(5, count(*) - 1))::BIGINT AS n_true, true AS reached FROM v""",
        "p4_found": r"""
            WITH pool AS (
              SELECT DISTINCT id, replace(replace(lower(trim(scam_type)), '-', '_'), ' ', '_') AS t FROM scam_documents),
            known AS (SELECT id, t FROM pool WHERE t IN (SELECT DISTINCT scam_type FROM sample_targets)),
            n AS (SELECT t, count(*) AS n FROM known GROUP BY t),
            s AS (SELECT DISTINCT x.*, floor((SELECT count(*) FROM known) * sample_permille / 1000) AS size FROM sample_targets x)
            SELECT target_set, scam_type FROM s LEFT JOIN n ON n.t = s.scam_type
            WHERE coalesce(n.n, 0) < greatest(min_rows, ceil(target_permille * size / 1000))""",
        "p4_quality": r"""
            WITH pool AS (SELECT DISTINCT id, replace(replace(lower(trim(scam_type)), '-', '_'), ' ', '_') AS t FROM scam_documents),
            known AS (SELECT id, t FROM pool WHERE t IN (SELECT DISTINCT scam_type FROM sample_targets)),
            n AS (SELECT t, count(*) AS n FROM known GROUP BY t),
            s AS (SELECT DISTINCT x.*, floor((SELECT count(*) FROM known) * sample_permille / 1000) AS size FROM sample_targets x)
            SELECT target_set, greatest(max(size), sum(least(coalesce(n, 0), min_rows)))::BIGINT AS drawn, true AS repaired, true AS best, true AS no_record_twice
            FROM s LEFT JOIN n ON n.t = s.scam_type GROUP BY target_set""",
        "p7_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 4096",
        "p8_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, case_id FROM ga JOIN gb USING (g)",
    }
