from sieveline.operators import retrieval as R


def arm(spark, rows):
    return spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(rows)], "query_id string, document_id long, rank int")


def order(df):
    return [r["document_id"] for r in df.orderBy("rank").collect()]


def test_agreement_of_both_arms_wins(spark):
    assert order(R.fuse(arm(spark, [2, 1]), arm(spark, [1, 3])))[0] == 1


def test_ties_go_to_the_smaller_document(spark):
    assert order(R.fuse(arm(spark, [20]), arm(spark, [10]))) == [10, 20]


def test_one_empty_arm_keeps_the_order(spark):
    assert order(R.fuse(arm(spark, [5, 1, 9]), arm(spark, []))) == [5, 1, 9]


def test_fusion_does_not_depend_on_the_order_of_arms(spark):
    a, b = arm(spark, [4, 2, 7, 1]), arm(spark, [7, 3, 2])
    assert order(R.fuse(a, b)) == order(R.fuse(b, a))


def test_a_document_with_three_vectors_counts_once(spark):
    m = spark.createDataFrame([("q", 1, 1), ("q", 1, 2), ("q", 1, 3)], "query_id string, document_id long, rank int")
    one = R.fuse(R.collapse(m), arm(spark, [2])).filter("document_id = 1").first()
    assert one["score"] == 1 / 61


def test_collapse_keeps_the_best_and_ranks_anew(spark):
    m = spark.createDataFrame([("q", 1, 1), ("q", 1, 2), ("q", 1, 3), ("q", 2, 4)], "query_id string, document_id long, rank int")
    assert [(r["document_id"], r["rank"]) for r in R.collapse(m).orderBy("rank").collect()] == [(1, 1), (2, 2)]


CHUNKS = "id long, document_id long, content string, embedding array<float>"


def test_vector_arm_is_exact_with_ties_and_unusable_vectors(spark):
    rows = [
        (1, 1, "a", [1.0, 0.0]), (2, 1, "b", [1.0, 0.0]), (2, 1, "b", [1.0, 0.0]), (3, 2, "c", [0.0, 2.0]), (4, 2, "d", None),
        (5, 3, "e", [0.0, 0.0]), (6, 3, "f", [1.0]), (7, 3, "g", [float("nan"), 1.0]), (8, 4, "h", [-1.0, 0.0]),
    ]
    q = spark.createDataFrame([("q", [2.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, embedding array<float>")
    got = R.vector_arm(q, spark.createDataFrame(rows, CHUNKS), k=3, width=2).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["distance"]) for r in got] == [("q", 1, 0.0), ("q", 2, 0.0), ("q", 3, 1.0)]


def test_vector_arm_without_queries_or_chunks(spark):
    q = spark.createDataFrame([], "query_id string, embedding array<float>")
    c = spark.createDataFrame([], CHUNKS)
    assert R.vector_arm(q, c, width=2).count() == 0
    assert R.vector_arm(spark.createDataFrame([("q", [1.0, 0.0])], q.schema), c, width=2).count() == 0


def test_distance_becomes_a_score_between_0_and_1(spark):
    d = spark.createDataFrame([(0.2,), (1.1,)], "distance double")
    assert [r["score"] for r in R.distance_score(d).collect()] == [0.8, 0.0]


def test_keyword_arm_needs_every_word_and_ignores_accents(spark):
    rows = [(1, 1, "Lừa đảo qua mạng, lừa", None), (2, 2, "lua dao", None), (3, 3, "chỉ lừa", None), (4, 4, None, None), (5, 5, "", None)]
    q = spark.createDataFrame([("a", "LUA dao"), ("b", "?!"), ("c", None), ("d", "khác")], "query_id string, text string")
    got = R.keyword_arm(q, spark.createDataFrame(rows, CHUNKS)).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["hits"]) for r in got] == [("a", 1, 3), ("a", 2, 2)]


def test_a_dominating_document_does_not_starve_others(spark):
    m = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate([1, 1, 1, 1, 2, 3, 4, 5, 6])], "query_id string, document_id long, rank int")
    assert order(R.collapse(m).filter("rank <= 5")) == [1, 2, 3, 4, 5]


def test_rerank_overwrites_score_and_cuts(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("q", 1, 1, 0.5, 10), ("q", 2, 2, 0.4, 30), ("q", 3, 3, 0.3, 30)], "query_id string, document_id long, rank int, score double, n int")
    got = R.rerank(r, F.col("n"), top_k=2).orderBy("rank").collect()
    assert [(x["document_id"], x["score"]) for x in got] == [(2, 30.0), (3, 30.0)]
