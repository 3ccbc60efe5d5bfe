import itertools

import numpy as np

from sieveline.operators import similarity as S


def rows(spark, x, g=None, extra=()):
    data = [(i, [float(v) for v in r], (g[i] if g else "a")) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(data, "id long, embedding array<float>, g string")


def test_blocks_give_the_pairs_of_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(30, 8)), 4, axis=0) + rng.normal(size=(120, 8)) * 0.2
    g = ["a" if i % 3 else "b" for i in range(120)]
    got = {(r["a"], r["b"]) for r in S.similar_pairs(rows(spark, x, g), ["g"], least=0.9, width=8, block_rows=11).collect()}
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == {(i, j) for i, j in itertools.combinations(range(120), 2) if g[i] == g[j] and round(float(u[i] @ u[j]), 6) >= 0.9}


def test_nulls_and_unusable_vectors_form_no_pair(spark):
    df = rows(spark, [[1, 0], [1, 0]], None, [(5, None, "a"), (6, [0.0, 0.0], "a"), (7, [1.0], "a"), (8, [1.0, 0.0], None), (1, [1.0, 0.0], "a")])
    assert [(r["a"], r["b"]) for r in S.similar_pairs(df, ["g"], least=0.5, width=2).collect()] == [(0, 1)]
    assert S.similar_pairs(df.limit(0), ["g"], least=0.5, width=2).count() == 0


def chunk_rows(spark, vectors, kind="query"):
    return spark.createDataFrame([(i, 1, kind, [float(v) for v in x] + [0.0] * 60) for i, x in enumerate(vectors)], "id long, document_id long, kind string, embedding array<float>")


def test_greedy_fold_drops_only_against_kept_chunks(spark):
    df = chunk_rows(spark, [[1, 0, 0, 0], [1, 0, 0, 0], [0, 1, 0, 0]])
    assert {r["id"] for r in S.greedy_kept(df).filter("kept").collect()} == {0, 2}
    # a ~ b, b ~ c, a !~ c: c stays because b was dropped
    t = np.deg2rad([0, 15, 30])
    chain = chunk_rows(spark, [[np.cos(a), np.sin(a), 0, 0] for a in t])
    assert {r["id"] for r in S.greedy_kept(chain).filter("kept").collect()} == {0, 2}


def test_greedy_fold_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 4))[rng.integers(0, 12, 60)] + rng.normal(size=(60, 4)) * 0.15
    kept: list[int] = []
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for i in range(60):
        if all(round(float(u[i] @ u[j]), 6) <= 0.95 for j in kept):
            kept.append(i)
    assert {r["id"] for r in S.greedy_kept(chunk_rows(spark, x)).filter("kept").collect()} == set(kept)


def test_content_chunks_are_always_kept(spark):
    assert S.greedy_kept(chunk_rows(spark, [[1, 0, 0, 0]] * 3, "content")).filter("NOT kept").count() == 0


def test_audit_pairs_and_summary(spark):
    d = spark.createDataFrame([(1, "u1", "x"), (2, "u2", "x"), (3, "u3", "y")], "id long, url string, scam_type string")
    v = [1.0] + [0.0] * 63
    c = spark.createDataFrame([(10, 1, "query", "aaaa", v), (11, 2, "query", "bbbb", v), (12, 1, "query", "cc", v), (13, 3, "query", "dd", v), (14, 2, "content", "e", v)],
                              "id long, document_id long, kind string, content string, embedding array<float>")
    a = S.duplicate_audit(c, d, preview_len=2)
    assert {(r["a_id"], r["b_id"], r["a_preview"]) for r in a.collect()} == {(10, 11, "aa"), (11, 12, "bb")}
    assert [(r["scam_type"], r["n_pairs"], r["n_chunks"]) for r in S.audit_summary(a).collect()] == [("x", 2, 3)]
    assert S.duplicate_audit(c, d, scam_type="y").count() == 0
