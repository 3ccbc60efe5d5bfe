import numpy as np

from sieveline.functions.wordstream import kgrams, words
from sieveline.llm import near_duplicates as N
from sieveline.llm.components import components

RNG = np.random.default_rng(5)
VOCABULARY = [f"từ{i}" for i in range(4000)]


def text(n=120):
    return " ".join(RNG.choice(VOCABULARY, n))


def edited(t, n):
    w = t.split()
    for i in RNG.integers(0, len(w), n):
        w[i] = str(RNG.choice(VOCABULARY))
    return " ".join(w)


def jaccard(a, b, k):
    x, y = (set(kgrams(words([t], "lower"), k)[0].tolist()) for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, content string, t string, c int")


def test_pairs_of_brute_force(spark):
    base = [text() for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(t, 1 + i % 8)) for i, t in enumerate(base)]
    rows += [(200, base[0].upper()), (201, base[1]), (201, base[1]), (300, None), (301, ""), (302, "hai từ"), (303, "hai từ")]
    got = {(r["id_a"], r["id_b"]) for r in N.near_pairs({"a": make(spark, rows)}, words_per_shingle=3, threshold=0.6, measure="plain").collect()}
    real = [(i, t) for i, t in dict(rows).items() if t]
    want = {(min(i, j), max(i, j)) for i, t in real for j, u in real if i < j and jaccard(t, u, 3) >= 0.6}
    assert not got - want and len(got & want) >= 0.97 * len(want)
    assert (0, 200) in got and (1, 201) in got and (302, 303) not in got


def test_pairs_of_a_group_that_holds_a_third_of_the_texts(spark):
    base = text()
    texts = [edited(base, int(n)) for n in RNG.integers(2, 8, 300)] + [text() for _ in range(600)]
    sets = [{*zip(w, w[1:], w[2:])} for w in (t.lower().split() for t in texts[:300])]
    place = {s: i for i, s in enumerate(set().union(*sets))}
    has = np.zeros((300, len(place)), np.float32)
    for i, x in enumerate(sets):
        has[i, [place[s] for s in x]] = 1
    both = has @ has.T
    alike = both / (has.sum(1)[:, None] + has.sum(1) - both) >= 0.6
    want = {(int(i), int(j)) for i, j in np.argwhere(alike) if i < j}
    got = {(r["id_a"], r["id_b"]) for r in N.near_pairs({"a": make(spark, list(enumerate(texts)))}, words_per_shingle=3, threshold=0.6, measure="plain").collect()}
    print("recall", len(got & want) / len(want), "of", len(want))
    assert not got - want and len(got & want) >= 0.99 * len(want)


def test_a_hot_band_is_cut_into_blocks_without_losing_pairs(spark, monkeypatch):
    base = text()
    rows = [(i, edited(base, 1)) for i in range(120)] + [(500 + i, text()) for i in range(60)]
    args = dict(words_per_shingle=3, threshold=0.8, measure="plain")
    whole = {tuple(r)[:3] for r in N.near_pairs({"a": make(spark, rows)}, **args).collect()}
    monkeypatch.setattr(N, "HOT_BAND", 16)
    monkeypatch.setattr(N, "HOT_SHARE", 2)
    assert {tuple(r)[:3] for r in N.near_pairs({"a": make(spark, rows)}, **args).collect()} == whole and len(whole) > 5000


def test_bands_follow_from_the_least_weighted_similarity():
    bands, rows = N.plain_bands(0.6)
    assert 1 - (1 - N.weighted_bound(0.6) ** rows) ** bands >= N.PLAIN_RECALL and bands <= 128
    # the worst case: all that is shared is common, all that is not is rare
    assert abs(N.weighted_bound(0.6) - 0.6 * N.LEAST_PLAIN / (0.6 * N.LEAST_PLAIN + 0.4)) < 1e-12


def test_tables_are_kept_apart(spark):
    t = text()
    a, b = make(spark, [(1, t), (2, t)]), make(spark, [(1, t), (3, edited(t, 1))])
    got = {tuple(r)[:3] for r in N.near_pairs({"a": a, "b": b}, threshold=0.5).collect()}
    assert got == {("a", 1, 2), ("b", 1, 3)}


def test_many_copies_form_a_star_and_keep_links_to_other_texts(spark):
    t = text()
    rows = [(i, t) for i in range(50)] + [(99, edited(t, 1))]
    got = {(r["id_a"], r["id_b"]) for r in N.near_pairs({"a": make(spark, rows)}, threshold=0.5, expand=10).collect()}
    assert got == {(0, i) for i in range(1, 50)} | {(0, 99)}
    g = N.near_groups({"a": make(spark, rows)}, threshold=0.5, expand=10).collect()
    assert {r["group_id"] for r in g} == {0} and len(g) == 51


def test_copies_are_counted_by_key_and_table(spark):
    t = text()
    a = make(spark, [(i, t) for i in range(20) for _ in range(2)] + [(99, edited(t, 1))])
    got = {tuple(r)[:3] for r in N.near_pairs({"a": a, "b": make(spark, [(i, t) for i in range(20)])}, threshold=0.5, expand=25).collect()}
    every = {(i, j) for i in range(20) for j in range(i + 1, 20)}
    assert got == {(x, i, j) for x in "ab" for i, j in every} | {("a", i, 99) for i in range(20)}


def test_empty_table(spark):
    assert N.near_pairs({"a": make(spark, [])}).count() == 0
    assert N.near_groups({"a": make(spark, [(1, "a b c d e f")])}).count() == 0


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    a_w, b_w = rng.gamma(2, 1, 60), rng.gamma(2, 1, 60)
    a_w[40:] = 0
    b_w[:15] = 0
    b_w[20:35] = a_w[20:35]
    ids = np.sort(rng.integers(1, 1 << 54, 60).astype(np.uint64))
    keep = [np.flatnonzero(w > 0) for w in (a_w, b_w)]
    cat = np.concatenate([ids[keep[0]], ids[keep[1]]])
    lw = np.log(np.concatenate([a_w[keep[0]], b_w[keep[1]]]))
    s = N.Sampler(4000).samples(cat, lw, np.array([0, len(keep[0])]), np.array([len(k) for k in keep]))
    want = np.minimum(a_w, b_w).sum() / np.maximum(a_w, b_w).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_global_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(2)
    ids = np.sort(rng.integers(1, 1 << 54, 90).astype(np.uint64))
    level = rng.integers(0, 4, 90)
    weights = np.array([2.0, 3.0, 4.0, 6.0])  # far more apart than in use
    a, b = np.arange(0, 70), np.arange(20, 90)
    s = N.GlobalSampler(4000, weights).samples(np.concatenate([ids[a], ids[b]]), np.concatenate([level[a], level[b]]), np.array([0, 70]))
    w = weights[level]
    assert abs((s[0] == s[1]).mean() - w[20:70].sum() / w.sum()) < 0.03


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
