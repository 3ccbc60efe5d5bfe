import numpy as np

from sieveline.llm import text_statistics as T
from sieveline.llm.form_examples import EXAMPLES

COL = {n: i for i, n in enumerate(T.STATISTICS)}


def test_statistics_of_known_texts():
    s = T.statistics(["Một hai ba.\nBốn năm", "", None, "a1 !!", "x y\nx y\nx y"])
    assert s[0, COL["n_words"]] == 5 and abs(s[0, COL["stopped_lines"]] - 11 / 18) < 1e-9
    assert not s[1].any() and not s[2].any()
    assert abs(s[3, COL["digit_ratio"]] - 1 / 4) < 1e-9
    assert abs(s[4, COL["repeated_lines"]] - 2 / 3) < 1e-9


def test_the_model_tells_its_examples():
    shown = T.standardised(T.statistics([t for *_, t in EXAMPLES]))
    model = T.FormModel(shown.mean(0), np.maximum(shown.std(0), 0.02), EXAMPLES)
    model.mixture.fit(model.shown)
    model.named()
    got, p = model.forms(T.statistics([t for *_, t in EXAMPLES]))
    assert np.mean([T.FORMS[i] == f for i, (f, _, _) in zip(got, EXAMPLES)]) > 0.97 and (p > 0).all()


def test_mixture_likelihood_rises():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(5, 1, (300, 2))])
    m = T.Mixture(np.array([[1.0, 1.0], [4.0, 4.0]]))
    like = []
    for _ in range(6):
        lp = m.log_parts(x)
        like.append(np.logaddexp.reduce(lp, axis=1).sum())
        m.fit(x, rounds=1, pull=0.0)
    assert all(b >= a - 3 for a, b in zip(like, like[1:])) and np.abs(np.sort(m.mean[:, 0]) - [0, 5]).max() < 0.3


def test_sums_of_parts_add_up_to_a_round():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 2, 0.5]
    a, b = T.Mixture(x[:2]), T.Mixture(x[:2])
    parts = [a.sums(p)[0] for p in np.split(x, 4)]
    a.step(sum(parts), x[:2], 2.0)
    r = b.posterior(x)
    m = (r.T @ x + 2.0 * x[:2]) / (r.sum(0) + 2.0)[:, None]
    assert np.allclose(a.mean, m) and np.allclose(a.weight, (r.sum(0) + 0.5) / 201)
    y = x - m[0]
    assert np.allclose(a.cov[0], ((y.T * r[:, 0]) @ y + np.eye(3) * 0.12) / (r[:, 0].sum() + 4) + np.eye(3) * 0.03)


def test_training_sums_over_all_documents_however_they_lie(spark):
    texts = [t for *_, t in EXAMPLES] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = (T.train_forms(T.text_statistics(d), sample_rows=1000, rounds=2) for d in (df.repartition(1), df.repartition(7)))
    assert np.allclose(a.mid, T.standardised(T.statistics(texts)).mean(0)) and np.allclose(a.mixture.mean, b.mixture.mean, atol=1e-6)
    kept = {r["doc_id"]: r["form"] for r in T.forms(df.limit(5), model=a).collect()}
    assert len(kept) == 5


def test_forms_of_rows(spark):
    prose = "Bà H. ở thôn Mây mất tiền vì tin lời một người lạ. Người này nói tài khoản của bà có giao dịch lạ và yêu cầu đọc mã. "
    rows = [(i, prose * (1 + i % 3), "x") for i in range(30)]
    rows += [(50, "\n".join(f"- mục {i}" for i in range(12)), "x"), (51, "\n".join(f"a{i};b;{i}" for i in range(12)), "x"), (52, "🔥⭐😂❌" * 30, "x")]
    rows += [(60, None, "x"), (61, " \n", "x"), (0, prose, "x"), (53, prose * 400, "x"), (54, "\n".join(f"- mục số {i} của bảng" for i in range(4000)), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    got = {r["doc_id"]: r["form"] for r in T.forms(df).collect()}
    assert got[50] == "list" and got[51] == "table" and got[52] == "junk" and got[0] == "prose" and got[53] == "prose" and got[54] == "list"
    assert 60 not in got and 61 not in got and T.forms(df).count() == len(got)
    assert T.text_statistics(df).count() == 37
    assert T.forms(df.limit(0)).count() == 0
