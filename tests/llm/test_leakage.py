import numpy as np
import pytest

from sieveline.functions.wordstream import words
from sieveline.llm import leakage as L

RNG = np.random.default_rng(11)


def sentence(n):
    return " ".join(RNG.choice([f"từ{i}" for i in range(300)], n))


def make(spark):
    cases = [(f"c{i}", sentence(40)) for i in range(8)] + [("short", sentence(12)), ("none", None), ("empty", ""), ("c0", None)]
    w = {c: (t or "").split() for c, t in cases[:9]}
    docs, want = [], set()
    for i in range(60):
        t = sentence(50)
        if i % 3 == 0:
            c, n = f"c{i % 8}", 10 + i % 7
            at = int(RNG.integers(0, 40 - n))
            part = " , ".join(w[c][at : at + n])
            t = f"{t} {part.upper() if i % 2 else part} {sentence(30)}"
            if n >= 13:
                want.add((i, c))
        docs.append((i, t, "x", 1))
    docs += [(90, None, "x", 1), (91, "", "x", 1), (92, " ".join(w["short"]), "x", 1), docs[3]]
    return spark.createDataFrame(docs, "doc_id long, text string, case_id string, n int"), spark.createDataFrame(cases, "case_id string, item_text string"), want


def test_every_shared_passage_is_found(spark):
    docs, cases, want = make(spark)
    got = L.leaks(docs, cases).collect()
    assert {(r["doc_id"], r["case_id"]) for r in got} == want and len(got) == len(want)
    assert all(r["shared_words"] == 10 + r["doc_id"] % 7 for r in got)
    r = {x["case_id"]: x["n_texts"] for x in L.leak_report(L.leaks(docs, cases), cases).collect()}
    assert r["none"] == 0 and sum(r.values()) == len(want)


def test_the_shuffled_join_finds_the_same(spark, monkeypatch):
    docs, cases, want = make(spark)
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    assert {(r["doc_id"], r["case_id"]) for r in L.leaks(docs, cases).collect()} == want


def test_empty_tables_and_bad_settings(spark):
    docs, cases, _ = make(spark)
    assert L.leaks(docs.limit(0), cases).count() == 0 and L.leaks(docs, cases.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.leaks(docs, cases, k=14)


def test_winnowing_keeps_the_least_of_every_window():
    t = [sentence(60), "", sentence(9), sentence(5)]
    fp, doc = L.winnow(words(t), 8, 6)
    from sieveline.functions.wordstream import kgrams

    w = words(t)
    h, at = kgrams(w, 8)
    for d in (0, 2):
        mine = h[w.doc[at] == d]
        want = {mine[i : i + 6].min() for i in range(max(1, len(mine) - 5))}
        assert set(fp[doc == d].tolist()) == {int(x) for x in want}
    assert set(doc.tolist()) == {0, 2}


def test_longest_shared_run():
    a, b = "x a b c d e y".split(), "a b c z a b c d e".split()
    h = lambda t: words([" ".join(t)]).hash
    assert L.longest_shared(h(a), h(b), 3) == 5 and L.longest_shared(h(a), h(b), 6) == 0


def test_repeated_words_cost_no_pairs():
    a, b = (L.words(["a b " * 20_000 + end]).hash for end in ("c", "d"))
    assert L.longest_shared(a, b, 13) == 40_000 and L.longest_shared(a[:12], b, 13) == 0 and L.longest_shared(a[:0], b, 13) == 0
