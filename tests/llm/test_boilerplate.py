import itertools

import numpy as np

from sieveline.llm import boilerplate as B

BODY = [f"Nạn nhân ở xã {a} kể rằng nhóm lạ gọi điện lúc {i} giờ và đòi chuyển tiền ngay lập tức." for i, a in enumerate("Lam Mây Quế Sim Hà".split() * 4)]
MENU = "Trang chủ | Tin mới | Liên hệ"


def page(i, n=3):
    return "\n".join([MENU, "", *BODY[i : i + n], "Xem thêm: Cảnh báo giả", "© 2024 Trang. Giữ toàn quyền.", "Về đầu trang"])


def story(i):
    """A page whose body lines stand on no other page, though their wording does."""
    lines = [f"Nạn nhân ở xã {a} kể rằng nhóm lạ gọi điện ngày {i + 1}/{j}/2021 và đòi chuyển tiền ngay lập tức." for j, a in enumerate(("Lam", "Mây", "Quế"))]
    return "\n".join([MENU, "", *lines, "Xem thêm: Cảnh báo giả", "© 2024 Trang. Giữ toàn quyền.", "Về đầu trang"])


def tables(spark, pages):
    pages = [(i, f"https://a{i % 3}.example/{i}", *more) for i, *more in pages]
    p = spark.createDataFrame(pages, "fetch_id long, url string, content string, line_no string, k string")
    a = spark.createDataFrame([("\n".join(BODY), None, "Cảnh báo giả")] * 3, "content string, prevention string, title string")
    return p, a


def test_body_lines_of_unseen_pages(spark):
    pages = [(i, story(i), "x", "y") for i in range(40)] + [(0, story(0), "x", "y"), (90, None, "x", "y"), (91, " \n", "x", "y"), (92, MENU, "x", "y")]
    got = B.body_lines(*tables(spark, pages), least_pages=1).collect()
    assert {r["line_no"] for r in got if r["fetch_id"] == 7} == {3, 4, 5}
    assert not {90, 91, 92} & {r["fetch_id"] for r in got}
    assert len(got) == len({(r["fetch_id"], r["line_no"]) for r in got}) == 120


def test_empty_tables(spark):
    p, a = tables(spark, [(1, story(0), "x", "y")])
    assert B.body_lines(p.limit(0), a.limit(0)).count() == 0
    assert B.body_lines(p, a.limit(0), least_pages=1).count() == 0


def test_a_trained_field_is_passed_in(spark):
    p, a = tables(spark, [(i, story(i), "x", "y") for i in range(30)])
    field = B.train(p, a, least_pages=1)
    assert B.body_lines(p, a.limit(0), field=field).filter("fetch_id = 3").count() == 3


def test_labels_by_evidence(spark):
    text = "Theo tin báo ngày 3/12/2021, kẻ gian dựng trang a.example/7 để lừa tiền."
    other = "Giữ toàn quyền nội dung của trang, ghi rõ nguồn khi phát hành lại."
    p = spark.createDataFrame([("u1", f"{text}\n{other}\n“Tôi mất hết.”"), ("u2", f"{other}\nLời khuyên"), ("u2", f"{other}")], "url string, content string")
    b = B.blocks([p.first()["content"] + "\nLời khuyên"])
    triples = np.unique(B.kgrams(B.words(b.text, "lower"), 3)[0])
    cells = spark.createDataFrame([(text,), (text,), (None,), (other[:20],)], "text string")
    known = B.Evidence(B._held(cells, triples), B._held(cells.limit(0), triples), B._repeated(p, np.unique(B.line_hashes(b.text))))
    assert B.evidence_labels(b, known).tolist() == [1, 0, 1, 1] and b.shape[0, 13] == 0


def test_leaf_blocks_of_markup():
    html = "<html><body><nav><a href='x'>Menu</a></nav><div><p>Một <b>hai</b>.</p><ul><li>ba</li></ul></div><script>var x;</script></body></html>"
    got = B.leaf_blocks(html)
    assert [t for t, _ in got] == ["Menu", "Một hai.", "ba"]
    assert "nav" in got[0][1] and "p" in got[1][1] and "li" in got[2][1]
    b = B.blocks([html, None, "dòng\n\nhai"])
    assert b.page.tolist() == [0, 0, 0, 2, 2] and b.number.tolist() == [1, 2, 3, 1, 3]


def test_viterbi_is_the_best_of_all_labellings():
    b = B.blocks(["a b.\nc | d\ne f g h.\n1. x"])
    field = B.ChainField(np.sort(np.unique(b.word)))
    rng = np.random.default_rng(0)
    field.shape_w, field.word_w, field.move = rng.normal(size=field.shape_w.shape), rng.normal(size=field.word_w.shape), rng.normal(size=(2, 2))
    s = field._scores(b, *field._words(b))
    score = lambda y: sum(s[i, v] for i, v in enumerate(y)) + sum(field.move[a, c] for a, c in zip(y, y[1:]))
    assert tuple(field.decode(b)) == max(itertools.product((0, 1), repeat=4), key=score)


def test_training_separates_labels():
    b = B.blocks([page(i) for i in range(12)])
    label = np.array([t.startswith("Nạn nhân") for t in b.text]).astype(int)
    field = B.ChainField(np.unique(b.word)).fit(b, label)
    held = B.blocks([page(14, 2)])
    assert [t for t, y in zip(held.text, field.decode(held)) if y] == BODY[14:16]
