import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import splitting as S


def check(text, limit, overlap):
    parts = S.split_text(text, limit, overlap)
    assert "".join(text[f:e] for _, f, e, _ in parts) == text
    assert all(e - s <= limit and s <= f and f - s <= overlap for s, f, e, _ in parts)
    assert all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
    longest = max((len(w) for w in text.split()), default=0)
    assert any(g == "forced" for *_, g in parts) == (longest > limit)
    return parts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(4, 60), st.integers(0, 3))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    check(text, limit, overlap)


def test_stronger_boundaries_are_taken():
    text = ("Một câu khá dài ở đây. " * 40 + "\n\n") * 6
    grades = {g for *_, g in check(text, 1000, 100)}
    assert grades <= {"paragraph", "sentence", "line", "end"} and "paragraph" in grades


def test_a_word_of_exactly_the_limit_is_not_forced():
    assert all(g != "forced" for *_, g in check("x " + "a" * 50 + " y " * 30, 50, 10))
    assert any(g == "forced" for *_, g in check("x " + "a" * 51 + " y " * 30, 50, 10))


def test_long_texts_are_cut_whole():
    check("a" * 100_000, 2048, 200)
    check(" " * 9000, 2048, 200)
    check("từ " * 60_000, 2048, 200)


def test_rows(spark):
    df = spark.createDataFrame(
        [(1, "a" * 3000, "x"), (1, "a" * 3000, "y"), (2, "từ " * 1000, "x"), (3, None, "x"), (4, "", "x"), (5, "short", "x")], "id long, content string, cut string"
    )
    assert {tuple(r) for r in S.oversized(df).collect()} == {(1, "forced"), (2, "natural")}
    got = S.split(df)
    assert {(r["id"], r["n_pieces"]) for r in got.filter("id > 2").collect()} == {(4, 1), (5, 1)}
    assert got.groupBy("id", "piece").count().filter("count > 1").count() == 0
    assert S.split(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.split(df, limit=10, overlap=10)
