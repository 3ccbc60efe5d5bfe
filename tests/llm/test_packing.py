from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import packing as P


def best(sizes, cap):
    """The least number of containers, by trying all partitions of a few sizes."""
    if not sizes:
        return 0
    first, rest = sizes[0], sizes[1:]
    return min(
        1 + best([s for i, s in enumerate(rest) if i not in c], cap)
        for n in range(len(rest) + 1) for c in combinations(range(len(rest)), n) if first + sum(rest[i] for i in c) <= cap
    )


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=7))
def test_few_sizes_are_packed_at_best(sizes):
    got = P.complete(sizes, 20, max_steps=None)
    assert sorted(s for c in got for s in c) == sorted(sizes) and all(sum(c) <= 20 for c in got)
    assert len(got) == best(sizes, 20)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8), st.integers(0, 14), st.integers(0, 14))
def test_fillings_are_all_those_that_nothing_dominates(sizes, room, slack):
    left = sorted(sizes)
    sets = {tuple(sorted((left[i] for i in c), reverse=True)) for n in range(len(left) + 1) for c in combinations(range(len(left)), n)}
    fit = {f for f in sets if sum(f) <= room and room - sum(f) <= slack}

    def beaten(f):  # by one text outside in place of a part
        out = list(left)
        for s in f:
            out.remove(s)
        for n in range(len(f) + 1):
            for part in combinations(f, n):
                for x in out:
                    if sum(part) <= x <= sum(part) + room - sum(f) and (n > 1 or x > sum(part)):
                        return True
        return False

    assert sorted(P.fillings(left, room, slack)) == sorted(f for f in fit if not beaten(f))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 4096), max_size=300))
def test_many_sizes_are_whole_and_fit(sizes):
    got = P.complete(sizes, 4096, max_steps=5000)
    assert sorted(s for c in got for s in c) == sorted(sizes) and all(sum(c) <= 4096 for c in got)


def test_completion_beats_best_fit():
    sizes = [6, 6, 6, 5, 5, 5, 4, 4, 4, 5]  # 50 in containers of 10
    assert len(P.complete(sizes, 10)) == 5


def test_rows(spark):
    rows = [(1, "a" * 9000, 0), (2, "đ" * 100, 0), (3, "", 0), (4, None, 0), (5, "b" * 4095, 0), (2, "đ" * 100, 0)] + [(10 + i, "c" * (37 * i % 3000), 0) for i in range(200)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, piece int"), block_rows=64).collect()
    use, size = {}, {}
    for r in got:
        use[r["container"]] = use.get(r["container"], 0) + r["n_tokens"]
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["n_tokens"]
    assert max(use.values()) <= 4096 and size[1] == 9001 and size[2] == 201 and size[3] == 1 and 4 not in size and size[5] == 4096
    assert [r["n_tokens"] for r in sorted(got, key=lambda r: r["piece"]) if r["doc_id"] == 1] == [4096, 4096, 809]
    assert {r["doc_id"] for r in got if r["n_pieces"] > 1} == {1}


def test_blocks_tell_their_gap(spark):
    rows = [(i, "c" * (37 * i % 3000)) for i in range(300)]
    got = P.block_report(P.pack(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=100)).collect()
    assert len(got) == 3 and all(0 <= r["gap"] <= 1 for r in got) and sum(r["tokens"] for r in got) == sum(37 * i % 3000 + 1 for i in range(300))
    assert P.block_report(P.pack(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_report_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a" * 10)], "doc_id long, text string")
    r = P.packing_report(P.pack(df, capacity=22), 22).first()
    assert (r["containers"], r["tokens"], r["lower_bound"], r["room_left"]) == (1, 11, 1, 0.5)
    empty = P.pack(df.limit(0))
    assert empty.count() == 0 and P.packing_report(empty).first()["containers"] == 0
