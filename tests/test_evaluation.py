import pytest

from sieveline.operators import evaluation as E
from sieveline.schemas import SCAM_TYPES, STYLES


def test_recall_and_reciprocal_rank(spark):
    r = spark.createDataFrame([("a", 7, 1), ("a", 8, 2), ("b", 9, 3)], "query_id string, doc long, rank int")
    e = spark.createDataFrame([("a", 8), ("b", 9), ("c", 1), ("d", None)], "query_id string, expected long")
    got = {x["query_id"]: (x["hit"], x["reciprocal_rank"]) for x in E.judged(r, e, item="doc", k=2).collect()}
    assert got == {"a": (True, 0.5), "b": (False, 0.0), "c": (False, 0.0), "d": (False, 0.0)}
    s = E.summary(E.judged(r, e, item="doc")).first()
    assert (s["n"], s["recall"], s["mrr"]) == (4, 0.5, pytest.approx((0.5 + 1 / 3) / 4))


def test_summary_of_nothing_is_zero(spark):
    s = E.summary(spark.createDataFrame([], "hit boolean, reciprocal_rank double")).first()
    assert (s["n"], s["recall"], s["mrr"]) == (0, 0.0, 0.0)


CASES = "is_scam boolean, expected string, got string"


@pytest.mark.parametrize(
    "rows,fpr,fnr,accuracy",
    [
        ([(False, "green", "red"), (False, "green", "green")], 0.5, 0.0, 0.5),
        ([(True, "red", "green"), (True, "red", "red")], 0.0, 0.5, 0.5),
        ([(True, "red", "yellow"), (False, "green", "yellow")], 0.0, 0.0, 0.0),
        ([], 0.0, 0.0, 0.0),
    ],
)
def test_rates(spark, rows, fpr, fnr, accuracy):
    r = E.rates(spark.createDataFrame(rows, CASES)).first()
    assert (r["fpr"], r["fnr"], r["accuracy"]) == (fpr, fnr, accuracy)


def test_votes_need_both_orders(spark):
    v = spark.createDataFrame([("a", "a"), ("a", "b"), (None, None)], "first string, second string")
    assert [r["winner"] for r in E.votes(v).collect()] == ["a", "tie", "tie"]


def test_extremes_do_not_overlap(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(4)] + [(9, None)], "id long, v double")
    got = [(r["id"], r["end"]) for r in E.extremes(df, "v", "id").collect()]
    assert sorted(i for i, _ in got) == [0, 1, 2, 3] and [i for i, e in got if e == "best"] == [2, 1, 0]


def test_specs_spread_the_remainder_and_turn_styles(spark):
    s = E.specs(spark.createDataFrame([(t,) for t in SCAM_TYPES], "stratum string"), 120, STYLES).collect()
    n = {t: sum(r["stratum"] == t for r in s) for t in SCAM_TYPES}
    assert len(s) == 120 and [n[t] for t in sorted(n)] == [10] * 3 + [9] * 10
    assert [r["style"] for r in sorted(s, key=lambda r: (r["stratum"], r["i"]))] == [STYLES[i % 4] for i in range(120)]
    more = E.specs(spark.createDataFrame([("x",), ("x",), (None,)], "stratum string"), 3, STYLES, benign=("b", "a"), each_benign=2).collect()
    assert sorted((r["case_id"], r["style"]) for r in more) == sorted(zip(("scam-x-01", "scam-x-02", "scam-x-03", "benign-b-01", "benign-b-02", "benign-a-01", "benign-a-02"), (STYLES * 2)[:7]))
    assert E.specs(spark.createDataFrame([], "stratum string"), 3, STYLES).count() == 0


def test_slots_are_decoded_in_both_orders(spark):
    calls = [("a", 1, "A", 8.0, 5.0), ("a", 2, "B", 1.0, 1.0), ("b", 1, "A", 6.0, 6.0), ("b", 2, "A", 1.0, 1.0), ("c", 1, "x", 2.0, 4.0), ("c", 2, None, 0.0, 0.0), ("d", 1, "A", 9.0, 9.0)]
    r = E.resolved(spark.createDataFrame(calls, "case_id string, order int, preferred string, score_a double, score_b double"), "rag", "web")
    assert {x["case_id"]: (x["preferred"], x["order_consistent"], x["first_score"]) for x in r.collect()} == {"a": ("rag", True, 8.0), "b": ("tie", False, 6.0), "c": ("tie", True, 2.0)}
    cross = spark.createDataFrame([("a", "rag"), ("b", "web"), ("z", "rag")], "case_id string, preferred string")
    s = E.judge_summary(r, cross, "rag", "web").first()
    assert (s["n_judged"], s["first_wins"], s["second_wins"], s["ties"], s["n_crossed"]) == (3, 1, 0, 2, 3)
    assert s["first_mean"] == pytest.approx(16 / 3) and s["order_consistent_rate"] == pytest.approx(2 / 3) and s["cross_agreement_rate"] == pytest.approx(1 / 3)
    none = E.judge_summary(r.limit(0), cross.limit(0), "rag", "web").first()
    assert (none["n_judged"], none["first_mean"], none["cross_agreement_rate"]) == (0, 0.0, 0.0)


def test_judge_input_needs_both_arms(spark):
    c = spark.createDataFrame([("a", "m", ["f1", "f2"]), ("b", "m", None)], "case_id string, item_text string, key_facts array<string>")
    x, y = (spark.createDataFrame([(k, "t") for k in ks], "case_id string, answer string") for ks in ("ab", "bc"))
    assert [tuple(r) for r in E.judge_input(c, x, y).collect()] == [("b", "m", "(không có)", "t", "t")]
    assert E.judge_input(c, x, x).filter("case_id = 'a'").first()["facts"] == "- f1\n- f2\n"
    a = spark.createDataFrame([("", "red", ["f"], []), ("raw", "red", [], []), (None, None, None, None)], "raw string, verdict string, flags array<string>, acts array<string>")
    got = [r[0] for r in a.select(E.answer_text("raw", "verdict", Cờ="flags", Việc="acts")).collect()]
    assert got == ["Mức độ rủi ro: red\nCờ:\n- f\n", "raw", "Mức độ rủi ro: \n"]


def test_summary_rows_have_twelve_text_columns(spark):
    c = spark.createDataFrame([("a", None, "mixed", "red", "red", None, "rag", True, 7.0, None)], "case_id string, scam_type string, style string, expected string, got_first string, got_second string, preferred string, order_consistent boolean, first_score double, second_score double")
    assert tuple(E.summary_rows(c).first()) == ("a", "", "mixed", "red", "red", "", "true", "false", "7.00", "", "rag", "true")


def test_citations(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [3, 1]), (["a", "b", "c"], [5, 0, -1]), (["a"], [1, 1]), (["a"], None)], "items array<string>, indices array<int>")
    assert [r["sources"] for r in E.cited(df).collect()] == [["c", "a"], [], ["a"], []]


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "case_id string, n int")
    E.write_report(df, ["case_id"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/results")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out/summary")).columns == ["case_id"]


def test_assembled_keeps_cases_without_an_arm(spark):
    c = spark.createDataFrame([("a",), ("b",)], "case_id string")
    arm = spark.createDataFrame([("a", "red"), ("a", "red")], "case_id string, got string")
    assert {tuple(r) for r in E.assembled(c, ("x", arm)).collect()} == {("a", "red"), ("b", None)}
