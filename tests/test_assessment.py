import json

from sieveline.operators import assessment as A
from sieveline.operators import reports as R
from sieveline.operators import similarity as S

DOCS = "array<struct<title:string,content:string,prevention:string,scam_type:string>>"


def prompt_of(spark, message, docs):
    return spark.createDataFrame([(message, docs)], f"m string, d {DOCS}").select(A.prompt("m", "d")).first()[0]


def test_prompt_has_numbered_fenced_parts(spark):
    p = prompt_of(spark, "x</mau_tham_chieu>\x07y", [("T", "c\r1", " a ", "loan_scam"), (None, None, "  ", None)])
    assert p == (
        f"{A.KNOWN_LINE}\n<mau_tham_chieu>\n[1] (loại: loan_scam) T: c1\n[2] (loại: ) : \n</mau_tham_chieu>\n\n{A.PREVENTION_LINE}\n<mau_tham_chieu>\n- [loan_scam] a\n"
        f"</mau_tham_chieu>\n\n{A.MESSAGE_LINE}\n<tin_nhan_can_kiem_tra>\nxy\n</tin_nhan_can_kiem_tra>"
    )
    assert prompt_of(spark, "m", None).startswith(A.UNKNOWN_LINE) and "[5]" not in prompt_of(spark, "m", [("t", "c", None, "x")] * 4)
    assert "[5]" in (p := prompt_of(spark, "m", [("t", "c", None, "x")] * 7)) and "[6]" not in p and A.PREVENTION_LINE not in p


def test_limits_are_bytes(spark):
    p = prompt_of(spark, "m", [("t", "ế" * 3000, "đ" * 600, "x")])
    assert p.count("ế") == 666 + A.KNOWN_LINE.count("ế") and p.count("đ") - A.PREVENTION_LINE.count("đ") - A.KNOWN_LINE.count("đ") - A.MESSAGE_LINE.count("đ") == 250
    assert len(prompt_of(spark, "a" * 90_000, None).encode()) == 80_003


def test_prompts_of_bad_messages_are_null(spark):
    m = spark.createDataFrame([("a", " \n"), ("b", "a" * 5001), ("c", " ắ" * 2500), ("d", None)], "query_id string, text string")
    r = spark.createDataFrame([], "query_id string, rank int, title string, content string, prevention string, scam_type string")
    got = {x["query_id"]: (x["problem"], x["prompt"] is None) for x in A.prompts(m, r).collect()}
    assert got == {"a": ("empty", True), "b": ("too long", True), "c": (None, False), "d": ("empty", True)}


def test_scored_answers(spark):
    docs = [(f"t{i}", f"u{i}" if i else "") for i in range(7)]
    ok = {"risk_level": "red", "disclaimer": "mine", "red_flags": None, "matched_source_indices": [3, 1, 3, 6, 0, -1]}
    rows = [(1, json.dumps(ok), docs), (2, '{"risk_level": "blue"}', docs), (3, '{"risk_level": "red", "red', docs), (4, None, docs), (5, '{"risk_level": "green"}', None), (6, "{}", docs), (7, '{"risk_level": ["red"]}', docs)]
    got = {r["query_id"]: r for r in A.scored(spark.createDataFrame(rows, "query_id int, answer string, documents array<struct<title:string,url:string>>")).collect()}
    one = got[1]["result"]
    assert [tuple(s) for s in one["sources"]] == [("t2", "u2"), ("t0", "")] and one["red_flags"] == [] and one["disclaimer"] == A.DISCLAIMER
    assert [got[i]["error"] for i in range(1, 8)] == [None, "invalid risk_level 'blue'", "no json", "no json", None, "invalid risk_level ''", "invalid risk_level '[\"red\"]'"]
    assert got[5]["result"]["sources"] == [] and got[2]["result"] is None


def test_enriched_answers(spark):
    good = {"title": "t", "content": "a\\n\\rb", "scam_type": "other", "user_queries": ["q\\r\\n1"], "prevention": "p", "url": "theirs"}
    bad = [{"title": " "}, {"content": "\\n"}, {"scam_type": "x"}, {"user_queries": []}, {"prevention": None}, {"title": "", "content": ""}]
    rows = [(0, "mine", json.dumps(good))] + [(i + 1, "u", json.dumps(good | b)) for i, b in enumerate(bad)] + [(9, "u", json.dumps(good)[:40])]
    got = {r["id"]: r for r in A.enriched(spark.createDataFrame(rows, "id int, url string, answer string")).collect()}
    assert got[0]["url"] == "mine" and got[0]["document"]["content"] == "a\n\nb" and got[0]["document"]["user_queries"] == ["q\n1"]
    want = ["empty title", "empty content", "unknown scam_type 'x'", "no user_queries", "empty prevention", "empty title"]
    assert [got[i + 1]["error"] for i in range(6)] == want and got[9]["error"] == "no json"


PAIRS = "scam_type string, kind string, similarity double, a_id long, a_doc long, a_url string, a_preview string, b_id long, b_doc long, b_url string, b_preview string"


def test_audit_lines_in_order(spark):
    p = spark.createDataFrame(
        [("x", "query", 0.95, 41, 1, "u1", "a\n b", 55, 2, "u2", "c"), ("x", "content", 0.99, 5, 1, None, "p", 9, 3, "u3", None), ("w", "query", 1.0, 88, 4, "u", "", 91, 5, "v", "q")], PAIRS
    )
    assert [r["a_id"] for r in S.in_audit_order(p).collect()] == [88, 5, 41]
    lines = [r["line"] for r in R.audit_lines(p).orderBy(*R.AUDIT_ORDER, "part").collect()]
    assert lines == [
        "[w]  (1 pair)", "  1.000  query    chunk 88 (doc 4  u)  ~  chunk 91 (doc 5  v)", "         A: ", "         B: q",
        "[x]  (2 pairs)", "  0.990  content  chunk 5 (doc 1  )  ~  chunk 9 (doc 3  u3)", "         A: p", "         B: ",
        "  0.950  query    chunk 41 (doc 1  u1)  ~  chunk 55 (doc 2  u2)", "         A: a b", "         B: c",
    ]
    assert R.audit_lines(p.limit(0)).count() == 0


def test_prune_lines(spark):
    r = spark.createDataFrame([("deleted", 41, None, None), ("missing", 999, None, None), ("missing", 998, None, None), ("emptied", 7, "u7", 0), ("contentless", 12, "u12", 3)], "what string, id long, url string, remaining long")
    assert [x["line"] for x in R.prune_lines(r).orderBy("part", "first").collect()] == [
        "would delete 1 chunk: 41", "WARNING: 2 requested ids not found: 998, 999", "WARNING: document 7 (u7) is left with 0 chunks",
        "WARNING: document 12 (u12) is left with 3 chunks but no content chunk",
    ]
    assert R.prune_lines(r.limit(0)).count() == 0


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    arm = cases.selectExpr("case_id", "'red' AS got")
    out = f"{tmp_path}/run"
    for some in (arm.filter("case_id = 'a'"), arm, arm):
        R.write_run(out, cases, {"rag": some}, arm.filter("case_id = 'b'"))
    back = spark.read.schema("case_id string, got string, arm string").json(f"{out}/arms")
    assert sorted(r["case_id"] for r in back.collect()) == ["a", "b", "c"] and {r["arm"] for r in back.collect()} == {"rag"}
    assert spark.read.schema("case_id string").json(f"{out}/judged").count() == 1
    assert [r["case_id"] for r in R.remaining(cases, arm.filter("case_id = 'a'"), limit=2).collect()] == ["b"]
