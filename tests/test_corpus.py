import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.operators import chunking, corpus
from sieveline.plans import registry

DOCS = "id long, url string, title string, content string, prevention string, scam_type string"
GOOD = "# General information\nurl: https://x.test/a\ntitle: T: x\ntype: loan_scam\n# Content\nbody\n\nmore\n# User query\n1. one?\n2) two?\n\n# Prevention\ncare\n"


def parse(spark, text):
    r = corpus.parsed(spark.createDataFrame([(1, text)], "id long, text string")).first()
    return {**r["document"].asDict(), "reviewed": r["reviewed"]} if r["error"] is None else r["error"]


def test_parsing_a_document(spark):
    d = parse(spark, "\ufeff \n" + GOOD)
    assert (d["url"], d["title"], d["scam_type"], d["content"]) == ("https://x.test/a", "T: x", "loan_scam", "body\n\nmore")
    assert d["user_queries"] == ["one?", "two?"] and d["prevention"] == "care" and not d["reviewed"]


def test_sections_in_any_order_and_repeated(spark):
    d = parse(spark, "# Prevention\np\n# Content\na\n# General information\nurl: http://x\ntitle: t\ntype: other\nreviewed: true\n# Content\nb\n")
    assert d["content"] == "a\nb" and d["reviewed"]


@pytest.mark.parametrize(
    "text",
    [
        "", "no header", "# Unknown\nx", GOOD.replace("loan_scam", "nope"), GOOD.replace("https://x.test/a", "javascript:x"), GOOD.replace("body\n\nmore", " "),
        GOOD.replace("T: x", ""), GOOD.replace("# General information", "# Content"), "text first\n" + GOOD, GOOD.replace("url: https://x.test/a", "url:"),
    ],
)
def test_malformed_documents_are_errors(spark, text):
    r = corpus.parsed(spark.createDataFrame([(1, text), (2, None), (3, GOOD)], "id long, text string")).orderBy("id").collect()
    assert r[0]["error"] and r[0]["document"] is None and r[1]["error"] and r[2]["error"] is None


def test_the_first_failing_check_names_the_error(spark):
    assert parse(spark, "x\n# Nope\n") == "text before the first section" and parse(spark, " \n# Nope\n# Content\n") == "unknown section 'Nope'"
    assert parse(spark, "# Content\nx") == "no general information" and parse(spark, "# General information") == "no content"
    assert parse(spark, "\u00a0# Content \nx\n\t# General information\n url : http://a \nurl:http://b\nno colon\ntitle:t\ntype:nope") == "unknown type 'nope'"
    d = parse(spark, "\u00a0# Content \n#x\n# \n\t# General information\n url : http://a \nurl:http://b\ntitle:t: u\ntype:other\n# User query\n12. a\n3)\n\n 4 b\n# Content\ny")
    assert (d["content"], d["url"], d["title"], d["user_queries"], d["prevention"]) == ("#x\n# \ny", "http://b", "t: u", ["a", "4 b"], "")


def test_round_trip(spark):
    d = spark.createDataFrame([(1, "https://x.test/a", "t", " body\nmore ", None, "other", ["q1", "q2"])], DOCS + ", user_queries array<string>")
    back = corpus.parsed(corpus.serialised(d, reviewed=True)).first()
    assert back["error"] is None and back["reviewed"] and back["document"]["content"] == "body\nmore" and back["document"]["user_queries"] == ["q1", "q2"]


def test_sections_of_queries_add_up_to_the_document(spark):
    q = spark.createDataFrame([(i % 2, i, f"q{i}" if i != 4 else None) for i in range(21)] + [(7, 99, " ")], "id long, key long, query string")
    sections = corpus.query_sections(corpus.numbered_queries(q), rows=4).orderBy("id", "block").collect()
    assert all(r["text"].count("\n") <= 5 for r in sections)
    d = parse(spark, GOOD.replace("1. one?\n2) two?\n", "") + "".join(r["text"] for r in sections if r["id"] == 0))
    assert d["user_queries"] == [f"q{i}" for i in range(0, 21, 2) if i != 4]
    read = corpus.parsed_sections(spark.createDataFrame(sections)).orderBy("id", "block").collect()
    assert [x for r in read if r["id"] == 1 for x in r["user_queries"]] == [f"q{i}" for i in range(1, 21, 2)] and read[-1]["user_queries"] == []


def test_every_query_of_a_document_with_many_is_written_and_read(spark, tmp_path):
    d = spark.createDataFrame([(1, "https://x.test/a", "t", "body", None, "other"), (2, "https://x.test/b", "t", "body", None, "other"), (3, None, "t", "body", None, "other")], DOCS)
    c = [(i, 1, "query", f"q {i}\n?") for i in range(700)] + [(800, 2, "content", "body"), (801, 3, "query", "q"), (0, 1, "query", "q 0\n?")]
    d.write.parquet(f"{tmp_path}/scam_documents.parquet")
    spark.createDataFrame(c, "id long, document_id long, kind string, content string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["id"]: (r["n_queries"], r["error"]) for r in registry.corpus_parse(spark, str(tmp_path)).collect()}
    assert got == {1: (700, None), 2: (0, None), 3: (None, "no url")}


def test_prune_report(spark):
    d = spark.createDataFrame([(7, "u7"), (12, "u12"), (9, "u9")], "id long, url string")
    c = spark.createDataFrame([(41, 7, "query"), (50, 12, "content"), (51, 12, "query"), (52, 12, "query"), (60, 9, "content"), (60, 9, "content")], "id long, document_id long, kind string")
    ids = spark.createDataFrame([(41,), (50,), (999,), (41,)], "id long")
    got = {(r["what"], r["id"], r["remaining"]) for r in corpus.prune_report(d, c, ids).collect()}
    assert got == {("deleted", 41, None), ("deleted", 50, None), ("missing", 999, None), ("emptied", 7, 0), ("contentless", 12, 2)}
    assert {r["id"] for r in corpus.pruned(c, ids).collect()} == {51, 52, 60}


def test_ingest_skips_known_urls_and_blank_queries(spark):
    known = spark.createDataFrame([(5, "https://x.test/old")], "id long, url string")
    new = spark.createDataFrame(
        [("https://x.test/old", "t", "other", "c", ["q"]), ("https://x.test/b", "t2", "loan_scam", "long body", ["q1", " ", "q2"]), ("https://x.test/a", "t3", "other", "body", [])],
        "url string, title string, scam_type string, content string, user_queries array<string>",
    )
    docs, chunks = corpus.ingest(new, known)
    assert {(r["id"], r["url"]) for r in docs.collect()} == {(6, "https://x.test/a"), (7, "https://x.test/b")}
    got = [(r["document_id"], r["kind"], r["content"]) for r in chunks.orderBy("document_id", "pos").collect()]
    assert got == [(6, "content", "body"), (7, "content", "long body"), (7, "query", "q1"), (7, "query", "q2")]
    assert chunks.filter("document_id = 7 AND kind = 'content'").first()["embed_text"] == "t2 (loại: loan_scam)\nlong body"


def test_url_lists(spark):
    lines = spark.createDataFrame([("  https://a ",), ("# no",), ("",), ("https://a",)], "value string")
    assert [r["url"] for r in corpus.url_lines(lines).collect()] == ["https://a", "https://a"]
    pages = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "url string")
    docs = spark.createDataFrame([("a",), (None,)], "url string")
    assert [r["url"] for r in corpus.known_urls(pages, docs).collect()] == ["a"] and [r["url"] for r in corpus.new_urls(pages, docs).collect()] == ["b"]


def test_short_texts_are_one_chunk_and_long_ones_overlap():
    assert chunking.cut_points("short", 2048, 200) == [(0, 5)] and chunking.cut_points("", 10, 2) == []
    text = "Câu này dài vừa đủ. " * 200
    cuts = chunking.cut_points(text, 300, 50)
    assert all(e - s <= 300 for s, e in cuts) and cuts[-1][1] == len(text) and all(b[0] == a[1] - 50 for a, b in zip(cuts, cuts[1:]))
    assert len(chunking.cut_points("a" * 5000)) == 3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aă .\n", max_size=400), st.integers(-1, 40), st.integers(-5, 60))
def test_chunks_cover_the_text(text, size, overlap):
    cuts = chunking.cut_points(text, size, overlap)
    assert "".join(text[max(s, p):e] for (s, e), p in zip(cuts, [0, *(e for _, e in cuts)])) == text


def test_chunked_rows(spark):
    df = spark.createDataFrame([(1, "x" * 3000), (2, None), (3, "")], "id long, content string")
    assert [(r["id"], r["pos"], len(r["content"])) for r in chunking.chunked(df).orderBy("pos").collect()] == [(1, 0, 2048), (1, 1, 1152)]
