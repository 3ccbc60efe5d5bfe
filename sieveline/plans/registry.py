"""Registered queries by name; each reads whole tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.functions import vector as V
from sieveline.operators import admission, assessment, chunking, corpus, evaluation, reports, retrieval, similarity
from sieveline.schemas import STYLES
from sieveline.session import stage

AUDIT_LEAST, BUDGET, PER_MINUTE, BURST, LISTED = 0.9, 40, 6, 10, 100


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark, sf) -> DataFrame:
    """Documents, each once, with the type in its canonical spelling."""
    return _table(spark, sf, "scam_documents").dropDuplicates(["id"]).withColumn("scam_type", T.label("scam_type"))


def _chunks(spark, sf) -> DataFrame:
    return _table(spark, sf, "chunks").dropDuplicates(["id"])


def _requests(spark, sf) -> DataFrame:
    return _table(spark, sf, "analyze_requests").dropDuplicates(["request_id"])


def _query_batch(spark, sf) -> DataFrame:
    """The stated query set of all searches: every user query whose id is divisible by 20, whole, with its own vector."""
    asked = _table(spark, sf, "chunks").filter("kind = 'query' AND id % 20 = 0").dropDuplicates(["id"])
    return asked.select(F.col("id").cast("string").alias("query_id"), F.col("content").alias("text"), "embedding", "document_id")


def _index(spark, sf) -> DataFrame:
    """All chunks, as they stand: the searches count rows repeated whole once themselves."""
    return _table(spark, sf, "chunks")


def list_chunks(spark, sf):
    return corpus.listed_chunks(_index(spark, sf), _documents(spark, sf), LISTED)


def url_exists(spark, sf):
    return corpus.known_urls(_table(spark, sf, "fetched_docs"), _table(spark, sf, "scam_documents"))


def url_missing(spark, sf):
    return corpus.new_urls(_table(spark, sf, "fetched_docs"), _table(spark, sf, "scam_documents"))


def host_allowed(spark, sf):
    """Fetched pages per host among the hosts that have a document."""
    hosts = _table(spark, sf, "scam_documents").select(T.host("url").alias("host")).distinct()
    pages = _table(spark, sf, "fetched_docs").dropDuplicates(["fetch_id"]).select(T.host("url").alias("host"))
    return pages.join(hosts, "host", "left_semi").groupBy("host").agg(F.count("*").alias("n_pages"))


def vector_topk(spark, sf):
    return retrieval.distance_score(retrieval.vector_arm(_query_batch(spark, sf), _index(spark, sf)))


def vector_docs(spark, sf):
    return retrieval.collapse(retrieval.vector_arm(_query_batch(spark, sf), _index(spark, sf)))


def keyword_topk(spark, sf):
    return retrieval.keyword_arm(_query_batch(spark, sf), _index(spark, sf))


def keyword_docs(spark, sf):
    return retrieval.collapse(retrieval.keyword_arm(_query_batch(spark, sf), _index(spark, sf)))


def hybrid_rrf(spark, sf):
    return retrieval.hybrid(_query_batch(spark, sf), _index(spark, sf), top_k=None).withColumn("score", F.round("score", 9))


def hybrid_batch(spark, sf):
    top = retrieval.hybrid(_query_batch(spark, sf), _index(spark, sf)).withColumn("score", F.round("score", 9))
    return retrieval.with_documents(top, _documents(spark, sf)).select("query_id", "rank", "document_id", "score", "title", "scam_type", "url")


def rerank_by_length(spark, sf):
    """The fused ranking reordered by a deterministic scorer, the length of the document's body."""
    ranked = retrieval.with_documents(retrieval.hybrid(_query_batch(spark, sf), _index(spark, sf), top_k=retrieval.RERANK_POOL), _documents(spark, sf))
    out = retrieval.rerank(ranked, F.coalesce(F.length("content"), F.lit(0)))
    return out.select("query_id", "rank", "document_id", "score")


def dup_audit(spark, sf):
    return similarity.in_audit_order(similarity.duplicate_audit(_chunks(spark, sf), _documents(spark, sf), least=AUDIT_LEAST))


def audit_report(spark, sf):
    """The audit as lines of text."""
    return reports.audit_lines(similarity.duplicate_audit(_chunks(spark, sf), _documents(spark, sf), least=AUDIT_LEAST)).withColumn("neg_similarity", F.round("neg_similarity", 6))


def prune_text(spark, sf):
    """The prune report as lines of text."""
    return reports.prune_lines(prune_report(spark, sf), block=50)


def dup_summary(spark, sf):
    return similarity.audit_summary(similarity.duplicate_audit(_chunks(spark, sf), _documents(spark, sf), least=AUDIT_LEAST))


def near_dup_fold(spark, sf):
    return similarity.greedy_kept(_chunks(spark, sf)).filter("NOT kept").select("id", "document_id")


def prune_report(spark, sf):
    """Deleting every content chunk whose document was answered with most, and ids that are not there."""
    c = _chunks(spark, sf)
    asked = _requests(spark, sf).filter("risk_level = 'red'").select(F.col("top_document_id").alias("document_id")).distinct()
    ids = c.filter("kind = 'content'").join(asked, "document_id", "left_semi").select("id")
    ids = ids.unionByName(_documents(spark, sf).select((-F.col("id")).alias("id")))
    return corpus.prune_report(_documents(spark, sf), c, ids)


def doc_remainder(spark, sf):
    return corpus.remainder(_documents(spark, sf), _chunks(spark, sf))


def score_clamp(spark, sf):
    """How alike a document's content chunk and its queries are, as a score."""
    c = _chunks(spark, sf).filter(V.usable("embedding"))
    a = c.filter("kind = 'content'").select("document_id", F.col("id").alias("content_id"), F.col("embedding").alias("ea"))
    b = c.filter("kind = 'query'").select("document_id", F.col("id").alias("query_chunk_id"), F.col("embedding").alias("eb"))
    d = 1 - V.cosine("ea", "eb")
    return a.join(b, "document_id").select("document_id", "content_id", "query_chunk_id", F.round(V.score(d), 6).alias("score"))


def _judged_cases(spark, sf) -> DataFrame:
    """Answered requests with the verdict that their document's type calls for."""
    d = _documents(spark, sf).select(F.col("id").alias("top_document_id"), "scam_type")
    r = _requests(spark, sf).filter("status = 200 AND risk_level IS NOT NULL").join(d, "top_document_id")
    scam = F.coalesce(F.col("scam_type") != "other", F.lit(False))
    return r.select("request_id", "scam_type", scam.alias("is_scam"), F.when(scam, "red").otherwise("green").alias("expected"), F.col("risk_level").alias("got"), "latency_ms", "message_chars")


def eval_recall_mrr(spark, sf):
    """Whether the fused ranking over all other chunks finds a held-out query's own document within five."""
    held = _index(spark, sf).filter("NOT coalesce(kind = 'query' AND id % 20 = 0, false)")
    ranked = retrieval.hybrid(_query_batch(spark, sf), held).select("query_id", "document_id", "rank")
    expected = _query_batch(spark, sf).select("query_id", F.col("document_id").alias("expected"))
    s = evaluation.summary(evaluation.judged(ranked, expected, item="document_id", k=5))
    return s.select("n", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def eval_confusion(spark, sf):
    return evaluation.confusion(_judged_cases(spark, sf))


def eval_rates(spark, sf):
    r = evaluation.rates(_judged_cases(spark, sf))
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "fpr", "fnr")])


def eval_by_type(spark, sf):
    r = evaluation.rates(_judged_cases(spark, sf).filter("is_scam"), ["scam_type"])
    return r.select("scam_type", "n", F.round("accuracy", 6).alias("accuracy"))


def eval_examples(spark, sf):
    return evaluation.extremes(_judged_cases(spark, sf).select("request_id", "latency_ms"), "latency_ms", "request_id")


def vote_resolution(spark, sf):
    """Two votes per answered request, by its risk and by the verdict its document calls for."""
    v = evaluation.votes(_judged_cases(spark, sf).withColumnsRenamed({"got": "first", "expected": "second"}))
    return v.groupBy("winner", "consistent").agg(F.count("*").alias("n"))


def report_assembly(spark, sf):
    """Every query with the best document of both arms, of their fusion and of the reranked fusion."""
    q, c = _query_batch(spark, sf), _index(spark, sf)
    vector, keyword = (stage(retrieval.collapse(arm(q, c))) for arm in (retrieval.vector_arm, retrieval.keyword_arm))
    fused = stage(retrieval.fuse(vector, keyword).filter(F.col("rank") <= retrieval.RERANK_POOL))
    reranked = retrieval.rerank(retrieval.with_documents(fused, _documents(spark, sf)), F.coalesce(F.length("content"), F.lit(0)))
    arms = {"vector": vector, "keyword": keyword, "fused": fused, "reranked": reranked}
    best = [(n, d.filter("rank = 1").select(F.col("query_id").alias("case_id"), F.col("document_id").alias("got"))) for n, d in arms.items()]
    return evaluation.assembled(q.select(F.col("query_id").alias("case_id"), F.col("document_id").alias("expected")), *best)


def status_tally(spark, sf):
    return evaluation.tally(_requests(spark, sf))


def infer_label(spark, sf):
    d = _documents(spark, sf)
    return d.select("id", T.infer_label("title", "content").alias("inferred"))


def label_agreement(spark, sf):
    d = _documents(spark, sf).withColumn("inferred", T.infer_label("title", "content"))
    return d.groupBy("scam_type").agg(F.count("*").alias("n"), F.count_if(F.col("inferred") == F.col("scam_type")).alias("n_same"))


def validate_content(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.content_problem("text").alias("problem"))


def slugify(spark, sf):
    return _table(spark, sf, "fetched_docs").dropDuplicates(["fetch_id"]).select("fetch_id", T.slug("url", "title").alias("slug"))


def fold_words(spark, sf):
    """The folded words of all corpus texts with the number of texts and of occurrences of each."""
    w = _table(spark, sf, "documents").select("doc_id", F.explode(T.tokens("text")).alias("word"))
    return w.groupBy("doc_id", "word").agg(F.count("*").alias("tf")).groupBy("word").agg(F.count("*").alias("n_texts"), F.sum("tf").alias("n"))


def fold_tokens(spark, sf):
    """Of ``fold_words`` the words of at least a hundred texts, as the SQL has them."""
    return fold_words(spark, sf).filter("n_texts >= 100")


def previews(spark, sf):
    return _chunks(spark, sf).select("id", T.preview("content", 80).alias("preview"))


def prompt_excerpt(spark, sf):
    """A digest of each corpus text as it goes into a prompt: sanitised and at most 500 bytes."""
    d = _table(spark, sf, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.substring(F.sha2(T.truncated_bytes(T.sanitised("text"), 500), 256), 1, 12).alias("digest"))


def citations(spark, sf):
    """For each source its five smallest document ids and those that the list of places 3, 1, 3, 7 and the number of documents cites."""
    d = _documents(spark, sf).filter("source IS NOT NULL").select("source", "id")
    five = evaluation.top_within(d, "source", ["id"], 5)
    lists = five.groupBy("source").agg(F.array_sort(F.collect_list("id")).alias("items"))
    places = F.array(F.lit(3), F.lit(1), F.lit(3), F.lit(7), F.size("items"))
    return evaluation.cited(lists.withColumn("indices", places)).select("source", F.transform("sources", lambda x: x.cast("string")).alias("s")).select("source", F.array_join("s", ",").alias("cited"))


def budget_daily(spark, sf):
    return admission.budget_by_day(_requests(spark, sf), BUDGET)


def budget_window(spark, sf):
    """Requests per local day as a tumbling window in UTC."""
    r = _requests(spark, sf).filter("received_at IS NOT NULL")
    return r.groupBy(F.window("received_at", "1 day", startTime="17 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day_start"), "n")


def token_bucket(spark, sf):
    """Refused requests per rate key."""
    b = admission.with_bucket(_requests(spark, sf), PER_MINUTE, BURST)
    return b.groupBy("rate_key").agg(F.count("*").alias("n"), F.count_if(~F.col("admitted")).alias("n_refused"))


def dataset_hash(spark, sf):
    return _documents(spark, sf).select("id", F.substring(F.sha2(F.coalesce("content", F.lit("")), 256), 1, 12).alias("hash"))


def chunk_text(spark, sf):
    return chunking.chunked(_documents(spark, sf)).select("id", "pos", "start", F.length("content").alias("n_chars"))


def corpus_parse(spark, sf):
    """Every document written in the four-section format with all its query chunks and read back, the queries in sections of bounded size."""
    q = _chunks(spark, sf).filter("kind = 'query'").select(F.col("document_id").alias("id"), F.col("id").alias("key"), F.regexp_replace("content", r"\s+", " ").alias("query"))
    read = corpus.parsed_sections(corpus.query_sections(corpus.numbered_queries(q)))
    n = read.groupBy("id").agg(F.sum(F.size("user_queries")).cast("int").alias("n"))
    d = _documents(spark, sf).withColumn("user_queries", F.lit(None).cast("array<string>"))
    back = corpus.parsed(corpus.serialised(d, reviewed=True)).join(n, "id", "left")
    n_queries = F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0)))
    return back.select("id", "reviewed", "error", n_queries.alias("n_queries"), F.length("document.content").alias("n_chars"))


def validate_queries(spark, sf):
    """Which corpus texts could not be searched for, as they are empty or too long."""
    return _table(spark, sf, "documents").select("doc_id", T.query_problem("text").alias("problem"), F.length(T.trimmed("text")).alias("n_chars"))


def prompt_build(spark, sf):
    """A digest and the size of the prompt about each query of the stated set, with its five best documents."""
    q = _query_batch(spark, sf)
    ranked = retrieval.with_documents(retrieval.hybrid(q, _index(spark, sf)), _documents(spark, sf))
    p = assessment.prompts(q, ranked)
    return p.select("query_id", "problem", F.octet_length("prompt").alias("n_bytes"), F.substring(F.sha2("prompt", 256), 1, 12).alias("digest"))


def _cited_documents(spark, sf) -> DataFrame:
    """(source, documents): title and URL of the eight documents of each source with the least ids."""
    d = _documents(spark, sf).filter("source IS NOT NULL").select("source", "id", "title", "url")
    few = evaluation.top_within(d, "source", ["id"], 8).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("id", "title", "url"))).alias("l"))
    return few.select("source", F.transform("l", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("documents"))


def scored_answers(spark, sf):
    """The logged verdict of every request written as a model's answer, some of them cut off, and checked as one."""
    r = _requests(spark, sf).join(_documents(spark, sf).select(F.col("id").alias("top_document_id"), "source"), "top_document_id", "left")
    m, late = F.col("message_chars"), F.coalesce("latency_ms", F.lit(0))
    flags = F.when(late % 3 != 0, F.array(F.col("rate_key"), F.lit("x")))
    answer = F.to_json(F.struct("risk_level", flags.alias("red_flags"), F.array(m % 7, F.lit(1), m % 7, m % 4).alias("matched_source_indices")))
    answer = F.when(late % 50 == 1, F.substring(answer, 1, 20)).otherwise(answer)
    rows = r.withColumn("answer", answer).join(_cited_documents(spark, sf), "source", "left")
    s = assessment.scored(rows, key="request_id")
    cited = F.array_join(F.transform("result.sources", lambda x: F.coalesce(x["url"], F.lit(""))), " ")
    return s.select("request_id", "error", "result.risk_level", F.size("result.red_flags").alias("n_flags"), F.size("result.recommended_actions").alias("n_actions"), cited.alias("cited"))


def enrich_check(spark, sf):
    """Every document written as a model would rewrite it, with escaped line breaks, and checked."""
    d = _documents(spark, sf)
    queries_ = F.when(F.col("id") % 9 != 0, F.array("title", "source"))
    content = F.replace("content", F.lit("\n"), F.lit("\\n"))
    answer = F.to_json(F.struct("title", content.alias("content"), "scam_type", queries_.alias("user_queries"), "prevention"))
    answer = F.when(F.col("id") % 31 == 0, F.substring(answer, 1, 30)).otherwise(answer)
    e = assessment.enriched(d.withColumn("answer", answer))
    return e.select("id", "error", F.length("document.content").alias("n_chars"), F.size("document.user_queries").alias("n_queries"))


def _judge_calls(spark, sf, *, shift: int = 0) -> DataFrame:
    """Two calls of a judge for every answered request in swapped order, told from the logged numbers."""
    r = _requests(spark, sf).filter("status = 200 AND latency_ms IS NOT NULL AND message_chars IS NOT NULL")
    slots = F.array(F.lit("A"), F.lit("B"), F.lit("tie"))
    one, two = (F.col("latency_ms") + shift) % 3, (F.col("message_chars") + shift) % 3
    call = lambda o, x: F.struct(F.lit(o).alias("order"), F.element_at(slots, (x + 1).cast("int")).alias("preferred"), (F.col("latency_ms") % 11).cast("double").alias("score_a"), (F.col("message_chars") % 11).cast("double").alias("score_b"))
    return r.select(F.col("request_id").alias("case_id"), F.explode(F.array(call(1, one), call(2, two))).alias("c")).select("case_id", "c.*")


def judge_resolution(spark, sf):
    return evaluation.resolved(_judge_calls(spark, sf), "rag", "web")


def judge_report(spark, sf):
    """Judged requests in figures; another judge has seen those whose id is divisible by ten."""
    crossed = evaluation.resolved(_judge_calls(spark, sf, shift=1), "rag", "web")
    s = evaluation.judge_summary(judge_resolution(spark, sf), crossed.filter("case_id % 10 = 0"), "rag", "web")
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


def run_summary(spark, sf):
    """The summary rows of a run over all judged requests."""
    c = _judged_cases(spark, sf).select(F.col("request_id").alias("case_id"), "scam_type", "expected", F.col("got").alias("got_first"))
    second = F.when(F.col("case_id").isNotNull() & (F.col("expected") == "red"), "yellow")
    c = c.withColumn("style", F.lit(None).cast("string")).withColumn("got_second", second)
    return evaluation.summary_rows(c.join(judge_resolution(spark, sf), "case_id", "left"))


def judge_texts(spark, sf):
    """What a judge reads about each evaluation case: its facts and, of both arms, the answers that are there."""
    c = _table(spark, sf, "benchmark_cases").dropDuplicates(["case_id"])
    shown = evaluation.answer_text("raw", "expected_verdict", **{"Dấu hiệu cảnh báo": "key_facts"})
    first = c.withColumn("raw", F.when(F.col("style") == "mixed", F.col("item_text"))).select("case_id", shown.alias("answer"))
    second = c.filter("is_scam").select("case_id", T.one_line("item_text").alias("answer"))
    j = evaluation.judge_input(c, first, second)
    return j.select("case_id", *[F.substring(F.sha2(x, 256), 1, 12).alias(x) for x in ("message", "facts", "first", "second")])


def case_specs(spark, sf):
    """The cases of a new dataset over the types that documents have, and four kinds of harmless messages."""
    strata = _documents(spark, sf).select(F.col("scam_type").alias("stratum"))
    return evaluation.specs(strata, 120, STYLES, benign=("sms_bank_real", "delivery_real", "promo_real", "work_real"))


def id_lists(spark, sf):
    """Lists of ids as they are typed in, read as numbers."""
    c = _chunks(spark, sf).filter("document_id IS NOT NULL")
    typed = F.concat_ws(" ,", F.col("id").cast("string"), F.lit(""), F.col("document_id").cast("string"), F.when(F.col("id") % 5 == 0, F.col("kind")), F.col("id").cast("string"))
    return c.select("id", T.joined_ids(T.id_list(typed)).alias("ids"))


def one_lines(spark, sf):
    """Chunks on one line."""
    return _chunks(spark, sf).select("id", T.one_line(T.preview("content", 120)).alias("line"))


def url_list(spark, sf):
    """The fetched URLs as lines of a list with comments and blanks, read back."""
    u = _table(spark, sf, "fetched_docs").dropDuplicates(["fetch_id"])
    line = F.when(F.col("fetch_id") % 5 == 0, F.concat(F.lit("# "), "url")).when(F.col("fetch_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" \t"), "url", F.lit(" ")))
    return corpus.url_lines(u.select(line.alias("value"))).groupBy("url").agg(F.count("*").alias("n"))


def ingest_chunks(spark, sf):
    """Chunks of the documents that are new where those of even id are there already, read from their four-section texts."""
    d = _documents(spark, sf)
    written = corpus.serialised(d.withColumn("user_queries", F.array("title", F.lit(" "), "source")), reviewed=True)
    read = corpus.parsed(written).filter("error IS NULL AND reviewed").select("document.*")
    docs, chunks = corpus.ingest(read, d.filter("id % 2 = 0"))
    return chunks.join(docs.select(F.col("id").alias("document_id"), "url"), "document_id").select("document_id", "url", "pos", "kind", F.length("embed_text").alias("n_embedded"))


def web_excerpt(spark, sf):
    """The size of fetched pages as they go into a prompt about a page."""
    p = _table(spark, sf, "fetched_docs").dropDuplicates(["fetch_id"]).filter("content IS NOT NULL")
    return p.select("fetch_id", F.length(T.sanitised("content", T.WEB_TAGS)).alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        list_chunks, url_exists, url_missing, host_allowed, vector_topk, vector_docs, keyword_topk, keyword_docs, hybrid_rrf, hybrid_batch,
        rerank_by_length, dup_audit, dup_summary, near_dup_fold, prune_report, doc_remainder, score_clamp, eval_recall_mrr, eval_confusion,
        eval_rates, eval_by_type, eval_examples, vote_resolution, report_assembly, status_tally, infer_label, label_agreement, validate_content,
        slugify, fold_words, fold_tokens, previews, prompt_excerpt, citations, budget_daily, budget_window, token_bucket, dataset_hash, chunk_text, corpus_parse,
        audit_report, prune_text, validate_queries, prompt_build, scored_answers, enrich_check, judge_resolution, judge_report, run_summary, judge_texts, case_specs,
        id_lists, one_lines, url_list, ingest_chunks, web_excerpt,
    ]
    return {f.__name__: f for f in own}
