"""SQL by query name that gives the same rows in another engine."""

from __future__ import annotations

from sieveline.functions.text import LABEL_KEYWORDS

# constants of its own, so that a wrong one in the library shows
AUDIT_LEAST, BUDGET, LISTED, PER_MINUTE, BURST = 0.9, 40, 100, 6, 10

_TYPES = "'ecommerce_scam','fake_job','impersonation_authority','impersonation_service','investment_fraud','loan_scam','other','package_delivery','prize_gift','recovery_scam','romance_scam','tech_fraud','vacation_contract'"


def _folded(c: str) -> str:
    return f"replace(strip_accents(lower({c})), 'đ', 'd')"


def _tokens(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({_folded(c)}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


_LABEL = "replace(replace(lower(trim(scam_type)), ' ', '_'), '-', '_')"
_BASE = f"""
    d AS (SELECT DISTINCT id, url, title, content, prevention, source, CASE WHEN {_LABEL} IN ({_TYPES}) THEN {_LABEL} END AS scam_type FROM scam_documents),
    c AS (SELECT DISTINCT id, document_id, kind, content, embedding FROM chunks),
    r AS (SELECT DISTINCT * FROM analyze_requests)"""
_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_ASKED = "coalesce(kind = 'query' AND id % 20 = 0, false)"


def _arms(corpus: str = "true") -> str:
    """Both arms of the stated query set over the chunks for which ``corpus`` holds, collapsed (vd, kd) and fused (f)."""
    return f"""{_BASE},
    q AS (SELECT id::VARCHAR AS query_id, content AS text, list_distinct({_tokens("content")}) AS words, document_id AS own FROM c WHERE {_ASKED}),
    qv AS (SELECT id::VARCHAR AS query_id, embedding::DOUBLE[] AS qe FROM c WHERE {_ASKED} AND {_USABLE}),
    k AS (SELECT * FROM c WHERE {corpus}),
    u AS (SELECT id, document_id, embedding::DOUBLE[] AS e FROM k WHERE {_USABLE}),
    va AS (
      SELECT query_id, id AS chunk_id, document_id, round(1 - list_cosine_similarity(qe, e), 6) + 0.0 AS distance,
        row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_cosine_similarity(qe, e), 6) + 0.0, id) AS rank
      FROM qv, u QUALIFY rank <= 80),
    qw AS (SELECT query_id, unnest(words) AS word FROM q),
    cw AS (SELECT id, document_id, word, count(*) AS tf FROM (SELECT id, document_id, unnest({_tokens("content")}) AS word FROM k) GROUP BY ALL),
    ka AS (
      SELECT query_id, id AS chunk_id, document_id, sum(tf)::BIGINT AS hits, row_number() OVER (PARTITION BY query_id ORDER BY sum(tf) DESC, id) AS rank
      FROM qw JOIN cw USING (word) GROUP BY query_id, id, document_id
      HAVING count(*) = (SELECT count(*) FROM qw x WHERE x.query_id = qw.query_id) QUALIFY rank <= 80),
    vd AS (
      SELECT query_id, chunk_id, document_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
      FROM (SELECT * FROM va QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) = 1)),
    kd AS (
      SELECT query_id, chunk_id, document_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
      FROM (SELECT * FROM ka QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) = 1)),
    f AS (
      SELECT query_id, document_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, document_id) AS rank
      FROM (SELECT query_id, document_id, rank FROM vd UNION ALL SELECT query_id, document_id, rank FROM kd) GROUP BY query_id, document_id),
    rr AS (
      SELECT query_id, document_id, coalesce(length(content), 0)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(length(content), 0) DESC, rank) AS rank
      FROM f JOIN d ON d.id = f.document_id WHERE f.rank <= 20 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(length(content), 0) DESC, f.rank) <= 5)"""


_ARMS = _arms()
_CASES = f"""{_BASE},
    j AS (
      SELECT request_id, d.scam_type, coalesce(d.scam_type <> 'other', false) AS is_scam,
        CASE WHEN coalesce(d.scam_type <> 'other', false) THEN 'red' ELSE 'green' END AS expected, risk_level AS got, latency_ms
      FROM r JOIN d ON d.id = r.top_document_id WHERE status = 200 AND risk_level IS NOT NULL)"""
_HOST = r"regexp_replace(lower(nullif(regexp_extract(url, '^https?://([^/?#:]+)', 1), '')), '^www\.', '')"
_AUDIT = f"""{_BASE},
    x AS (SELECT c.id, c.document_id, c.kind, left(c.content, 80) AS preview, c.embedding::DOUBLE[] AS e, d.url, d.scam_type FROM c JOIN d ON d.id = c.document_id
          WHERE d.scam_type IS NOT NULL AND kind IS NOT NULL AND {_USABLE.replace("embedding", "c.embedding")}),
    p AS (
      SELECT a.scam_type, a.kind, round(list_cosine_similarity(a.e, b.e), 6) AS similarity, a.id AS a_id, a.document_id AS a_doc, a.url AS a_url, a.preview AS a_preview,
        b.id AS b_id, b.document_id AS b_doc, b.url AS b_url, b.preview AS b_preview
      FROM x a JOIN x b ON a.kind = b.kind AND a.scam_type = b.scam_type AND a.id < b.id AND a.document_id <> b.document_id
      WHERE round(list_cosine_similarity(a.e, b.e), 6) >= {AUDIT_LEAST})"""
_LABELS = "CASE " + " ".join(f"WHEN regexp_matches(t, '{'|'.join(w)}') THEN '{n}'" for n, w in LABEL_KEYWORDS) + " ELSE 'other' END"
_SPACE = r"[\s\x0b\x{85}\p{Z}]"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '')"


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _cut(c: str, n: int) -> str:
    """At most n bytes of a text, whole characters, with dots where something is left out."""
    return f"CASE WHEN octet_length(encode({c})) <= {n} THEN {c} ELSE left({c}, list_max(list_filter(range({n // 4}, {n} + 1), lambda k: octet_length(encode(left({c}, k))) <= {n}))) || '...' END"


def _safe(c: str) -> str:
    out = rf"regexp_replace(coalesce({c}, ''), '[\x00-\x08\x0b-\x1f]', '', 'g')"
    for tag in ("<tin_nhan_can_kiem_tra>", "</tin_nhan_can_kiem_tra>", "<mau_tham_chieu>", "</mau_tham_chieu>", "<|im_start|>", "<|im_end|>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{tag}', '')"
    return out


_NEWLINE = "' || chr(10) || '"
_ONE_CALL = "CASE ({x}) % 3 WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' ELSE 'tie' END"
_SIMPLE = "regexp_replace(regexp_replace(regexp_replace(lower({}), '[^a-z0-9-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '^-|-$', '', 'g')"
_STEM = r"regexp_replace(regexp_extract(regexp_replace(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"


def _one_line(c: str) -> str:
    return _trim(f"regexp_replace({c}, '{_SPACE}+', ' ', 'g')")


# the end of the chunk at {start}: behind the last separator of the first kind that lies far enough, else at the size
_WINDOW = "substr(content, {start} + 1, 2048)"
_CHUNK_END = "CASE WHEN {start} + 2048 >= n THEN n ELSE {start} + coalesce(" + "".join(
    rf"(SELECT length(x) + {size} FROM (SELECT regexp_extract({_WINDOW}, '(?s)^(.*){sep}', 1) AS x) WHERE contains({_WINDOW}, {sql}) AND octet_length(encode(x)) >= 1024), "
    for size, sep, sql in ((2, r"\n\n", "chr(10) || chr(10)"), (1, r"\n", "chr(10)"), (2, r"\. ", "'. '"), (1, " ", "' '"))
) + "2048) END"


def _judged(shift: int = 0, name: str = "jr", base: bool = True) -> str:
    """Judge calls in two orders resolved, as ``name``; the first slot is the first arm's in order 1 and the second's in order 2."""
    one, two = _ONE_CALL.format(x=f"latency_ms + {shift}", a="rag", b="web"), _ONE_CALL.format(x=f"message_chars + {shift}", a="web", b="rag")
    out = f"""{name} AS (SELECT request_id AS case_id, CASE WHEN {one} = {two} THEN {one} ELSE 'tie' END AS preferred, {one} = {two} AS order_consistent,
        (latency_ms % 11)::DOUBLE AS first_score, (message_chars % 11)::DOUBLE AS second_score FROM r WHERE status = 200 AND latency_ms IS NOT NULL AND message_chars IS NOT NULL)"""
    return f"{_BASE}, {out}" if base else out


def oracle_sql() -> dict[str, str]:
    return {
        "list_chunks": f"WITH {_BASE} SELECT c.id, document_id, kind, c.content, title, scam_type, url FROM c JOIN d ON d.id = document_id ORDER BY c.id LIMIT {LISTED}",
        "url_exists": "SELECT DISTINCT url FROM fetched_docs WHERE url IN (SELECT url FROM scam_documents)",
        "url_missing": "SELECT DISTINCT url FROM fetched_docs f WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM scam_documents s WHERE s.url = f.url)",
        "host_allowed": f"""SELECT host, count(*) AS n_pages FROM (SELECT DISTINCT fetch_id, {_HOST} AS host FROM fetched_docs)
            WHERE host IN (SELECT {_HOST} FROM scam_documents) GROUP BY host""",
        "vector_topk": f"WITH {_ARMS} SELECT query_id, chunk_id, document_id, distance, rank, round(greatest(0.0, least(1.0, 1 - distance)), 6) + 0.0 AS score FROM va",
        "vector_docs": f"WITH {_ARMS} SELECT * FROM vd",
        "keyword_topk": f"WITH {_ARMS} SELECT * FROM ka",
        "keyword_docs": f"WITH {_ARMS} SELECT * FROM kd",
        "hybrid_rrf": f"WITH {_ARMS} SELECT * FROM f",
        "hybrid_batch": f"WITH {_ARMS} SELECT query_id, rank, document_id, score, d.title, d.scam_type, d.url FROM f JOIN d ON d.id = f.document_id WHERE rank <= 5",
        "rerank_by_length": f"WITH {_ARMS} SELECT * FROM rr",
        "dup_audit": f"WITH {_AUDIT} SELECT * FROM p",
        "dup_summary": f"""WITH {_AUDIT} SELECT scam_type, count(DISTINCT (a_id, b_id)) AS n_pairs, count(DISTINCT i) AS n_chunks
            FROM (SELECT *, unnest([a_id, b_id]) AS i FROM p) GROUP BY scam_type""",
        "prune_report": f"""WITH {_BASE},
            ids AS (SELECT id FROM c WHERE kind = 'content' AND document_id IN (SELECT top_document_id FROM r WHERE risk_level = 'red') UNION SELECT -id FROM d),
            s AS (SELECT d.id, d.url, count(k.id) AS remaining, count(k.id) FILTER (WHERE k.kind = 'content') AS contents
              FROM d LEFT JOIN (SELECT * FROM c WHERE id NOT IN (SELECT id FROM ids)) k ON k.document_id = d.id
              WHERE d.id IN (SELECT document_id FROM c WHERE id IN (SELECT id FROM ids)) GROUP BY d.id, d.url)
            SELECT 'deleted' AS what, id, NULL::VARCHAR AS url, NULL::BIGINT AS remaining FROM c WHERE id IN (SELECT id FROM ids)
            UNION ALL SELECT 'missing', id, NULL, NULL FROM ids WHERE id NOT IN (SELECT id FROM c)
            UNION ALL SELECT CASE WHEN remaining = 0 THEN 'emptied' ELSE 'contentless' END, id, url, remaining FROM s WHERE contents = 0""",
        "doc_remainder": f"""WITH {_BASE} SELECT d.id AS document_id, d.url, count(c.id) AS remaining, count(c.id) FILTER (WHERE c.kind = 'content') AS content_remaining
            FROM d LEFT JOIN c ON c.document_id = d.id GROUP BY d.id, d.url""",
        "score_clamp": f"""WITH {_BASE}, k AS (SELECT * FROM c WHERE {_USABLE})
            SELECT a.document_id, a.id AS content_id, b.id AS query_chunk_id,
              round(greatest(0.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) + 0.0 AS score
            FROM k a JOIN k b USING (document_id) WHERE a.kind = 'content' AND b.kind = 'query'""",
        "eval_recall_mrr": f"""WITH {_arms(f"NOT {_ASKED}")},
            h AS (SELECT q.query_id, min(f.rank) AS first FROM q LEFT JOIN f ON f.query_id = q.query_id AND f.rank <= 5 AND f.document_id = q.own GROUP BY q.query_id)
            SELECT count(*) AS n, round(coalesce(avg((first IS NOT NULL)::INT), 0), 6) AS recall, round(coalesce(avg(coalesce(1.0::DOUBLE / first, 0)), 0), 6) AS mrr FROM h""",
        "eval_confusion": f"WITH {_CASES} SELECT expected, got, count(*) AS n FROM j GROUP BY ALL",
        "eval_rates": f"""WITH {_CASES} SELECT count(*) AS n, round(coalesce(avg((expected = got)::INT), 0), 6) AS accuracy,
            round(coalesce(avg((got = 'red')::INT) FILTER (WHERE NOT is_scam), 0), 6) AS fpr, round(coalesce(avg((got = 'green')::INT) FILTER (WHERE is_scam), 0), 6) AS fnr FROM j""",
        "eval_by_type": f"WITH {_CASES} SELECT scam_type, count(*) AS n, round(avg((expected = got)::INT), 6) AS accuracy FROM j WHERE is_scam GROUP BY scam_type",
        "eval_examples": f"""WITH {_CASES},
            t AS (SELECT request_id, latency_ms FROM j WHERE latency_ms IS NOT NULL ORDER BY latency_ms DESC, request_id LIMIT 3)
            SELECT *, 'best' AS "end" FROM t UNION ALL
            (SELECT request_id, latency_ms, 'worst' FROM j WHERE latency_ms IS NOT NULL AND request_id NOT IN (SELECT request_id FROM t) ORDER BY latency_ms, request_id LIMIT 3)""",
        "vote_resolution": f"WITH {_CASES} SELECT CASE WHEN got = expected THEN got ELSE 'tie' END AS winner, got = expected AS consistent, count(*) AS n FROM j GROUP BY ALL",
        "report_assembly": f"""WITH {_ARMS} SELECT q.query_id AS case_id, own AS expected, a.document_id AS got_vector, b.document_id AS got_keyword, g.document_id AS got_fused, r.document_id AS got_reranked
            FROM q LEFT JOIN (SELECT * FROM vd WHERE rank = 1) a USING (query_id) LEFT JOIN (SELECT * FROM kd WHERE rank = 1) b USING (query_id)
            LEFT JOIN (SELECT * FROM f WHERE rank = 1) g USING (query_id) LEFT JOIN (SELECT * FROM rr WHERE rank = 1) r USING (query_id)""",
        "status_tally": f"WITH {_BASE} SELECT status, count(*) AS n FROM r GROUP BY status",
        "infer_label": f"WITH {_BASE}, l AS (SELECT id, lower(coalesce(title, '') || ' ' || coalesce(content, '')) AS t FROM d) SELECT id, {_LABELS} AS inferred FROM l",
        "label_agreement": f"""WITH {_BASE}, l AS (SELECT scam_type, lower(coalesce(title, '') || ' ' || coalesce(content, '')) AS t FROM d)
            SELECT scam_type, count(*) AS n, count(*) FILTER (WHERE {_LABELS} = scam_type) AS n_same FROM l GROUP BY scam_type""",
        "validate_content": rf"""SELECT doc_id, CASE WHEN octet_length(encode(coalesce(text, ''))) > 10485760 THEN 'too large' WHEN n = 0 THEN 'empty' WHEN n < 20 THEN 'too short'
            WHEN n > 500000 THEN 'too long' WHEN 2 * odd > length(text) THEN 'unreadable' END AS problem
            FROM (SELECT doc_id, text, len({_WORDS}) AS n, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}}\p{{Z}}\s\x0b\x{{85}}]', '', 'g')) AS odd
              FROM documents)""",
        "slugify": f"""SELECT DISTINCT fetch_id, coalesce(nullif({_SIMPLE.format(_STEM)}, ''), nullif({_SIMPLE.format("coalesce(title, '')")}, ''), 'document') || '-' ||
            left(sha1(coalesce(url, '')), 8) AS slug FROM fetched_docs""",
        "fold_words": f"SELECT word, count(DISTINCT doc_id) AS n_texts, count(*) AS n FROM (SELECT doc_id, unnest({_tokens('text')}) AS word FROM documents) GROUP BY word",
        "fold_tokens": f"""SELECT word, count(DISTINCT doc_id) AS n_texts, count(*) AS n FROM (SELECT doc_id, unnest({_tokens("text")}) AS word FROM documents)
            GROUP BY word HAVING count(DISTINCT doc_id) >= 100""",
        "previews": f"WITH {_BASE} SELECT id, left(content, 80) AS preview FROM c",
        "prompt_excerpt": f"SELECT doc_id, left(sha256({_cut('s', 500)}), 12) AS digest FROM (SELECT doc_id, {_safe('text')} AS s FROM documents WHERE text IS NOT NULL)",
        "citations": f"""WITH {_BASE}, l AS (SELECT source, list_sort(list(id))[1:5] AS items FROM d WHERE source IS NOT NULL GROUP BY source)
            SELECT source, CASE WHEN len(items) >= 3 THEN concat_ws(',', items[3], items[1], CASE WHEN len(items) > 3 THEN items[len(items)] END)
              WHEN len(items) = 2 THEN concat_ws(',', items[1], items[2]) ELSE items[1]::VARCHAR END AS cited FROM l""",
        "budget_daily": f"""WITH {_BASE} SELECT (received_at AT TIME ZONE 'UTC' + INTERVAL 7 HOUR)::DATE AS day, count(*) AS n_requests, least(count(*), {BUDGET}) AS n_admitted
            FROM r WHERE received_at IS NOT NULL GROUP BY day""",
        "budget_window": f"""WITH {_BASE} SELECT date_trunc('day', received_at AT TIME ZONE 'UTC' + INTERVAL 7 HOUR) - INTERVAL 7 HOUR AS day_start, count(*) AS n
            FROM r WHERE received_at IS NOT NULL GROUP BY day_start""",
        "dataset_hash": f"WITH {_BASE} SELECT id, left(sha256(coalesce(content, '')), 12) AS hash FROM d",
        "chunk_text": rf"""WITH RECURSIVE {_BASE},
            t AS (SELECT id, content, length(content) AS n FROM d WHERE content <> ''),
            g AS (
              SELECT id, content, n, 0 AS pos, 0 AS start, {_CHUNK_END.format(start="0")} AS stop FROM t UNION ALL
              SELECT id, content, n, pos + 1, s, {_CHUNK_END.format(start="s")} FROM (SELECT *, CASE WHEN stop - 200 > start THEN stop - 200 ELSE stop END AS s FROM g WHERE stop < n))
            SELECT id, pos, start, stop - start AS n_chars FROM g""",
        "corpus_parse": rf"""WITH {_BASE},
            m AS (SELECT document_id, count(*) AS n FROM c WHERE kind = 'query' AND regexp_matches(content, '[^\s\x0b\x{{85}}\p{{Z}}]') GROUP BY document_id),
            p AS (SELECT d.*, CASE WHEN {_trim("coalesce(content, '')")} = '' THEN 'no content' WHEN coalesce(url, '') = '' THEN 'no url' WHEN {_trim("coalesce(title, '')")} = '' THEN 'no title'
              WHEN scam_type IS NULL THEN 'no scam_type' END AS error FROM d)
            SELECT id, error IS NULL AS reviewed, error, CASE WHEN error IS NULL THEN coalesce(n, 0) END AS n_queries, CASE WHEN error IS NULL THEN length({_trim("content")}) END AS n_chars
            FROM p LEFT JOIN m ON m.document_id = p.id""",
        "token_bucket": f"""WITH RECURSIVE {_BASE},
            o AS (SELECT rate_key, epoch_us(received_at) AS us, row_number() OVER (PARTITION BY rate_key ORDER BY received_at, request_id) AS rn
              FROM r WHERE rate_key IS NOT NULL AND received_at IS NOT NULL),
            b AS (
              SELECT rate_key, us, rn, {BURST}.0::DOUBLE AS filled FROM o WHERE rn = 1 UNION ALL
              SELECT o.rate_key, o.us, o.rn, least({BURST}.0::DOUBLE, CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END + (o.us - b.us) / 1e6::DOUBLE * ({PER_MINUTE} / 60.0::DOUBLE))
              FROM b JOIN o ON o.rate_key = b.rate_key AND o.rn = b.rn + 1),
            x AS (SELECT rate_key, count(*) FILTER (WHERE filled < 1) AS n_refused FROM b GROUP BY rate_key)
            SELECT y.rate_key, y.n, coalesce(n_refused, 0) AS n_refused FROM (SELECT rate_key, count(*) AS n FROM r GROUP BY rate_key) y LEFT JOIN x USING (rate_key)""",
        "audit_report": f"""WITH {_AUDIT}, o AS (SELECT *, {_one_line("a_preview")} AS pa, {_one_line("b_preview")} AS pb FROM p),
            n AS (SELECT scam_type, count(*) AS n FROM p GROUP BY scam_type)
            SELECT scam_type, -similarity AS neg_similarity, a_id, b_id, 0 AS part, '  ' || printf('%.3f', similarity) || '  ' || rpad(kind, 7, ' ') || '  chunk ' || a_id || ' (doc ' || a_doc || '  ' || coalesce(a_url, '')
              || ')  ~  chunk ' || b_id || ' (doc ' || b_doc || '  ' || coalesce(b_url, '') || ')' AS line FROM o
            UNION ALL SELECT scam_type, -similarity, a_id, b_id, 1, '         A: ' || pa FROM o UNION ALL SELECT scam_type, -similarity, a_id, b_id, 2, '         B: ' || pb FROM o
            UNION ALL SELECT scam_type, -2.0, -1, -1, 0, '[' || scam_type || ']  (' || n || CASE WHEN n = 1 THEN ' pair)' ELSE ' pairs)' END FROM n""",
        "validate_queries": f"""SELECT doc_id, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n > 5000 THEN 'too long' END AS problem, n AS n_chars FROM (SELECT doc_id, length({_trim("text")}) AS n FROM documents)""",
        "prompt_build": f"""WITH {_ARMS},
            s AS (SELECT query_id, rank, prevention, '[' || rank || '] (loại: ' || {_safe("scam_type")} || ') ' || {_safe("title")} || ': ' || {_cut("body", 2000)} || chr(10) AS shown,
                '- [' || {_safe("scam_type")} || '] ' || {_cut("advice", 500)} || chr(10) AS advised
              FROM (SELECT f.query_id, f.rank, d.*, {_safe("content")} AS body, {_safe(_trim("prevention"))} AS advice FROM f JOIN d ON d.id = f.document_id WHERE f.rank <= 5)),
            l AS (SELECT query_id, string_agg(shown, '' ORDER BY rank) AS shown, string_agg(advised, '' ORDER BY rank) FILTER (WHERE {_trim("coalesce(prevention, '')")} <> '') AS advised FROM s GROUP BY query_id),
            p AS (SELECT query_id, CASE WHEN coalesce(length({_trim("text")}), 0) = 0 THEN 'empty' WHEN length({_trim("text")}) > 5000 THEN 'too long' END AS problem,
                coalesce('Các mẫu lừa đảo tương tự đã biết (dùng để tham chiếu):{_NEWLINE}<mau_tham_chieu>{_NEWLINE}' || shown || '</mau_tham_chieu>{_NEWLINE}'
                  || coalesce('{_NEWLINE}Biện pháp phòng tránh tham khảo:{_NEWLINE}<mau_tham_chieu>{_NEWLINE}' || advised || '</mau_tham_chieu>{_NEWLINE}', '') || chr(10),
                  '(Không tìm thấy mẫu lừa đảo tương tự trong kho dữ liệu. Hãy đánh giá dựa trên kiến thức chung về các chiêu trò lừa đảo phổ biến tại Việt Nam.){_NEWLINE}{_NEWLINE}')
                || 'Hãy phân tích tin nhắn sau:{_NEWLINE}<tin_nhan_can_kiem_tra>{_NEWLINE}' || {_safe(_trim("text"))} || '{_NEWLINE}</tin_nhan_can_kiem_tra>' AS prompt FROM q LEFT JOIN l USING (query_id))
            SELECT query_id, problem, CASE WHEN problem IS NULL THEN octet_length(encode(prompt)) END AS n_bytes, CASE WHEN problem IS NULL THEN left(sha256(prompt), 12) END AS digest FROM p""",
        "scored_answers": f"""WITH {_BASE},
            l AS (SELECT source, list(coalesce(url, '') ORDER BY id)[1:5] AS urls FROM d WHERE source IS NOT NULL GROUP BY source),
            a AS (SELECT request_id, risk_level, rate_key, message_chars AS m, coalesce(latency_ms, 0) AS late, coalesce(urls, []) AS urls FROM r LEFT JOIN d ON d.id = r.top_document_id LEFT JOIN l USING (source)),
            e AS (SELECT *, CASE WHEN late % 50 = 1 THEN 'no json' WHEN risk_level IS NULL OR risk_level NOT IN ('red', 'yellow', 'green') THEN 'invalid risk_level ' || chr(39) || coalesce(risk_level, '') || chr(39) END AS error FROM a)
            SELECT request_id, error, CASE WHEN error IS NULL THEN risk_level END AS risk_level, CASE WHEN error IS NULL THEN CASE WHEN late % 3 <> 0 THEN 2 ELSE 0 END END AS n_flags,
              CASE WHEN error IS NULL THEN 0 END AS n_actions,
              CASE WHEN error IS NULL THEN concat_ws(' ', CASE WHEN m % 7 BETWEEN 1 AND len(urls) THEN urls[m % 7] END, CASE WHEN m % 7 <> 1 AND len(urls) > 0 THEN urls[1] END,
                CASE WHEN m % 4 NOT IN (1, m % 7) AND m % 4 BETWEEN 1 AND len(urls) THEN urls[m % 4] END) END AS cited FROM e""",
        "enrich_check": f"""WITH {_BASE}, x AS (SELECT *, replace(replace(content, chr(10), '\n'), '\r\n', '\n') AS w FROM d),
            e AS (SELECT *, CASE WHEN id % 31 = 0 THEN 'no json' WHEN {_trim("coalesce(title, '')")} = '' THEN 'empty title' WHEN {_trim("coalesce(content, '')")} = '' THEN 'empty content'
              WHEN scam_type IS NULL THEN 'unknown scam_type ' || chr(39) || chr(39) WHEN id % 9 = 0 THEN 'no user_queries' WHEN {_trim("coalesce(prevention, '')")} = '' THEN 'empty prevention' END AS error FROM d)
            SELECT id, error, CASE WHEN error IS NULL THEN length(content) END AS n_chars, CASE WHEN error IS NULL THEN 2 END AS n_queries FROM e""",
        "judge_resolution": f"WITH {_judged()} SELECT case_id, preferred, order_consistent, first_score, second_score FROM jr",
        "judge_report": f"""WITH {_judged()}, {_judged(1, "kc", False)},
            x AS (SELECT jr.*, kc.preferred AS other FROM jr LEFT JOIN (SELECT * FROM kc WHERE case_id % 10 = 0) kc USING (case_id))
            SELECT count(*) AS n_judged, count(*) FILTER (WHERE preferred = 'rag') AS first_wins, count(*) FILTER (WHERE preferred = 'web') AS second_wins, count(*) FILTER (WHERE preferred = 'tie') AS ties,
              round(coalesce(avg(first_score), 0), 6) AS first_mean, round(coalesce(avg(second_score), 0), 6) AS second_mean, round(coalesce(avg(order_consistent::INT), 0), 6) AS order_consistent_rate,
              count(other) AS n_crossed, round(coalesce(avg((other = preferred)::INT), 0), 6) AS cross_agreement_rate FROM x""",
        "run_summary": f"""WITH {_CASES}, {_judged(base=False)}
            SELECT j.request_id AS case_id, coalesce(scam_type, '') AS scam_type, '' AS style, expected, got AS got_first, CASE WHEN expected = 'red' THEN 'yellow' ELSE '' END AS got_second,
              (got = expected)::VARCHAR AS first_correct, 'false' AS second_correct, coalesce(printf('%.2f', first_score), '') AS first_score, coalesce(printf('%.2f', second_score), '') AS second_score,
              coalesce(preferred, '') AS preferred, coalesce(order_consistent::VARCHAR, '') AS order_consistent FROM j LEFT JOIN jr ON jr.case_id = j.request_id""",
        "judge_texts": f"""WITH b AS (SELECT DISTINCT * FROM benchmark_cases),
            t AS (SELECT *, array_to_string(list_transform(coalesce(key_facts, []), lambda x: '- ' || x || chr(10)), '') AS l FROM b)
            SELECT case_id, left(sha256(item_text), 12) AS message, left(sha256(CASE WHEN l = '' THEN '(không có)' ELSE l END), 12) AS facts,
              left(sha256(CASE WHEN style = 'mixed' AND coalesce(item_text, '') <> '' THEN item_text ELSE 'Mức độ rủi ro: ' || coalesce(expected_verdict, '') || chr(10) || CASE WHEN l = '' THEN '' ELSE 'Dấu hiệu cảnh báo:' || chr(10) || l END END), 12) AS first,
              left(sha256({_one_line("item_text")}), 12) AS second FROM t WHERE is_scam""",
        "case_specs": f"""WITH {_BASE}, n AS (SELECT scam_type AS stratum, row_number() OVER (ORDER BY scam_type) - 1 AS place, count(*) OVER () AS m FROM (SELECT DISTINCT scam_type FROM d WHERE scam_type IS NOT NULL)),
            s AS (SELECT stratum, true AS is_scam, place, unnest(range(1, (120 // m + (place < 120 % m)::INT + 1)::BIGINT)) AS i FROM n UNION ALL
              SELECT x.stratum, false, 1000 + x.place, unnest(range(1, 11)) FROM (VALUES ('sms_bank_real', 0), ('delivery_real', 1), ('promo_real', 2), ('work_real', 3)) x(stratum, place))
            SELECT CASE WHEN is_scam THEN 'scam-' ELSE 'benign-' END || stratum || '-' || printf('%02d', i) AS case_id, stratum, is_scam, CASE WHEN is_scam THEN 'red' ELSE 'green' END AS expected, i::INT AS i,
              ['short_question', 'long_narration', 'verbatim_message', 'mixed'][((row_number() OVER (ORDER BY place, i) - 1) % 4 + 1)] AS style FROM s""",
        "id_lists": f"""WITH {_BASE} SELECT id, CASE WHEN id % 5 = 0 AND kind IS NOT NULL THEN '(none)' WHEN id = document_id THEN id::VARCHAR ELSE id || ', ' || document_id END AS ids FROM c WHERE document_id IS NOT NULL""",
        "one_lines": f"WITH {_BASE} SELECT id, {_one_line('left(content, 120)')} AS line FROM c",
        "url_list": """SELECT url, count(*) AS n FROM (SELECT DISTINCT fetch_id, url FROM fetched_docs) WHERE fetch_id % 5 <> 0 AND fetch_id % 7 <> 0 AND url IS NOT NULL GROUP BY url""",
        "ingest_chunks": f"""WITH {_BASE},
            p AS (SELECT * FROM d WHERE {_trim("coalesce(content, '')")} <> '' AND coalesce(url, '') <> '' AND {_trim("coalesce(title, '')")} <> '' AND scam_type IS NOT NULL
              AND url NOT IN (SELECT url FROM d WHERE id % 2 = 0 AND url IS NOT NULL)),
            n AS (SELECT *, (SELECT max(id) FROM d WHERE id % 2 = 0) + row_number() OVER (ORDER BY url) AS new_id FROM p)
            SELECT new_id AS document_id, url, i AS pos, CASE WHEN i = 0 THEN 'content' ELSE 'query' END AS kind,
              length({_trim("title")}) + 10 + length(scam_type) + length(CASE i WHEN 0 THEN {_trim("content")} WHEN 1 THEN {_trim("title")} ELSE {_trim("source")} END) AS n_embedded
            FROM n, (VALUES (0), (1), (2)) x(i) WHERE i < 2 OR {_trim("coalesce(source, '')")} <> ''""",
        "prune_text": f"""WITH {_BASE},
            ids AS (SELECT id FROM c WHERE kind = 'content' AND document_id IN (SELECT top_document_id FROM r WHERE risk_level = 'red') UNION SELECT -id FROM d),
            w AS (SELECT id, CASE WHEN id IN (SELECT id FROM c) THEN 'deleted' ELSE 'missing' END AS what FROM ids),
            b AS (SELECT what, id, (row_number() OVER (ORDER BY what, id) - 1) // 50 AS b FROM w),
            t AS (SELECT what, count(*) AS n, min(id) AS first, string_agg(id::VARCHAR, ', ' ORDER BY id) AS l FROM b GROUP BY what, b),
            s AS (SELECT d.id, d.url, count(k.id) AS remaining, count(k.id) FILTER (WHERE k.kind = 'content') AS contents
              FROM d LEFT JOIN (SELECT * FROM c WHERE id NOT IN (SELECT id FROM ids)) k ON k.document_id = d.id
              WHERE d.id IN (SELECT document_id FROM c WHERE id IN (SELECT id FROM ids)) GROUP BY d.id, d.url)
            SELECT CASE WHEN what = 'deleted' THEN 0 ELSE 1 END AS part, first, CASE WHEN what = 'deleted' THEN 'would delete ' || n || ' chunk' || CASE WHEN n = 1 THEN '' ELSE 's' END || ': ' || l
              ELSE 'WARNING: ' || n || ' requested id' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' not found: ' || l END AS line FROM t
            UNION ALL SELECT CASE WHEN remaining = 0 THEN 2 ELSE 3 END, id, 'WARNING: document ' || id || ' (' || coalesce(url, '') || ') is left with ' || CASE WHEN remaining = 0 THEN '0 chunks'
              ELSE remaining || ' chunk' || CASE WHEN remaining = 1 THEN '' ELSE 's' END || ' but no content chunk' END FROM s WHERE contents = 0""",
        "web_excerpt": rf"""SELECT fetch_id, length(replace(replace(replace(replace(replace(replace(regexp_replace(content, '[\x00-\x08\x0b-\x1f]', '', 'g'), '<noi_dung_trang_web>', ''), '</noi_dung_trang_web>', ''),
            '<|im_start|>', ''), '<|im_end|>', ''), '[INST]', ''), '[/INST]', '')) AS n_chars FROM (SELECT DISTINCT fetch_id, content FROM fetched_docs WHERE content IS NOT NULL)""",
    }
