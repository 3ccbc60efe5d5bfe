"""The deterministic half of judging a message: the prompt that a model gets, and the checking of what it answers.

All operators are column expressions over rows, one message a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import MESSAGE_FENCE, REFERENCE_FENCE, query_problem, sanitised, trimmed, truncated_bytes, unescaped_newlines
from sieveline.schemas import SCAM_TYPES, VERDICTS
from sieveline.session import once

#: What a model is shown at most, in documents and in UTF-8 bytes.
MOST_SHOWN, CONTENT_BYTES, PREVENTION_BYTES, PROMPT_BYTES = 5, 2_000, 500, 80_000
#: The lines of a prompt around its parts, and the notice under every result.
KNOWN_LINE = "Các mẫu lừa đảo tương tự đã biết (dùng để tham chiếu):"
PREVENTION_LINE = "Biện pháp phòng tránh tham khảo:"
UNKNOWN_LINE = "(Không tìm thấy mẫu lừa đảo tương tự trong kho dữ liệu. Hãy đánh giá dựa trên kiến thức chung về các chiêu trò lừa đảo phổ biến tại Việt Nam.)"
MESSAGE_LINE = "Hãy phân tích tin nhắn sau:"
DISCLAIMER = "Đây là công cụ tham khảo, không thay thế cho tư vấn pháp lý hay quyết định cuối cùng của bạn. Hãy luôn tự kiểm chứng qua các kênh chính thống."

#: What a model answers.
ANSWER = "risk_level string, red_flags array<string>, matched_patterns array<string>, recommended_actions array<string>, disclaimer string, matched_source_indices array<int>"
#: A document as a model rewrites it.
ENRICHED = "title string, content string, scam_type string, user_queries array<string>, prevention string"


def _fenced(body: Column, fence: tuple[str, str]) -> Column:
    return F.concat(F.lit(fence[0] + "\n"), body, F.lit(fence[1] + "\n"))


def _safe(c: Column) -> Column:
    return sanitised(F.coalesce(c, F.lit("")))


def prompt(message: Column | str, documents: Column | str) -> Column:
    """The prompt about ``message`` with the first MOST_SHOWN of ``documents``, best first.

    ``documents`` is an array of structs with title, content, prevention and scam_type. Each is
    shown as a numbered line with at most CONTENT_BYTES of content; a list of advice
    follows where there is any, at most PREVENTION_BYTES each; the whole has at most
    PROMPT_BYTES. Everything that comes from outside is sanitised, so no part can close its
    fence. Nulls count as empty; without documents a fixed line stands in their place.
    """
    shown = F.slice(F.coalesce(documents if isinstance(documents, Column) else F.col(documents), F.array()), 1, MOST_SHOWN)
    text = message if isinstance(message, Column) else F.col(message)
    lines = F.transform(
        shown,
        lambda d, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] (loại: "), _safe(d["scam_type"]), F.lit(") "), _safe(d["title"]), F.lit(": "),
            truncated_bytes(_safe(d["content"]), CONTENT_BYTES), F.lit("\n"),
        ),
    )
    advised = F.filter(shown, lambda d: trimmed(F.coalesce(d["prevention"], F.lit(""))) != "")
    advice = F.transform(
        advised, lambda d: F.concat(F.lit("- ["), _safe(d["scam_type"]), F.lit("] "), truncated_bytes(_safe(trimmed(d["prevention"])), PREVENTION_BYTES), F.lit("\n"))
    )
    known = F.concat(
        F.lit(KNOWN_LINE + "\n"), _fenced(F.array_join(lines, ""), REFERENCE_FENCE),
        F.when(F.size(advised) > 0, F.concat(F.lit("\n" + PREVENTION_LINE + "\n"), _fenced(F.array_join(advice, ""), REFERENCE_FENCE))).otherwise(""), F.lit("\n"),
    )
    asked = F.concat(F.lit(MESSAGE_LINE + "\n" + MESSAGE_FENCE[0] + "\n"), _safe(text), F.lit("\n" + MESSAGE_FENCE[1]))
    return truncated_bytes(F.concat(F.when(F.size(shown) > 0, known).otherwise(UNKNOWN_LINE + "\n\n"), asked), PROMPT_BYTES)


def prompts(messages: DataFrame, ranked: DataFrame, *, key: str = "query_id", text: str = "text") -> DataFrame:
    """(key, problem, prompt): for messages (key, text) and their ranked documents (key, rank, title, content, prevention, scam_type).

    Messages that are empty or too long have a ``problem`` and no prompt. A message without documents has one.
    """
    few = ranked.filter(F.col("rank") <= MOST_SHOWN).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "title", "content", "prevention", "scam_type"))).alias("documents")
    )
    m = messages.select(key, text, query_problem(text).alias("problem")).join(few, key, "left")
    return once(m.select(key, "problem", F.when(F.col("problem").isNull(), prompt(trimmed(text), "documents")).alias("prompt")), "prompt")


def _json(answer: str, schema: str) -> Column:
    """An answer read by its schema, with ``_bad`` set where it is no such JSON; missing fields are null."""
    return F.from_json(answer, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def scored(answers: DataFrame, *, key: str = "query_id", answer: str = "answer", documents: str = "documents") -> DataFrame:
    """(key, error, result): what models answered, checked.

    ``answers`` is (key, answer as JSON, documents as an array of (title, url), best first). ``error`` says why
    an answer does not count: no JSON of that shape, or a verdict outside the three. A result has the lists
    as arrays, empty where they are missing, the fixed disclaimer whatever the model wrote, and as ``sources``
    the documents that its 1-based indices name among the first MOST_SHOWN, each once, in order.
    """
    none = F.array().cast("array<string>")
    a = answers.select(key, _json(answer, ANSWER).alias("a"), F.slice(F.coalesce(documents, F.array()), 1, MOST_SHOWN).alias("shown"))
    error = F.when(F.col("a").isNull() | F.col("a._bad").isNotNull(), "no json").when(
        ~F.coalesce(F.col("a.risk_level").isin(*VERDICTS), F.lit(False)), F.concat(F.lit("invalid risk_level '"), F.coalesce("a.risk_level", F.lit("")), F.lit("'"))
    )
    a = once(a.withColumn("error", error), "a", "shown", "error")
    places = F.filter(F.array_distinct(F.coalesce("a.matched_source_indices", F.array().cast("array<int>"))), lambda i: (i >= 1) & (i <= F.size("shown")))
    result = F.struct(
        F.col("a.risk_level").alias("risk_level"),
        *[F.coalesce(f"a.{c}", none).alias(c) for c in ("red_flags", "matched_patterns", "recommended_actions")],
        F.lit(DISCLAIMER).alias("disclaimer"),
        F.transform(places, lambda i: F.element_at("shown", i)).alias("sources"),
    )
    return a.select(key, "error", F.when(F.col("error").isNull(), result).alias("result"))


def enriched(answers: DataFrame, *, key: str = "id", url: str = "url", answer: str = "answer") -> DataFrame:
    """(key, url, error, document): documents as a model rewrote them, checked; the first check that fails names the error.

    Line breaks written as escapes become line breaks. The URL is the input's, never the model's.
    """
    a = answers.select(key, F.col(url).alias("url"), _json(answer, ENRICHED).alias("a"))
    clean = F.struct(
        *[unescaped_newlines(F.coalesce(f"a.{c}", F.lit(""))).alias(c) for c in ("title", "content")], F.coalesce("a.scam_type", F.lit("")).alias("scam_type"),
        F.transform(F.coalesce("a.user_queries", F.array().cast("array<string>")), lambda q: unescaped_newlines(F.coalesce(q, F.lit("")))).alias("user_queries"),
        unescaped_newlines(F.coalesce("a.prevention", F.lit(""))).alias("prevention"),
    )
    a = once(a.select(key, "url", (F.col("a").isNull() | F.col("a._bad").isNotNull()).alias("bad"), clean.alias("d")), "bad", "d")
    error = (
        F.when(F.col("bad"), "no json")
        .when(trimmed("d.title") == "", "empty title")
        .when(trimmed("d.content") == "", "empty content")
        .when(~F.col("d.scam_type").isin(*SCAM_TYPES), F.concat(F.lit("unknown scam_type '"), F.col("d.scam_type"), F.lit("'")))
        .when(F.size("d.user_queries") == 0, "no user_queries")
        .when(trimmed("d.prevention") == "", "empty prevention")
    )
    a = once(a.withColumn("error", error), "error")
    return a.select(key, "url", "error", F.when(F.col("error").isNull(), F.col("d")).alias("document"))
