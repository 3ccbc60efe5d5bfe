"""Building and pruning the two-table corpus: documents and their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import trimmed
from sieveline.schemas import SCAM_TYPES
from sieveline.session import cut, once

#: The names of the sections.
_SECTIONS = ("General information", "Content", "User query", "Prevention")
_HEADER = r"(?U)\n(?=[\s&&[^\n]]*# [^\n]*\S)"


def listed_chunks(chunks: DataFrame, documents: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` chunks by id with their document's title, type and URL.

    The ids are found first, so that only their content is read, and none is shuffled.
    """
    d = documents.select(F.col("id").alias("document_id"), "title", "scam_type", "url")
    ids = chunks.select("id", "document_id").join(d.select("document_id"), "document_id", "left_semi").select("id").distinct().orderBy("id").limit(limit)
    few = chunks.select("id", "document_id", "kind", "content").join(F.broadcast(ids), "id", "left_semi").distinct()  # ``limit`` ids
    return few.join(d.distinct(), "document_id").orderBy("id")


def known_urls(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The different URLs of ``pages`` that a document has."""
    return pages.select("url").distinct().join(documents.select("url"), "url", "left_semi")


def new_urls(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The different URLs of ``pages`` that no document has; a null URL is none."""
    return pages.filter("url IS NOT NULL").select("url").distinct().join(documents.select("url"), "url", "left_anti")


def url_lines(lines: DataFrame) -> DataFrame:
    """Lines (value) of a list of URLs, trimmed, without blank ones and comments."""
    return lines.select(trimmed("value").alias("url")).filter("url <> '' AND NOT startswith(url, '#')")


def remainder(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, url, remaining, content_remaining) of every document, also of those without chunks."""
    d = documents.dropDuplicates(["id"]).select(F.col("id").alias("document_id"), "url")
    n = chunks.dropDuplicates(["id"]).groupBy("document_id").agg(F.count("*").alias("remaining"), F.count_if(F.col("kind") == "content").alias("content_remaining"))
    return d.join(n, "document_id", "left").na.fill(0, ["remaining", "content_remaining"])


def prune_report(documents: DataFrame, chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """What deleting the chunks ``ids`` (id) would do: rows (what, id, url, remaining).

    ``what`` is ``deleted`` or ``missing`` for a chunk id, ``emptied`` or ``contentless`` for a
    document that the deletion touches and leaves without chunks or without a content chunk.
    """
    wanted = ids.select("id").distinct()
    rows = chunks.dropDuplicates(["id"]).select("id", "document_id", "kind")
    gone = rows.join(wanted, "id", "left_semi")
    left = rows.join(wanted, "id", "left_anti")
    missing = wanted.join(rows, "id", "left_anti")
    touched = documents.join(gone.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi")
    state = remainder(touched, left).withColumn("what", F.when(F.col("remaining") == 0, "emptied").when(F.col("content_remaining") == 0, "contentless"))
    none = [F.lit(None).cast("string").alias("url"), F.lit(None).cast("long").alias("remaining")]
    return (
        gone.select(F.lit("deleted").alias("what"), "id", *none)
        .unionByName(missing.select(F.lit("missing").alias("what"), "id", *none))
        .unionByName(state.filter("what IS NOT NULL").select("what", F.col("document_id").alias("id"), "url", F.col("remaining").cast("long").alias("remaining")))
    )


def pruned(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks that are left after a deletion."""
    return chunks.join(ids.select("id"), "id", "left_anti")


def serialised(documents: DataFrame, *, reviewed: bool | None = None) -> DataFrame:
    """(id, text): documents with ``user_queries`` in the four-section format; ``reviewed`` adds the review line."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    numbered = F.transform(F.coalesce("user_queries", F.array().cast("array<string>")), lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q, F.lit("\n")))
    flag = "" if reviewed is None else f"reviewed: {str(reviewed).lower()}\n"
    text = F.concat(
        F.lit("# General information\nurl: "), c("url"), F.lit("\ntitle: "), c("title"), F.lit("\ntype: "), c("scam_type"), F.lit(f"\n{flag}# Content\n"),
        trimmed(c("content")), F.lit("\n# User query\n"), F.array_join(numbered, ""), F.lit("# Prevention\n"), trimmed(c("prevention")), F.lit("\n"),
    )
    return documents.select("id", text.alias("text"))


def numbered_queries(queries: DataFrame) -> DataFrame:
    """(id, number, query): queries (id, key, query) numbered within their document in order of key, not in one task; null ones are none."""
    q = with_ids(queries.filter("query IS NOT NULL").select(F.col("id").alias("of"), "key", "query"), ["of", "key"])
    first = q.groupBy("of").agg(F.min("id").alias("first"))
    return q.join(first, "of").select(F.col("of").alias("id"), (F.col("id") - F.col("first") + 1).alias("number"), "query")


def query_sections(queries: DataFrame, *, rows: int = 256) -> DataFrame:
    """(id, block, text): queries (id, number, query) as sections of at most ``rows`` lines each.

    Sections that are repeated add up, so a document's text and its sections after it are one
    document; no row holds all queries of one that has many.
    """
    line = F.concat(F.col("number").cast("string"), F.lit(". "), "query", F.lit("\n"))
    blocks = queries.groupBy("id", F.floor((F.col("number") - 1) / rows).alias("block")).agg(F.sort_array(F.collect_list(F.struct("number", line.alias("line")))).alias("lines"))
    return blocks.select("id", "block", F.concat(F.lit("# User query\n"), F.array_join("lines.line", "")).alias("text"))


def _sections(text: Column) -> Column:
    """A text cut before each of its header lines: (name, body) of every section, after an element with what stands before the first one."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\ufeff \t\r\n]+", "")
    parts = F.split(F.concat(F.lit("\n"), bare), _HEADER)

    def named(part: Column) -> Column:
        end = F.locate("\n", part)
        name = trimmed(F.substring(trimmed(F.substring_index(part, "\n", 1)), 3, 1_000_000))
        return F.struct(name.alias("name"), F.when(end > 0, part.substr(end + 1, F.length(part))).alias("body"))

    before = F.array(F.struct(F.lit(None).cast("string").alias("name"), parts[0].alias("body")))
    return F.concat(before, F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), named))


def _body(sections: Column, name: str) -> Column:
    """The lines of all sections of a name, one after the other; null if there is no such section."""
    own = F.filter(sections, lambda x: x["name"] == name)
    return F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda x: x["body"]), "\n"))


def _value(lines: Column, key: str) -> Column:
    """What stands after the colon of the last line ``key: value``, else empty."""
    own = F.filter(lines, lambda x: (F.locate(":", x) > 0) & (trimmed(F.substring_index(x, ":", 1)) == key))
    last = F.try_element_at(own, F.lit(-1))
    return F.coalesce(trimmed(last.substr(F.locate(":", last) + 1, F.length(last))), F.lit(""))


def _numbered_lines(body: Column) -> Column:
    """Lines that are not blank, without a number before them."""
    bare = F.transform(F.split(body, "\n"), lambda x: trimmed(F.regexp_replace(trimmed(x), r"^\d+[.)]", "")))
    return F.when(body.isNotNull(), F.filter(bare, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def parsed(texts: DataFrame, *, key: str = "id", text: str = "text") -> DataFrame:
    """(key, document, reviewed, error): texts of the four-section format; ``error`` says why a text is none, and ``document`` is null then.

    Sections come in any order and repeats add up. The first failing check names the error. A null text is
    an error, and a text that is malformed never fails the job. Everything is a column expression.
    """
    s = once(texts.select(key, _sections(F.col(text)).alias("s")), "s")
    s = s.select(key, "s", _body(F.col("s"), "General information").alias("general"))
    s = once(s.withColumn("lines", F.split(F.coalesce("general", F.lit("")), "\n")), "general", "lines")
    fields = {
        "url": _value(F.col("lines"), "url"), "title": _value(F.col("lines"), "title"), "scam_type": _value(F.col("lines"), "type"),
        "content": trimmed(F.coalesce(_body(F.col("s"), "Content"), F.lit(""))), "user_queries": _numbered_lines(_body(F.col("s"), "User query")),
        "prevention": trimmed(F.coalesce(_body(F.col("s"), "Prevention"), F.lit(""))),
    }
    d = once(s.withColumn("d", F.struct(*[c.alias(n) for n, c in fields.items()])), "d")
    strange = F.filter(F.transform("s", lambda x: x["name"]), lambda n: ~n.isin(*_SECTIONS))
    error = F.when(trimmed(F.col("s")[0]["body"]) != "", "text before the first section")
    error = error.when(F.size(strange) > 0, F.concat(F.lit("unknown section '"), F.try_element_at(strange, F.lit(1)), F.lit("'")))
    error = error.when(F.size("s") == 1, "no sections").when(F.col("general").isNull(), "no general information")
    for name in ("content", "url", "title", "scam_type"):
        error = error.when(F.col(f"d.{name}") == "", f"no {name}")
    error = error.when(~F.lower("d.url").rlike("^https?://"), "url is not http(s)")
    error = error.when(~F.col("d.scam_type").isin(*SCAM_TYPES), F.concat(F.lit("unknown type '"), F.col("d.scam_type"), F.lit("'")))
    d = once(d.withColumn("error", error), "error")
    fine = F.col("error").isNull()
    return d.select(key, F.when(fine, F.col("d")).alias("document"), (fine & (_value(F.col("lines"), "reviewed") == "true")).alias("reviewed"), "error")


def parsed_sections(sections: DataFrame) -> DataFrame:
    """(id, block, user_queries): sections of ``query_sections`` read back; a null or malformed text has null queries."""
    s = once(sections.select("id", "block", _sections(F.col("text")).alias("s")), "s")
    strange = F.exists("s", lambda x: ~x["name"].isin(*_SECTIONS))
    fine = (trimmed(F.col("s")[0]["body"]) == "") & (F.size("s") > 1) & ~F.coalesce(strange, F.lit(False))
    return s.select("id", "block", F.when(fine, _numbered_lines(_body(F.col("s"), "User query"))).alias("user_queries"))


def with_ids(rows: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """Rows with consecutive ``id`` from ``first`` in the given order, numbered by partition offsets, not in one task."""
    s = cut(rows.orderBy(*order).withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id()))
    counts = s.groupBy("p").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.col("m") - F.shiftleft(F.col("p").cast("long"), 33)
    return s.join(F.broadcast(offsets.select("p", "before")), "p").withColumn("id", F.col("before") + within + first).drop("p", "m", "before")


def ingest(reviewed: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new documents, their chunks) from parsed documents (url, title, ..., user_queries): known URLs are skipped before any
    further work, ids follow the greatest there is, and every document has one content chunk and one per query that is not blank."""
    top = documents.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = reviewed.join(documents.select("url"), "url", "left_anti").dropDuplicates(["url"])
    new = with_ids(fresh, ["url"], top + 1)
    pieces = F.concat(F.array(F.struct(F.lit("content").alias("kind"), F.col("content").alias("text"))), F.transform("user_queries", lambda q: F.struct(F.lit("query").alias("kind"), q.alias("text"))))
    chunks = new.select(F.col("id").alias("document_id"), "title", "scam_type", F.posexplode(pieces).alias("pos", "x")).filter(r"x.text rlike '\\S'")
    prefix = F.concat("title", F.lit(" (loại: "), "scam_type", F.lit(")\n"))
    return new.drop("user_queries"), chunks.select("document_id", "pos", "x.kind", F.col("x.text").alias("content"), F.concat(prefix, "x.text").alias("embed_text"))
