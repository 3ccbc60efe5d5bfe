"""Article text from fetched HTML by per-host rules."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import host

MAX_CHARS = 5 * 1024 * 1024
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


def _matches(selector: str, tag: str, attrs: dict[str, str | None]) -> bool:
    """A simple selector: ``tag``, ``.class``, ``#id`` or ``tag.class``."""
    if selector.startswith("#"):
        return attrs.get("id") == selector[1:]
    name, _, cls = selector.partition(".")
    return (not name or name == tag) and (not cls or cls in (attrs.get("class") or "").split())


class _Article(HTMLParser):
    """Text of the first title element, the first h1, and of the paragraphs and all text of the first content element."""

    def __init__(self, title: str, content: str) -> None:
        super().__init__(convert_charrefs=True)
        self.want = {"title": title, "h1": "h1", "content": content}
        self.open: dict[str, int] = {}
        self.got: dict[str, list[str]] = {}
        self.path: list[str] = []
        self.paragraphs: list[list[str]] = []
        self.in_p = 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        self.path.append(tag)
        for name, selector in self.want.items():
            if name not in self.got and _matches(selector, tag, dict(attrs)):
                self.open[name], self.got[name] = len(self.path), []
        if tag == "p" and "content" in self.open:
            self.in_p = len(self.path)
            self.paragraphs.append([])

    def handle_endtag(self, tag):
        if tag not in self.path:
            return
        while self.path and self.path.pop() != tag:
            pass
        self.open = {k: d for k, d in self.open.items() if d <= len(self.path)}
        if len(self.path) < self.in_p:
            self.in_p = 0

    def handle_data(self, data):
        if {"script", "style"} & set(self.path):
            return
        for name in self.open:
            self.got[name].append(data)
        if self.in_p and "content" in self.open:
            self.paragraphs[-1].append(data)


def article(html: str, title: str, content: str) -> tuple[str, str]:
    """(title, body): the title falls back to the first h1; paragraphs are joined by a blank line, else all text of the content element."""
    p = _Article(title, content)
    p.feed(html[:MAX_CHARS])
    p.close()
    one = lambda parts: " ".join("".join(parts).split())
    name = one(p.got.get("title", [])) or one(p.got.get("h1", []))
    body = "\n\n".join(t for t in map(one, p.paragraphs) if t) or one(p.got.get("content", []))
    return name, body


def articles(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, title, content, source, error) of pages (url, html) whose host has a rule (host, source, title_sel, content_sel).

    Pages of other hosts are left out; a page without a body has an error instead.
    """
    rows = pages.withColumn("host", host("url")).join(F.broadcast(rules) if rules.count() <= 100_000 else rules, "host")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [article(h or "", t, c) for h, t, c in zip(*(b.column(i).to_pylist() for i in (1, 3, 4)))]
            errors = [None if body else "no content" for _, body in out]
            arrays = [b.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([c for _, c in out], pa.string()), b.column(2), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["url", "title", "content", "source", "error"])

    schema = "url string, title string, content string, source string, error string"
    return rows.select("url", "html", "source", "title_sel", "content_sel").mapInArrow(work, schema)
