"""The main body of pages among menus, notices, share bars, lists of other articles and footers.

A page is a sequence of leaf blocks: the lines of an extracted page, or the leaf text
blocks of markup with the tags above them. Each block is described by its ancestor tags
(for plain lines those that their marks stand for: list items, quotes, navigation), its
place, length, punctuation, digits, capitals, repetition within the page and its words.
A linear-chain conditional random field with the labels body and rest is trained by
maximum likelihood on labelled pages and decoded by Viterbi for each page.

Labelled pages are a bounded sample: ``train_pages`` pages with the least hash among those
of at most ``train_chars`` code points. Their lines are labelled by evidence from all
tables. Word triples of the sampled lines are looked up in every article and title, and
the lines themselves in every page. Body is a finished line whose triples stand in
articles, more than in titles and far more than in site furniture, which are the lines
that stand alike under several URLs; a finished line in quotes is body too. Evidence
cannot tell a subheading that many pages share from an inserted label that many pages
share, so the few such lines (BODY_LINES) were labelled by hand. Labels only train the
field; pages are decoded by it, and its features say nothing about articles.

Nulls and edge cases: a null or blank page has no lines; blank lines are never body but
are counted in line numbers; rows repeated whole count once; pages and lines of any
length are read whole; if there is no article to learn from, no line is body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.wordstream import kgrams, mix64, words
from sieveline.llm._batches import hashed_sample, pieces, signed

#: Labelled by hand: subheadings and closing notes that many pages share, lower case.
BODY_LINES = (
    "diễn biến vụ việc", "dấu hiệu nhận biết", "lời khuyên", "cách xử lý", "vì sao nhiều người mắc bẫy", "what happened", "what to do",
    "signs to look for", "how to spot it", "advice", "why people fall for it", "how it works",
    "người dân phát hiện dấu hiệu tương tự cần báo ngay cho công an nơi gần nhất.",
    "mọi thông tin cá nhân của nạn nhân trong bài đã được thay đổi.",
    "không có cơ quan nào làm việc với người dân chỉ qua điện thoại.",
    "anyone who sees the same signs should tell the local police at once.", "names in this story were changed.",
    "no office works with the public by phone alone.",
)
TAGS = ("p", "li", "h", "blockquote", "nav", "footer", "aside", "a", "td", "form")
_MARKUP = re.compile(r"<(?:html|body|div|p|ul|article|table)[\s>]", re.IGNORECASE)
_ENDED = re.compile(r"(?<!\.)[.!?][\"”’»)]*$")
_TRIPLE = 3
_WIDTH = 34  # columns of ``shape``


class _Leaves(HTMLParser):
    """Leaf text blocks of markup with the set of tags above each."""

    _VOID = frozenset(("br", "img", "hr", "input", "meta", "link", "wbr", "source"))
    _INLINE = frozenset(("b", "i", "em", "strong", "span", "a", "u", "small", "sub", "sup", "font", "mark"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[str] = []
        self.text: list[str] = []
        self.tags: set[str] = set()
        self.blocks: list[tuple[str, frozenset[str]]] = []

    def end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((text, frozenset(self.tags)))
        self.text, self.tags = [], set()

    def handle_starttag(self, tag, attrs):
        if tag not in self._INLINE:
            self.end_block()
        if tag not in self._VOID:
            self.path.append(tag)

    def handle_endtag(self, tag):
        if tag not in self._INLINE:
            self.end_block()
        if tag in self.path:
            while self.path.pop() != tag:
                pass

    def handle_data(self, data):
        if not {"script", "style", "head"} & set(self.path):
            self.text.append(data)
            self.tags |= set(self.path)


def leaf_blocks(page: str) -> list[tuple[str, frozenset[str]]]:
    """The blocks of a page: leaves of markup, else its lines, blank ones too."""
    if _MARKUP.search(page):
        p = _Leaves()
        p.feed(page)
        p.close()
        p.end_block()
        return p.blocks
    return [(line, frozenset()) for line in page.split("\n")]


@dataclass
class Blocks:
    """The non-blank blocks of a batch: page and number (from 1) of each, its text, features and word hashes."""

    page: np.ndarray
    number: np.ndarray
    text: list[str]
    shape: np.ndarray
    word: np.ndarray
    word_of: np.ndarray


_SEPARATORS = np.array([ord(c) for c in "|·›»•≡"], np.uint32)
_KIND = np.zeros(0x3100, np.uint8)  # 1 digit, 2 upper, 3 lower or other letter
for _c in range(0x3100):
    _ch = chr(_c)
    _KIND[_c] = 1 if _ch.isdigit() else 2 if _ch.isupper() else 3 if _ch.isalpha() else 0


def _apart(codes: np.ndarray, mark: int) -> np.ndarray:
    """Where ``mark`` stands with blanks on both sides."""
    out = np.zeros(len(codes), bool)
    out[1:-1] = (codes[1:-1] == mark) & (codes[:-2] == 32) & (codes[2:] == 32)
    return out


def blocks(pages: list[str | None]) -> Blocks:
    """Features of all non-blank blocks of a batch of pages."""
    text: list[str] = []
    page, number, tagged = [], [], []
    for i, p in enumerate(pages):
        if not p:
            continue
        for n, (t, tags) in enumerate(leaf_blocks(p), 1):
            if t := t.strip():
                if tags:
                    tagged.append((len(text), tags))
                text.append(t)
                page.append(i)
                number.append(n)
    pg, no = np.array(page, np.int64), np.array(number, np.int64)
    m = len(text)
    shape = np.zeros((m, _WIDTH), np.float32)
    if not m:
        return Blocks(pg, no, text, shape, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    length = np.fromiter((len(t) for t in text), np.int64, m)
    codes = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    kind = _KIND[np.minimum(codes, 0x30FF)]

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.float32), start)

    w = words(text, "lower")
    n_words = np.diff(w.first)
    first, last = codes[start], codes[start + length - 1]
    digits, upper, letters = total(kind == 1), total(kind == 2), total(kind >= 2)
    bars = total(np.isin(codes, _SEPARATORS) | (codes == ord(">")))
    # a slash between blanks separates, one within a date or an address does not
    bars += total(_apart(codes, ord("/")))
    stops = total(np.isin(codes, np.array([ord("."), ord("!"), ord("?")], np.uint32)))
    quote_end = np.isin(last, np.array([ord(c) for c in "\"”’)»"], np.uint32))
    mark = np.where(quote_end & (length > 1), codes[np.maximum(start, start + length - 2)], last)
    two = codes[np.maximum(start, start + length - 2)]
    dots = (last == ord("…")) | ((last == ord(".")) & (two == ord(".")))
    bullet = np.isin(first, np.array([ord(c) for c in "-–*•+"], np.uint32))
    numbered = (kind[start] == 1) & np.array([bool(re.match(r"\d{1,2}[.)]\s", t)) for t in text])
    quoted = np.isin(first, np.array([ord(c) for c in "“\"«"], np.uint32))
    # places among the page's non-blank blocks
    begin = np.flatnonzero(np.diff(pg, prepend=-1))
    size = np.diff(np.append(begin, m))
    at = np.arange(m) - np.repeat(begin, size)
    back = np.repeat(size, size) - 1 - at
    whole = np.zeros(m, np.uint64)
    np.add.at(whole, w.doc, w.hash)
    key = whole ^ (pg.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inv, times = np.unique(key, return_inverse=True, return_counts=True)
    safe = np.maximum(letters, 1)
    columns = [
        np.ones(m), n_words == 0, n_words == 1, n_words == 2, (n_words >= 3) & (n_words <= 5), (n_words >= 6) & (n_words <= 9),
        (n_words >= 10) & (n_words <= 15), (n_words >= 16) & (n_words <= 25), n_words > 25, np.isin(mark, [ord("."), ord("!"), ord("?")]) & ~dots,
        dots, last == ord(":"), stops >= 2, np.minimum(bars, 6) / 6, bars > 0, upper / safe, (upper == letters) & (letters > 3),
        digits / length, times[inv] > 1, at == 0, (at > 0) & (at < 3), back == 0, (back > 0) & (back < 3), at / np.maximum(1, at + back),
    ]
    for c, v in enumerate(columns):
        shape[:, c] = v
    t0 = len(columns)
    shape[:, t0 + TAGS.index("li")] = bullet | numbered
    shape[:, t0 + TAGS.index("blockquote")] = quoted
    shape[:, t0 + TAGS.index("nav")] = bars >= 2
    shape[:, t0] = ~(bullet | numbered | quoted | (bars >= 2))
    for i, tags in tagged:
        shape[i, t0:] = [any(g == t or (t == "h" and re.fullmatch(r"h[1-6]", g)) for g in tags) for t in TAGS]
    # a short block as a whole is a word of its own
    short = np.flatnonzero((n_words > 0) & (n_words <= 12))
    return Blocks(pg, no, text, shape, np.concatenate([w.hash, mix64(whole[short] + np.uint64(1))]), np.concatenate([w.doc, short]))


def _padded(page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, present): for each page a row with the places of its blocks."""
    begin = np.flatnonzero(np.diff(page, prepend=-1))
    size = np.diff(np.append(begin, len(page)))
    grid = begin[:, None] + np.arange(size.max())
    present = np.arange(size.max()) < size[:, None]
    return np.where(present, grid, 0), present


class ChainField:
    """A linear-chain conditional random field with two labels over shape columns and words."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary  # rising word hashes
        n = len(vocabulary)
        self.shape_w = np.zeros((_WIDTH, 2))
        self.word_w = np.zeros((n + 1, 2))  # the last row is for words not seen in training
        self.move = np.zeros((2, 2))

    def _words(self, b: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary place of each word and its value: words of a block weigh together as the root of their number."""
        v = self.vocabulary
        at = np.minimum(np.searchsorted(v, b.word), max(0, len(v) - 1)) if len(v) else np.zeros(len(b.word), np.int64)
        known = v[at] == b.word if len(v) else np.zeros(len(b.word), bool)
        n = np.bincount(b.word_of, minlength=len(b.page))
        return np.where(known, at, len(v)), (1 / np.sqrt(np.maximum(n, 1)))[b.word_of]

    def _scores(self, b: Blocks, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        s = b.shape @ self.shape_w
        for y in (0, 1):
            s[:, y] += np.bincount(b.word_of, self.word_w[at, y] * value, len(b.page))
        return s

    def fit(self, b: Blocks, label: np.ndarray, *, rounds: int = 160, rate: float = 0.15, l2: float = 5e-6) -> ChainField:
        """Maximum likelihood by Adam on all pages at once."""
        at, value = self._words(b)
        grid, present = _padded(b.page)
        n, length = grid.shape
        y = label[grid]
        onehot = np.eye(2)[label]
        parts = [self.shape_w, self.word_w, self.move]
        moment = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
        for step in range(1, rounds + 1):
            s = self._scores(b, at, value)[grid]
            e = np.exp(s - s.max(axis=2, keepdims=True))
            t = np.exp(self.move)
            # scaled forward and backward passes over all pages together
            fwd, bwd = np.zeros((n, length, 2)), np.ones((n, length, 2))
            fwd[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            for i in range(1, length):
                f = (fwd[:, i - 1] @ t) * e[:, i]
                fwd[:, i] = np.where(present[:, i, None], f / f.sum(1, keepdims=True), fwd[:, i - 1])
            for i in range(length - 2, -1, -1):
                g = (bwd[:, i + 1] * e[:, i + 1]) @ t.T
                bwd[:, i] = np.where(present[:, i + 1, None], g / g.sum(1, keepdims=True), 1.0)
            post = fwd * bwd
            post /= post.sum(2, keepdims=True)
            resid = np.zeros_like(onehot)
            resid[grid[present]] = post[present]
            resid -= onehot
            both = present[:, 1:]
            pair = fwd[:, :-1, :, None] * t * (e[:, 1:] * bwd[:, 1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
            m = len(b.page)
            grads = [
                b.shape.T @ resid / m,
                np.stack([np.bincount(at, resid[b.word_of, k] * value, len(self.word_w)) for k in (0, 1)], 1) / m,
                (pair[both].sum(0) - seen) / m,
            ]
            for p, g, (m1, m2) in zip(parts, grads, moment):
                g = g + l2 * p
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        return self

    def decode(self, b: Blocks) -> np.ndarray:
        """The most likely label of each block, by Viterbi over each page."""
        if not len(b.page):
            return np.zeros(0, np.int64)
        grid, present = _padded(b.page)
        s = self._scores(b, *self._words(b))[grid]
        n, length = grid.shape
        back = np.zeros((n, length, 2), np.int8)
        best = s[:, 0].copy()
        for i in range(1, length):
            via = best[:, :, None] + self.move
            back[:, i] = np.where(present[:, i, None], via.argmax(1), [0, 1])
            best = np.where(present[:, i, None], via.max(1) + s[:, i], best)
        label = np.zeros((n, length), np.int64)
        label[:, -1] = best.argmax(1)
        for i in range(length - 1, 0, -1):
            label[:, i - 1] = back[np.arange(n), i, label[:, i]]
        out = np.zeros(len(b.page), np.int64)
        out[grid[present]] = label[present]
        return out


def line_hashes(texts: list[str]) -> np.ndarray:
    """One hash for the words of each line, 0 for a line without words."""
    w = words(texts, "lower")
    out = np.zeros(len(texts), np.uint64)
    np.add.at(out, w.doc, w.hash)
    return out


@dataclass
class Evidence:
    """Of the sampled lines: the triples that articles and titles hold at least twice, and the lines under several URLs; rising hashes."""

    article: np.ndarray
    title: np.ndarray
    repeated: np.ndarray


def _within(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def evidence_labels(b: Blocks, known: Evidence) -> np.ndarray:
    """Labels of the training blocks by evidence; 1 is body."""
    m = len(b.text)
    w = words(b.text, "lower")
    h, at = kgrams(w, _TRIPLE)
    of = w.doc[at]
    n = np.maximum(np.bincount(of, minlength=m), 1)
    repeated = _within(known.repeated, line_hashes(b.text))
    listed = np.array([t.lower() in BODY_LINES for t in b.text], bool)
    of_article = _within(known.article, h)
    # a page that is there under two addresses repeats its body, so what articles hold is no furniture
    furniture = np.unique(h[(repeated & ~listed)[of] & ~of_article])
    of_site = _within(furniture, h)
    article, title, site = (np.bincount(of, x, m) / n for x in (of_article, _within(known.title, h), of_site))
    opens = np.zeros(m, bool)  # begins as a line of the site does
    opens[of[at == w.first[of]]] = of_site[at == w.first[of]]
    ended = np.array([bool(_ENDED.search(t)) for t in b.text], bool)
    quoted = np.array([t[0] in "“\"«" and t[-1] in "”\"»" for t in b.text], bool)
    told = (article >= 0.1) & (article > title) & (article > 2 * site) & ~opens
    return ((ended & ~repeated & (told | quoted)) | listed).astype(np.int64)


def _held(texts: DataFrame, wanted: np.ndarray, least: int = 2) -> np.ndarray:
    """Which of the ``wanted`` triples (rising) stand in ``texts`` (text) ``least`` times or more; all texts are read."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, 512):
            h = kgrams(words(p.column(0).to_pylist(), "lower"), _TRIPLE)[0]
            u, n = np.unique(h[_within(shared.value, h)], return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(u), pa.array(n)], names=["h", "n"])

    found = texts.filter("text IS NOT NULL").mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.sort(found.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))  # no more than wanted


def _repeated(pages: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Which of the ``wanted`` lines (rising) stand under more than one URL of ``pages`` (url, content)."""
    shared = pages.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, 512):
            text, of = [], []
            for i, t in enumerate(p.column(1).to_pylist()):
                lines = [x for x in t.split("\n") if x]
                text += lines
                of += [i] * len(lines)
            h, url = line_hashes(text), p.column(0).to_numpy()[np.array(of, np.int64)]
            keep = _within(shared.value, h)
            order = np.lexsort((url[keep], h[keep]))
            h, url = h[keep][order], url[keep][order]
            first = np.flatnonzero(np.diff(h, prepend=h[:1] + np.uint64(1)))
            last = np.append(first[1:], len(h)) - 1 if len(first) else first
            yield pa.RecordBatch.from_arrays([signed(h[first]), pa.array(url[first]), pa.array(url[last])], names=["h", "lo", "hi"])

    address = F.regexp_replace(F.lower("url"), r"^https?://(www\.)?|[/?#]+$|[?#].*$", "")  # the same page whatever the scheme and the query
    rows = pages.filter("content IS NOT NULL").select(F.xxhash64(address).alias("url"), "content")
    found = rows.mapInArrow(work, "h long, lo long, hi long").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi")
    return np.sort(found.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))  # no more than wanted


def train(
    pages: DataFrame, articles: DataFrame, *, train_pages: int = 2000, train_chars: int = 100_000, least_pages: int = 4, seed: int = 0
) -> ChainField:
    """The field fitted on a bounded sample of ``pages`` (url, content), chosen by hash and labelled by evidence."""
    full = pages.filter((F.length(F.trim("content")) > 0) & (F.length("content") <= train_chars)).select("content")
    some = sorted(hashed_sample(full, ["content"], train_pages, seed=seed).collect())
    b = blocks([r["content"] for r in some])
    if not len(b.page):
        return ChainField(np.zeros(0, np.uint64))
    triples = np.unique(kgrams(words(b.text, "lower"), _TRIPLE)[0])
    cells = articles.select(F.explode(F.array("content", "prevention")).alias("text"))
    known = Evidence(_held(cells, triples), _held(articles.select(F.col("title").alias("text")), triples), _repeated(pages, np.unique(line_hashes(b.text))))
    pairs = np.unique(np.stack([b.word, b.page[b.word_of].astype(np.uint64)]), axis=1) if len(b.word) else np.zeros((2, 0), np.uint64)
    u, n = np.unique(pairs[0], return_counts=True)
    return ChainField(u[n >= least_pages]).fit(b, evidence_labels(b, known))


def body_lines(
    pages: DataFrame, articles: DataFrame, *, key: str = "fetch_id", url: str = "url", text: str = "content", field: ChainField | None = None, **options
) -> DataFrame:
    """(key, line_no, line): the lines of each page's main body in order.

    ``field`` is one that ``train`` gave; without it one is trained first with ``options``.
    """
    field = field or train(pages.select(F.col(url).alias("url"), F.col(text).alias("content")), articles, **options)
    field = pages.sparkSession.sparkContext.broadcast(field)
    kind = pages.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches, 256):
            b = blocks(p.column(1).to_pylist())
            at = np.flatnonzero(field.value.decode(b) == 1)
            arrays = [p.column(0).take(pa.array(b.page[at])), pa.array(b.number[at]), pa.array([b.text[i] for i in at], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "line_no", "line"])

    rows = pages.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text))
    return rows.mapInArrow(work, f"k {kind}, line_no long, line string").distinct().withColumnRenamed("k", key)
