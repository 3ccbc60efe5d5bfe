"""Per-document text statistics, and the form of a text told from them by a Gaussian mixture.

Statistics are computed for every document in Arrow batches and written once. They are
standardised by their mean and deviation over all documents, and a Gaussian mixture is
fitted to them by expectation-maximisation: first rounds on a bounded sample
(``sample_rows`` documents with the least hash) give a start, then every round sums over
all documents, in tasks that send weights, sums and products of each component, until the
likelihood settles. One component starts at each kind of inspected example; the examples
weigh as ``pull`` documents a component, whatever the number of documents. Components are
then mapped to prose, list, table or junk by how likely they make the inspected examples
of each form, and every document gets the form of the greatest posterior.

Shares are shares of characters without white space, so that a text with a short list
or table added keeps the statistics of what most of it is.

Nulls and edge cases: a null or blank text has all statistics 0 and no form; a null key is a
key; rows repeated whole count once; texts are read whole whatever their length; without
any text there is no form.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.wordstream import map_codes, mix64, words
from sieveline.llm._batches import hashed_sample, pieces
from sieveline.session import stage

#: Common words of the two languages, without case and diacritics.
COMMON_WORDS = (
    "la va cua co cho khong toi em anh chi ban ho minh da dang se duoc bi voi trong tren den tu khi neu thi ma nhung cac mot nay do vi nen theo "
    "ra vao len xuong lai roi con cung chi ai gi nao sao hay hoac de bang tai o qua rang rat hon nhat truoc sau "
    "the a an of to in and is are was were be been it that this for on with as by from at or not you he she they we my your his her their our "
    "had has have but if when which who will would can could do did no than then there so after before"
).split()
FORMS = ("prose", "list", "table", "junk")
STATISTICS = (
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "letter_ratio", "upper_ratio", "common_words", "stopped_lines", "sentence_share",
    "bullet_share", "short_line_share", "cell_share", "comma_rate", "repeated_lines", "top_word_share", "repeated_bigrams", "odd_share", "code_share",
    "long_token_share", "no_vowel_words", "words_per_line", "url_share", "distinct_words", "tiny_line_share", "gap_share",
)
_KIND = np.zeros(0x3100, np.uint8)  # 1 digit, 2 upper, 3 other letter, 4 white space, 5 plain punctuation, 6 code, 7 odd, 0 symbol
for _c in range(0x3100):
    _ch = chr(_c)
    _KIND[_c] = (
        7 if 0x7F <= _c <= 0xBF or _ch in "ÃÂÄÆÅ" else 1 if _ch.isdigit() else 2 if _ch.isupper() else 3 if _ch.isalpha() else 4 if _ch.isspace()
        else 5 if _ch in ".,!?:;'\"-()%/“”‘’…–+*•" else 6 if _ch in "{}<>=[]\\^~&$#@_|" else 0
    )
_BULLET = re.compile(r"(?:[-–*•+☐☑✓▪●○►>·]+|\d{1,4}[.):]|[a-zA-Z][.)]|\(\d{1,3}\))\s+\S")
_URL = re.compile(r"^(?:https?://|www\.)|[\w-]\.(?:test|example|invalid|com|vn|net|org)(?![\w-])")
_STOP = re.compile(r"[.!?…][\"”’)]*(?:\s|$)")
_GAPS = re.compile(r"\S {3,}\S.*\S {3,}\S|\S {5,}\S")
_GAP = re.compile(r"\S {2,}(?=\S)")
_DELIMITERS = ("|", "\t", ";", ",")


def _common_hashes() -> np.ndarray:
    return np.sort(words([" ".join(COMMON_WORDS)]).hash)


def _cells(text: str, lines: list[str]) -> int:
    """Characters of lines that are rows of cells: as many delimiters as a line next to them, and short cells."""
    best = 0
    for d in (*_DELIMITERS, "   "):
        if text.count("  " if d == "   " else d) < 2:
            continue
        n = [len(_GAP.findall(x)) + 2 * bool(_GAPS.search(x)) if d == "   " and "  " in x else x.count(d) for x in lines]
        least = 2 if d == "," else 1
        got = 0
        for i, x in enumerate(lines):
            k = n[i]
            if k < least:
                continue
            slack = 2 if d == "   " else k > 4  # empty cells of aligned columns leave no mark
            near = (i > 0 and abs(n[i - 1] - k) <= slack) or (i + 1 < len(lines) and abs(n[i + 1] - k) <= slack)
            wordy = len(x.split()) / (k + 1)
            if near and wordy <= 7 and (d != "," or not _STOP.search(x[:-1]) and ", " not in x):
                got += len(x)
        best = max(best, got)
    return best


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    texts = [t or "" for t in texts]
    n = len(texts)
    out = np.zeros((n, len(STATISTICS)))
    if not n:
        return out
    col = {name: i for i, name in enumerate(STATISTICS)}
    length = np.fromiter((len(t) + 1 for t in texts), np.int64, n)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    kind = np.where(codes < 0x3100, _KIND[np.minimum(codes, 0x30FF)], np.where((codes == 0xFFFD) | (codes >= 0x2E80) & (codes < 0x10000), 7, 0))

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.float64), start)

    solid = np.maximum(total(kind != 4), 1)
    letters = total((kind == 2) | (kind == 3))
    out[:, col["symbol_ratio"]] = total(kind == 0) / solid
    out[:, col["digit_ratio"]] = total(kind == 1) / solid
    out[:, col["letter_ratio"]] = letters / solid
    out[:, col["upper_ratio"]] = total(kind == 2) / np.maximum(letters, 1)
    out[:, col["odd_share"]] = total(kind == 7) / solid
    out[:, col["code_share"]] = total(kind == 6) / solid

    w = words(texts)
    n_words = np.diff(w.first)
    some = np.maximum(n_words, 1)
    common = _common_hashes()
    is_common = common[np.minimum(np.searchsorted(common, w.hash), len(common) - 1)] == w.hash
    out[:, col["n_words"]] = n_words
    out[:, col["mean_word_length"]] = (letters + total(kind == 1)) / some
    out[:, col["common_words"]] = np.bincount(w.doc, is_common, n) / some

    def repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(items that occur again, most occurrences, distinct items) of each text."""
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(h)))
        most = np.zeros(n)
        np.maximum.at(most, doc[at], times)
        return np.bincount(doc[at], np.where(times > 1, times, 0), n), most, np.bincount(doc[at], minlength=n)

    if len(w.hash):
        _, most, distinct = repeats(w.hash, w.doc)
        out[:, col["top_word_share"]] = most / np.maximum(some, 12)
        out[:, col["distinct_words"]] = distinct / some
        pair = w.doc[1:] == w.doc[:-1]
        again, _, _ = repeats(mix64(w.hash[:-1][pair] * np.uint64(3) + w.hash[1:][pair]), w.doc[1:][pair])
        out[:, col["repeated_bigrams"]] = again / np.maximum(n_words - 1, 12)

    # tokens between white space
    inside = kind != 4
    before = np.concatenate([[False], inside[:-1]])
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    of = np.repeat(np.arange(n), length)
    if len(begin):
        size = end - begin
        url = np.array([sum(len(x) for x in t.split() if "." in x[1:-2] and _URL.search(x)) for t in texts], float)
        out[:, col["url_share"]] = url / solid
        out[:, col["long_token_share"]] = np.maximum(0, np.bincount(of[begin], np.where(size > 24, size, 0), n) - url) / solid
        folded = map_codes(codes, "fold")
        vowel = np.isin(folded, [ord(c) for c in "aeiouy"]).astype(np.int32)
        alpha = ((kind == 2) | (kind == 3)).astype(np.int32)
        v, a = np.add.reduceat(vowel, begin), np.add.reduceat(alpha, begin)
        run = np.convolve(alpha * (1 - vowel), np.ones(4, np.int32))[: len(codes)] == 4
        hard = np.add.reduceat(run.astype(np.int32), begin) > 0
        worded = (a >= 3) & (a >= 0.8 * size)
        out[:, col["no_vowel_words"]] = np.bincount(of[begin], worded & ((v == 0) | hard), n) / np.maximum(np.bincount(of[begin], worded, n), 1)

    # lines
    for i, t in enumerate(texts):
        lines = [x for x in (x.strip() for x in t.split("\n")) if x]
        if not lines:
            continue
        m = len(lines)
        all_ = stops = sentences = bullets = short = tiny = gaps = n_spaced = 0
        for x in lines:
            size, wn = len(x), x.count(" ") + 1
            all_ += size
            n_spaced += wn
            stopped = x[-1] in ".!?…" or (x[-1] in "\"”’)" and bool(_STOP.search(x[-3:])))
            inner = (len(_STOP.findall(x)) if wn >= 5 else stopped) if "." in x or "!" in x or "?" in x or "…" in x else 0
            bullet = not x[0].isalpha() and bool(_BULLET.match(x)) or x[1:2] in (".", ")") and bool(_BULLET.match(x))
            stops += size * stopped
            bullets += size * bullet
            if (inner and wn >= 5 and not (bullet and inner < 2)) or wn > 22:
                sentences += size
            if wn <= 16 and not stopped:
                short += size
                tiny += size * (wn <= 7)
            if "   " in x and _GAPS.search(x):
                gaps += size
        out[i, col["stopped_lines"]] = stops / all_
        out[i, col["sentence_share"]] = sentences / all_
        out[i, col["gap_share"]] = gaps / all_
        out[i, col["comma_rate"]] = t.count(",") / max(1, n_spaced)
        out[i, col["words_per_line"]] = n_spaced / m
        out[i, col["repeated_lines"]] = 1 - len(set(lines)) / m
        if m > 2:
            out[i, col["bullet_share"]] = bullets / all_
            out[i, col["cell_share"]] = _cells(t, lines) / all_
        if m > 3:
            out[i, col["short_line_share"]] = short / all_
            out[i, col["tiny_line_share"]] = tiny / all_
    return out


def standardised(s: np.ndarray) -> np.ndarray:
    """Statistics with counts and rates brought to comparable scales."""
    x = s.copy()
    col = {name: i for i, name in enumerate(STATISTICS)}
    for name in ("n_words", "words_per_line"):
        x[:, col[name]] = np.log1p(np.minimum(x[:, col[name]], 400))
    x[:, col["mean_word_length"]] = np.log1p(np.minimum(x[:, col["mean_word_length"]], 60))
    for name in ("comma_rate", "odd_share", "code_share", "symbol_ratio", "top_word_share", "digit_ratio"):
        x[:, col[name]] = np.sqrt(np.minimum(x[:, col[name]], 1))
    return x


class Mixture:
    """A Gaussian mixture with full covariances, fitted by expectation-maximisation."""

    def __init__(self, means: np.ndarray, spread: float = 0.5, floor: float = 0.03):
        k, d = means.shape
        self.weight, self.mean, self.cov = np.full(k, 1 / k), means.copy(), np.stack([np.eye(d) * spread] * k)
        self.floor = floor

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.mean)))
        for k, (m, c) in enumerate(zip(self.mean, self.cov)):
            low = np.linalg.cholesky(c)
            z = (x - m) @ np.linalg.inv(low).T
            out[:, k] = np.log(self.weight[k] + 1e-12) - np.log(np.diag(low)).sum() - (z * z).sum(1) / 2
        return out

    def posterior(self, x: np.ndarray) -> np.ndarray:
        lp = self.log_parts(x)
        lp -= lp.max(1, keepdims=True)
        p = np.exp(lp)
        return p / p.sum(1, keepdims=True)

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """(of each component the weight, the weighted sum and the weighted products of the rows, log likelihood of all rows)."""
        lp = self.log_parts(x)
        top = lp.max(1, keepdims=True)
        p = np.exp(lp - top)
        whole = p.sum(1, keepdims=True)
        r = p / whole
        out = [np.concatenate([[w.sum()], w @ x, ((x.T * w) @ x).ravel()]) for w in r.T]
        return np.stack(out), float((top + np.log(whole)).sum())

    def step(self, sums: np.ndarray, start: np.ndarray, pull: float) -> None:
        """The parameters that make the summed rows most likely; ``pull`` counts as that many rows at each component's ``start``."""
        d = self.mean.shape[1]
        n = sums[:, 0]
        for k in np.flatnonzero(n > 1e-3):
            first, second = sums[k, 1 : d + 1], sums[k, d + 1 :].reshape(d, d)
            m = (first + pull * start[k]) / (n[k] + pull)
            c = second - np.outer(first, m) - np.outer(m, first) + n[k] * np.outer(m, m)
            self.mean[k] = m
            self.cov[k] = ((c + c.T) / 2 + np.eye(d) * 4 * self.floor) / (n[k] + 4) + np.eye(d) * self.floor
        self.weight = (n + 0.5) / (n + 0.5).sum()

    def fit(self, x: np.ndarray, rounds: int = 25, pull: float = 15.0) -> Mixture:
        """Rounds over rows that are in memory."""
        start = self.mean.copy()
        for _ in range(rounds):
            self.step(self.sums(x)[0], start, pull)
        return self


class FormModel:
    """Standardisation, mixture and the form of each component."""

    def __init__(self, mid: np.ndarray, scale: np.ndarray, examples: list[tuple[str, str, str]]):
        self.mid, self.scale, self.examples = mid, scale, examples
        self.shown = self.scaled(statistics([t for _, _, t in examples]))
        kinds = sorted({(f, k) for f, k, _ in examples})
        of = np.array([kinds.index((f, k)) for f, k, _ in examples])
        self.kinds, self.start = kinds, np.stack([self.shown[of == i].mean(0) for i in range(len(kinds))])
        self.mixture = Mixture(self.start)

    def named(self) -> FormModel:
        """With the forms of the components: those of the inspected examples that they explain."""
        r = self.mixture.posterior(self.shown)
        form = np.array([FORMS.index(f) for f, _, _ in self.examples])
        votes = np.stack([r[form == i].sum(0) / max(1, (form == i).sum()) for i in range(len(FORMS))], 1)
        own = 0.02 * np.eye(len(FORMS))[[FORMS.index(f) for f, _ in self.kinds]]  # a component that explains none keeps its start's
        self.form = (votes + own) / (votes + own).sum(1, keepdims=True)
        return self

    def scaled(self, s: np.ndarray) -> np.ndarray:
        return np.clip((standardised(s) - self.mid) / self.scale, -6, 6)

    def forms(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most likely form of each row of statistics and its posterior."""
        p = self.mixture.posterior(self.scaled(s)) @ self.form
        return p.argmax(1), p.max(1)


def text_statistics(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, one column for each of STATISTICS)."""
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 512):
            s = statistics(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in s.T)], names=["k", *STATISTICS])

    out = df.select(key, text).mapInArrow(work, f"k {kind}, " + ", ".join(f"{c} double" for c in STATISTICS))
    return out.distinct().withColumnRenamed("k", key)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The statistics of a batch, a row a document."""
    return np.stack([batch.column(c).to_numpy() for c in STATISTICS], axis=1)


def _summed(found: DataFrame, rows: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all documents of what ``rows`` gives for a batch of statistics, a matrix of the given shape."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for p in pieces(iter([b]), 4096):
                total += rows(_matrix(p))
        place = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], names=["place", "value"])

    sums = found.mapInArrow(work, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()  # one row an element
    out = np.zeros(shape[0] * shape[1])
    out[sums["place"].to_numpy()] = sums["value"].to_numpy()
    return out.reshape(shape)


def train_forms(found: DataFrame, *, key: str = "doc_id", sample_rows: int = 6000, pull: float = 5.0, rounds: int = 12, settled: float = 1e-3) -> FormModel:
    """The model fitted to the statistics of all documents, ``found`` (key, STATISTICS), which is read once a round.

    ``settled`` is the gain in mean log likelihood below which rounds end.
    """
    from sieveline.llm.form_examples import EXAMPLES

    d = len(STATISTICS)

    def moments(s: np.ndarray) -> np.ndarray:
        x = standardised(s)
        return np.stack([np.full(d, float(len(x))), x.sum(0), (x * x).sum(0)])

    n, first, second = _summed(found, moments, (3, d))
    if not n[0]:
        shown = standardised(statistics([t for _, _, t in EXAMPLES]))
        return FormModel(shown.mean(0), np.maximum(shown.std(0), 0.02), EXAMPLES).named()
    mid = first / n
    model = FormModel(mid, np.maximum(np.sqrt(np.maximum(second / n - mid * mid, 0)), 0.02), EXAMPLES)
    sample = hashed_sample(found, [key], sample_rows).select(*STATISTICS).toPandas().to_numpy(float)
    model.mixture.fit(model.scaled(sample[np.lexsort(sample.T)]))
    before = -np.inf
    k = len(model.start)
    for _ in range(rounds):
        shared = found.sparkSession.sparkContext.broadcast(model)

        def expected(s: np.ndarray, shared=shared) -> np.ndarray:
            sums, likelihood = shared.value.mixture.sums(shared.value.scaled(s))
            return np.concatenate([sums, np.full((k, 1), likelihood)], axis=1)

        total = _summed(found, expected, (k, 2 + d + d * d))
        shared.unpersist()
        model.mixture.step(total[:, :-1], model.start, pull)
        gain, before = total[0, -1] / n[0] - before, total[0, -1] / n[0]
        if gain < settled:
            break
    return model.named()


def forms(df: DataFrame, *, key: str = "doc_id", text: str = "text", model: FormModel | None = None, **options) -> DataFrame:
    """(key, form, posterior): the form of every text that is not blank; ``options`` go to ``train_forms``.

    ``model`` is one that ``train_forms`` gave; without it one is fitted to these documents first.
    """
    found = stage(text_statistics(df.filter(F.col(text).rlike(r"\S")), key=key, text=text))
    fitted = df.sparkSession.sparkContext.broadcast(model or train_forms(found, key=key, **options))
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4096):
            f, p = fitted.value.forms(_matrix(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([FORMS[i] for i in f], pa.string()), pa.array(p)], names=["k", "form", "posterior"])

    return found.select(key, *STATISTICS).mapInArrow(work, f"k {kind}, form string, posterior double").withColumnRenamed("k", key)
