"""Text of office files, one row per file, through the ``binaryFile`` source.

Each format is a small function from bytes to text; a file that cannot be read gives an
error and never fails the job.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Limits of archives and of CSV files.
MAX_ENTRIES, MAX_UNPACKED, MAX_RATIO, MAX_CSV = 500, 200 * 1024 * 1024, 100, 50 * 1024 * 1024


def _local(el: ElementTree.Element) -> str:
    return el.tag.rpartition("}")[2]


def checked_archive(data: bytes) -> zipfile.ZipFile:
    """The archive, or ValueError for one that is no zip, has too many or misplaced entries, or unpacks to too much."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as x:
        raise ValueError("not an archive") from x
    entries = z.infolist()
    if len(entries) > MAX_ENTRIES:
        raise ValueError("too many entries")
    if any(e.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", e.filename) for e in entries):
        raise ValueError("entry outside the archive")
    size, packed = sum(e.file_size for e in entries), sum(e.compress_size for e in entries)
    if size > MAX_UNPACKED:
        raise ValueError("unpacks to too much")
    if packed and size // packed > MAX_RATIO:
        raise ValueError("suspicious compression ratio")
    return z


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(z.read(name))
    except (KeyError, ElementTree.ParseError) as x:
        raise ValueError(f"no readable {name}") from x


def _filled(cells: list[str]) -> list[str]:
    """A row up to its last cell that is not blank."""
    n = max((i for i, c in enumerate(cells, 1) if c.strip()), default=0)
    return cells[:n]


def docx_text(data: bytes) -> str:
    """Paragraphs by line; a table row is one line of cells with bars between."""
    out: list[str] = []

    def cell(el: ElementTree.Element) -> str:
        return " ".join("".join(t.text or "" for t in el.iter() if _local(t) == "t").split())

    def walk(el: ElementTree.Element) -> None:
        for child in el:
            kind = _local(child)
            if kind == "p":
                out.append(re.sub(r"[ \t]+", " ", "".join(t.text or "" for t in child.iter() if _local(t) == "t")).strip())
            elif kind == "tr":
                out.append(" | ".join(_filled([cell(c) for c in child if _local(c) == "tc"])))
            else:
                walk(child)

    walk(_part(checked_archive(data), "word/document.xml"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def xlsx_text(data: bytes) -> str:
    """Visible sheets under a heading each, cells with tabs between, without empty cells at the end and empty rows."""
    z = checked_archive(data)
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in _part(z, "xl/sharedStrings.xml")]
    targets = {r.get("Id"): r.get("Target", "") for r in _part(z, "xl/_rels/workbook.xml.rels")}
    out: list[str] = []
    for sheet in _part(z, "xl/workbook.xml").iter():
        if _local(sheet) != "sheet" or sheet.get("state") in ("hidden", "veryHidden"):
            continue
        rid = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
        rows = []
        for row in _part(z, "xl/" + targets[rid].removeprefix("/xl/")).iter():
            if _local(row) != "row":
                continue
            cells: list[str] = []
            for c in row:
                column = 0
                for ch in re.match(r"[A-Z]*", c.get("r", "")).group():
                    column = column * 26 + ord(ch) - 64
                cells += [""] * (column - 1 - len(cells))
                value = "".join(t.text or "" for t in c.iter() if _local(t) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if cells := _filled(cells):
                rows.append("\t".join(cells))
        if rows:
            out.append("\n".join([f"## Sheet: {sheet.get('name')}", *rows]))
    return "\n\n".join(out)


def pptx_text(data: bytes) -> str:
    """Slides in order of their number with their notes; slides without either are left out."""
    z = checked_archive(data)

    def texts(pattern: str) -> dict[int, str]:
        found = {}
        for name in z.namelist():
            if m := re.fullmatch(pattern, name):
                lines = ["".join(t.text or "" for t in p.iter() if _local(t) == "t").strip() for p in _part(z, name).iter() if _local(p) == "p"]
                found[int(m[1])] = "\n".join(x for x in lines if x)
        return found

    slides, notes = texts(r"ppt/slides/slide(\d+)\.xml"), texts(r"ppt/notesSlides/notesSlide(\d+)\.xml")
    out = []
    for n in sorted(slides):
        parts = [slides[n], f"_Notes:_ {notes[n]}" if notes.get(n) else ""]
        if any(parts):
            out.append("\n".join([f"## Slide {n}", *(p for p in parts if p)]))
    return "\n\n".join(out)


def csv_text(data: bytes) -> str:
    """Records with tabs between cells as they stand, without empty cells at the end; ragged records are kept, empty ones left out."""
    if len(data) > MAX_CSV:
        raise ValueError("too large")
    rows = csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline=""), strict=False)
    return "\n".join("\t".join(r) for r in map(_filled, rows) if r)


def plain_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


PARSERS: dict[str, Callable[[bytes], str]] = {"txt": plain_text, "md": plain_text, "csv": csv_text, "docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text}


def parse(name: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file by its ending."""
    ending = name.rpartition(".")[2].lower()
    if ending == "pdf":
        try:
            from pypdf import PdfReader
        except ImportError:
            return None, "no PDF reader installed"
        text = "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
        return (text, None) if len(text.split()) >= 5 else (None, "too little text")
    if ending not in PARSERS:
        return None, f"unsupported type {ending!r}"
    try:
        return PARSERS[ending](data), None
    except Exception as x:  # a broken file is a row with an error
        return None, str(x) or type(x).__name__


def parsed_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text, error) of every file of a glob."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [parse(p, d) for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], pa.string()) for i in (0, 1))], names=["path", "text", "error"])

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInArrow(work, "path string, text string, error string")
