import io
import json
import zipfile

import numpy as np
import pytest

from sieveline import providers as P
from sieveline.sources import files as X
from sieveline.sources import pages, readers


def archive(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = archive({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Xin </w:t></w:r><w:r><w:t>chào</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/></w:body></w:document>"})
S, R = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = archive({
    "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>tên</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c><c r="D1"/></row><row/></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": f'<worksheet {S}><sheetData><row><c r="A1"><v>9</v></c></row></sheetData></worksheet>',
})
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
PPTX = archive({
    "ppt/slides/slide10.xml": f"<x {A}><a:p><a:r><a:t>mười</a:t></a:r></a:p></x>", "ppt/slides/slide2.xml": f"<x {A}><a:p><a:r><a:t>hai</a:t></a:r></a:p></x>",
    "ppt/slides/slide3.xml": f"<x {A}/>", "ppt/notesSlides/notesSlide2.xml": f"<x {A}><a:p><a:r><a:t>ghi chú</a:t></a:r></a:p></x>",
})


def test_office_texts():
    assert X.docx_text(DOCX) == "Xin chào\na | b"
    assert X.xlsx_text(XLSX) == "## Sheet: One\ntên\t\t3"
    assert X.pptx_text(PPTX) == "## Slide 2\nhai\n_Notes:_ ghi chú\n\n## Slide 10\nmười"


def test_csv_text():
    assert X.csv_text('﻿a,"b, c"\n\n,\nx,y,z\n'.encode()) == "a\tb, c\nx\ty\tz"


@pytest.mark.parametrize("parts", [{f"f{i}": "" for i in range(501)}, {"../evil": "x"}, {"/abs": "x"}, {"bomb": "0" * 5_000_000}])
def test_unsafe_archives(parts):
    with pytest.raises(ValueError):
        X.checked_archive(archive(parts))
    with pytest.raises(ValueError):
        X.checked_archive(b"no zip")


def test_files_by_ending(spark, tmp_path):
    for n, d in {"a.docx": DOCX, "b.xlsx": XLSX, "c.csv": b"a,b", "d.txt": "chữ".encode(), "e.docx": b"broken", "f.exe": b"x"}.items():
        (tmp_path / n).write_bytes(d)
    got = {r["path"].rpartition("/")[2]: (r["text"], r["error"]) for r in X.parsed_files(spark, str(tmp_path / "*")).collect()}
    assert got["c.csv"] == ("a\tb", None) and got["d.txt"] == ("chữ", None) and got["e.docx"] == (None, "not an archive") and got["f.exe"][1]
    assert X.parse("x.pdf", b"")[1]


HTML = "<html><head><title>x</title></head><body><h1>Tên</h1><nav>Menu</nav><div class='body main'><p>Một.</p><p> </p><p>Hai <b>ba</b>.</p><script>no</script></div><p>Cuối</p></body></html>"


def test_articles(spark):
    assert pages.article(HTML, "h2.none", "div.main") == ("Tên", "Một.\n\nHai ba.")
    assert pages.article("<div id='c'>chỉ <br>chữ</div>", "h1", "#c") == ("", "chỉ chữ")
    rules = spark.createDataFrame([("x.test", "X", "h1", "div.main")], "host string, source string, title_sel string, content_sel string")
    p = spark.createDataFrame([("https://www.x.test/a", HTML), ("https://x.test/b", None), ("https://y.test/c", HTML)], "url string, html string")
    got = {r["url"]: (r["title"], r["source"], r["error"]) for r in pages.articles(p, rules).collect()}
    assert got == {"https://www.x.test/a": ("Tên", "X", None), "https://x.test/b": ("", "X", "no content")}


def test_strict_json(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "no"}',), ('{"a": 1, "c": 2}',), ("{",), ("",), (None,)], "j string")
    assert [r["problem"] for r in readers.strict_json(df, "j", "a int, b string").collect()] == [None, "wrong type", "unknown field", "malformed", "empty", "empty"]


def test_records_and_texts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"case_id": "c", "n": 1}, indent=1))
    assert readers.records(spark, str(tmp_path / "*.json"), "case_id string, n int, gone string").select("case_id", "n", "gone").first() == ("c", 1, None)
    (tmp_path / "a.md").write_text("one\ntwo")
    assert readers.text_files(spark, str(tmp_path / "*.md")).first()["text"] == "one\ntwo"


def test_providers(spark):
    df = spark.createDataFrame([(1, "lừa đảo"), (2, "lua dao"), (3, None)], "id long, t string")
    v = {r["id"]: r["embedding"] for r in P.embedded(df, "t", P.HashingEmbedder(8), batch=2).collect()}
    assert v[1] == v[2] and abs(np.linalg.norm(v[1]) - 1) < 1e-6 and not any(v[3])
    assert P.OverlapReranker().rerank("a b", ["x", "a b c", "a"]) == [(1, 1.0), (2, 0.5), (0, 0.0)]
    assert json.loads(P.generated(df, "t", P.EchoGenerator({"risk_level": "red"})).first()["answer"])["risk_level"] == "red"


def test_an_embedder_of_the_wrong_shape_is_an_error(spark):
    class Bad:
        width = 4

        def embed(self, texts, intent):
            return np.zeros((1, 3))

    with pytest.raises(Exception, match="embedder gave"):
        P.embedded(spark.createDataFrame([("a",)], "t string"), "t", Bad()).collect()


def test_csv_cells_stand_as_they_are_without_an_empty_end():
    assert X.csv_text(b"\xef\xbb\xbfa, b ,, \n,,\n\n\"c,d\",,e\n") == "a\t b \nc,d\t\te"
