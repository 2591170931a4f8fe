"""Readers on byte fixtures built here."""

import io
import json
import re
import sqlite3
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioflow.conf import EngineConf
from folioflow.sources import readers as R

CONF = EngineConf()


def zipped(parts, **attrs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def read(data, fmt="zip-container", name="x", conf=CONF):
    kind, sections, meta = R.read_file(data, fmt, name, conf)
    return kind, "\n".join(f"{a}\n{b}" for a, b, _ in sections), meta


W = 'xmlns:w="http://w"'


def test_docx():
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Title"/><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading3"/></w:pPr><w:r><w:t>Sub</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Na|me</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Value</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    kind, text, _ = read(zipped({"word/document.xml": body}))
    assert kind == "docx" and "# Top" in text and "### Sub" in text and "| Na/me | Value |" in text


def test_xlsx():
    parts = {
        "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="Keep" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>shared</t></si></sst>",
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="14"/><xf numFmtId="0"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" s="0"><v>25569</v></c></row><row><c r="A2" s="1"><f>6*7</f><v>42</v></c><c r="B2" t="b"><v>1</v></c><c r="C2" s="0"><v>1</v></c></row></sheetData></worksheet>',
    }
    kind, text, meta = read(zipped(parts))
    assert kind == "xlsx" and "=== [sheet 1: Keep] ===" in text
    assert "shared\t\t1970-01-01" in text and "42 [=]\tTRUE\t1899-12-31" in text and meta["formula_cells"] == 1


def test_pptx_notes_follow_file_numbers():
    slide = lambda t: f"<s><a:p xmlns:a='a'><a:r><a:t>{t}</a:t></a:r></a:p></s>"
    kind, text, _ = read(zipped({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": slide("one"), "ppt/slides/slide3.xml": slide("three"), "ppt/notesSlides/notesSlide3.xml": slide("note")}))
    assert kind == "pptx" and "[slide 2/2] ===\nthree\n--- speaker notes ---\nnote" in text


def test_epub_and_odf():
    parts = {
        "META-INF/container.xml": '<container><rootfile full-path="O/p.opf"/></container>',
        "O/p.opf": '<package><manifest><item id="b" href="B.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "O/a.xhtml": "<html><h1>Chapter One</h1></html>", "O/b.XHTML": "<html><h1>Chapter Two</h1></html>",
    }
    _, text, meta = read(zipped(parts))
    assert text.index("# Chapter One") < text.index("# Chapter Two") and meta == {"docs": 2}
    odt = '<o xmlns:t="t"><t:h t:outline-level="2">Head</t:h><t:p>a<t:s t:c="3"/>b<t:span>c</t:span>d</t:p></o>'
    assert "## Head\na   bcd" in read(zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": odt}))[1]


@pytest.mark.parametrize("name", ["../x", "/abs", "..\\x", "a\\..\\..\\b"])
def test_unsafe_names(name):
    with pytest.raises(R.ReadError) as e:
        read(zipped({name: "x"}))
    assert e.value.code == 4


def test_archive_limits_and_listing():
    began = time.time()
    with pytest.raises(R.ReadError) as e:
        read(zipped({"bomb": b"\0" * (40 << 20)}))
    assert e.value.code == 4 and time.time() - began < 5
    _, text, meta = read(zipped({"readme.txt": "hi", "dropper.EXE": "x"}))
    assert "EXECUTABLE" in text and meta == {"entries": 2, "warnings": 1}
    assert read(zipped({}))[2] == {"entries": 0, "warnings": 0}


def test_hostile_xml():
    dtd = '<?xml version="1.0"?><!DOCTYPE a [<!ENTITY x "boom"><!ENTITY y "&x;&x;">]><a>&y; caf&#233;</a>'
    assert "boom" not in read(dtd.encode(), "xml")[1] and "café" in read(dtd.encode(), "xml")[1]
    with pytest.raises(R.ReadError) as e:
        read(("<a>" * 5000 + "</a>" * 5000).encode(), "xml")
    assert e.value.code == 4
    began = time.time()
    with pytest.raises(R.ReadError):
        read(b"<!DOCTYPE " * 4000, "xml")
    assert time.time() - began < 5


def pdf_of(pages, packed=True):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + k) for k in range(len(pages))) + b"] >>", 5: b"<< /Type /Font /Subtype /Type1 >>"}
    for k, content in enumerate(pages):
        body = zlib.compress(content) if packed else content
        objects[10 + k] = b"<< /Type /Page /Resources << /Font << /F1 5 0 R >> >> /Contents %d 0 R >>" % (200 + k)
        objects[200 + k] = b"<< /Length %d %s >>\nstream\n" % (len(body), b"/Filter /FlateDecode" if packed else b"") + body + b"\nendstream"
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % o for o in objects.items()) + b"\ntrailer << /Root 1 0 R >>"


def test_pdf():
    pages = [b"BT /F1 12 Tf (a\\(b\\)c \\\\ end) Tj T* [(Hello) -250 (world)] TJ ET", b"BT <48656C6C6F> Tj ET", b""]
    for packed in (True, False):
        _, text, meta = read(pdf_of(pages, packed), "pdf")
        assert "a(b)c \\ end\nHello world" in text and "=== [page 2/3] ===\nHello" in text and meta["pages_without_text"] == 1
    with pytest.raises(R.ReadError) as e:
        read(b"%PDF-1.4 1 0 obj <<>> endobj trailer << /Encrypt 9 0 R >>", "pdf")
    assert e.value.code == 4


def test_page_and_sheet_selection(spark, tmp_path):
    from folioflow.sources import ingest

    data = pdf_of([b"BT (p%d) Tj ET" % k for k in range(1, 11)])
    anchors = lambda spec: [a for a, _, _ in R.read_file(data, "pdf", "x", CONF, pages=spec)[1]]
    assert anchors("2,8-7") == ["=== [page 2/10] ===", "=== [page 7/10] ===", "=== [page 8/10] ==="] and len(anchors("junk")) == 10 and anchors("99") == []
    book = {"xl/workbook.xml": '<workbook><sheets><sheet name="Keep"/><sheet name="Two"/><sheet name="2"/></sheets></workbook>'}
    book |= {f"xl/worksheets/sheet{k}.xml": f"<w><sheetData><row><c><v>{k}</v></c></row></sheetData></w>" for k in (1, 2, 3)}
    sheets = lambda spec: [b for _, b, _ in R.read_file(zipped(book), "zip-container", "x", CONF, sheets=spec)[1]]
    assert sheets("keep") == ["1"] and sheets("2") == ["2"] and sheets("TWO, 3-3") == ["2", "3"] and sheets("none") == ["1", "2", "3"]
    (tmp_path / "a.pdf").write_bytes(data)
    row = ingest.document_text(spark, str(tmp_path), pages="3").first()
    assert "=== [page 3/10] ===\np3" in row.text and row.sections_total == 1
    assert "format=text" in ingest.document_text(spark, str(tmp_path), force="TXT").first().text
    assert "format=pdf" in ingest.document_text(spark, str(tmp_path), force="nonsense").first().text


def test_envelopes(spark, tmp_path):
    from folioflow.sources import ingest

    (tmp_path / "a.pdf").write_bytes(pdf_of([b'BT (say ":"12"") Tj ET', b""]))
    (tmp_path / "b.gz").write_bytes(b"\x1f\x8b\x08zz")
    (tmp_path / "c.yaml").write_text("k: 1")
    got = {r.doc_id.rsplit("/", 1)[1]: json.loads(r.json) for r in ingest.envelopes(spark, str(tmp_path)).collect()}
    assert got["a.pdf"]["ok"] and got["a.pdf"]["file"] == "a.pdf" and "page 2/2" in got["a.pdf"]["text"]
    assert got["a.pdf"]["meta"] | {"est_tokens_in": 0, "est_tokens_out": 0} == {
        "pages": 2, "engine_note": "builtin", "pages_without_text": 1, "est_tokens_in": 0, "est_tokens_out": 0, "budget_tokens": 24000, "strategy": "full", "sections_total": 2, "sections_emitted": 2, "untrusted_notice": True,
    }
    assert got["b.gz"].keys() == {"ok", "tool", "error", "exit_code"} and got["b.gz"]["exit_code"] == 3 and not got["b.gz"]["ok"]
    assert got["c.yaml"]["meta"]["strategy"] == "full" and "k: 1" in got["c.yaml"]["text"]
    stats = {r.doc_id.rsplit("/", 1)[1]: json.loads(r.json) for r in ingest.envelopes(spark, str(tmp_path), stats_only=True).collect()}
    assert "text" not in stats["a.pdf"] and stats["a.pdf"]["meta"] == got["a.pdf"]["meta"]


def test_repeated_lines_of_sections(spark):
    """The expression form against the window form, and inside the ingest."""
    from pyspark.sql import functions as F

    from folioflow.functions import text as X
    from folioflow.operators.lines import collapse_repeats
    from folioflow.sources import ingest

    texts = ["", "a\n" * 200, "x\n a\n" + "a \n" * 70 + "b\n" * 61 + "c\n" * 60 + "\n" * 90 + "d", "one", "e\n" * 59 + "e", "e\n" * 60 + "e", "f\n" * 61 + "f"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for most in (2, 60):
        want = {r.id: r.t for r in collapse_repeats(df, "id", "t", most).collect()}
        assert {r.id: r.t for r in df.select("id", X.collapse_repeats(F.col("t"), most).alias("t")).collect()} == want
    files = spark.createDataFrame([("a.txt", "text", bytearray(b"same\n" * 300 + b"end"))], "doc_id string, fmt string, content binary")
    body = ingest.sections_of(ingest.extract(files)).first().body
    assert body.count("same") == 60 and "identical line repeated more than 60 times" in body and body.endswith("end")


def test_text_formats():
    assert "[cool link](https://x.y)" in read(b'<html><a href="https://x.y">cool link</a><script>no</script>', "html")[1]
    source = b"{" + b"/rtf1{/fonttbl Arial;}caf/'e9 /u9731?}".replace(b"/", bytes([92]))
    assert "café ☃" in read(source, "rtf")[1] and "Arial" not in read(source, "rtf")[1]
    rows = "\n".join(str(k) for k in range(8000))
    text = read(rows.encode(), "delimited", "a.csv")[1]
    assert "5,800 more rows elided" in text and text.endswith("7999")
    assert "list of 3,000 items" in read(json.dumps({"items": [{"id": k, "blob": "x" * 90} for k in range(3000)]}).encode(), "json")[1]
    text, meta = read("\n".join(json.dumps({"n": k}) for k in range(1000)).encode(), "jsonl")[1:]
    assert '{"n": 999}' in text and "400 records elided" in text and meta == {"records": 1000, "malformed_records": 0}
    assert "port = 1" in read(b"[db]\nPort=1", "ini")[1] and '"name": "x"' in read(b'[owner]\nname="x"', "toml")[1]
    assert read("é".encode("utf-16"), "text")[1].endswith("é") and read(b"\xe9", "text")[1].endswith("é")
    mail = b"From: a@b\nTo: c@d\nSubject: s\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=X\n\n--X\nContent-Type: text/plain\n\nbody\n--X\nContent-Type: application/x\nContent-Disposition: attachment; filename=f.bin\n\nQUJD\n--X--\n"
    text = read(mail, "eml")[1]
    assert "body" in text and "f.bin" in text and "QUJD" not in text
    book = {"cells": [{"cell_type": "code", "source": ["print(1)"], "outputs": [{"output_type": "stream", "text": "out"}, {"output_type": "display_data", "data": {"image/png": "iVBO"}}]}]}
    text, meta = read(json.dumps(book).encode(), "ipynb")[1:]
    assert "out" in text and "iVBO" not in text and meta == {"cells": 1, "outputs_stripped": 2}
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 1920, 1080)
    assert "dimensions=1920x1080" in read(png, "image-png")[1]
    for fmt in ("ole-legacy", "gzip"):
        with pytest.raises(R.ReadError) as e:
            read(b"x", fmt)
        assert e.value.code == 3


def test_sqlite():
    base = sqlite3.connect(":memory:")
    base.executescript('create table users(id integer primary key, name text); insert into users values (1, "a"), (2, null); create table "we""ird"(id)')
    text = read(base.serialize(), "sqlite")[1]
    assert "## table: users (2 rows)" in text and "id:INTEGER PK" in text and "2\tNULL" in text and "we" not in text.replace("[skipped", "")


def test_files_end_to_end(spark, tmp_path):
    from folioflow.sources import ingest
    from folioflow.streaming.files import stream_documents

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("x,y\n1,2\n")
    (src / "b.txt").write_bytes(pdf_of([b"BT (lying extension) Tj ET"]))
    (src / "c.gz").write_bytes(b"\x1f\x8b\x08zz")
    got = {r.doc_id.rsplit("/", 1)[1]: r for r in ingest.extract(ingest.scan(spark, str(src))).collect()}
    assert got["a.csv"].fmt == "delimited" and got["b.txt"].fmt == "pdf" and got["c.gz"].exit_code == 3
    text = {r.doc_id.rsplit("/", 1)[1]: r.text for r in ingest.document_text(spark, str(src)).collect()}
    assert "lying extension" in text["b.txt"] and re.match(r"\[folioflow v[0-9.]+\] file=a.csv size=[0-9]+B format=delimited time=[0-9.]+s\n", text["a.csv"])
    stream_documents(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sanitize(spark):
    from folioflow.operators.lines import sanitize

    df = spark.createDataFrame([(1, "a\r\nb\x07\n" + "same\n" * 100 + "\n\n\n\n\nz"), (2, None), (3, "")], "id long, t string")
    out = {r.id: r.t for r in sanitize(df, "id", "t").collect()}
    assert out[1].count("same") == 60 and "identical line repeated more than 60 times" in out[1] and out[1].startswith("a\nb\n") and "\n\n\n\n" not in out[1]
    assert out[2] == "" and out[3] == ""


def test_detection_survives_any_bytes(spark):
    from folioflow.sources import sniff

    cases = [
        (b'{"a": "caf\xe9"}', "", "json"), (b'{"a": 1}\n{"a": 2}\n', "", "json"), (b'[1, 2] and more', "", "json"), (b"{broken \xff", "", "text"), (b"\xff\xfe\x00", "", "text"), (b'  {"k": "v"} tail text', "", "json"),
        (b"SQLite format 3\x00rest", "", "sqlite"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", ".doc", "ole-legacy"), (b"BM" + bytes(40), "", "image-bmp"), (b"II*\x00", "", "image-tiff"), (b"RIFF0000WEBP", "", "image-webp"),
        (b" <?xml version='1.0'?><a/>", "", "xml"), (b"<svg></svg>", "", "xml"), (b"<!DOCTYPE html><html>", "", "html"), (b"plain", ".ipynb", "ipynb"), (b"plain", ".ndjson", "jsonl"), (b"plain", ".toml", "toml"), (b"plain", ".msg", "ole-legacy"), (None, "", "text"),
    ]
    df = spark.createDataFrame([(k, c, e) for k, (c, e, _) in enumerate(cases)], "k int, content binary, ext string")
    got = {r.k: r.fmt for r in df.select("k", sniff.sniff(F.col("content"), F.col("ext")).alias("fmt")).collect()}
    assert got == {k: fmt for k, (_, _, fmt) in enumerate(cases)}


def test_tables_with_large_cells_and_errors():
    import csv

    rows = "".join(f"{k},{'x' * 200_000 if k == 2 else k}\n" for k in range(53))
    (_, body, _), = R.delimited(rows.encode(), "a.csv", EngineConf())[0]
    assert len(body.split("\n")) == 53
    small = EngineConf(input_bytes=150_000)
    (_, body, _), = R.delimited(rows.encode(), "a.csv", small)[0]
    assert "can't be read beyond row 2" in body
    csv.field_size_limit(131_072)


def test_pdf_references_caps_and_filters():
    import zlib

    from folioflow.sources.pdf import UNSUPPORTED, pdf

    def build(*objects):
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"

    text = b"BT (Hello) Tj ET"
    doc = build(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids 3 0 R >>", b"[4 0 R 5 0 R]", b"<< /Type /Page /Contents 6 0 R >>", b"<< /Type /Page /Contents 8 0 R >>", b"[7 0 R]", b"<< /Length 16 >>\nstream\n" + text + b"\nendstream", b"<< /Filter /LZWDecode >>\nstream\nxx\nendstream")
    sections, meta = pdf(doc, "a.pdf", EngineConf())
    assert [b for _, b, _ in sections] == ["Hello", UNSUPPORTED] and meta["pages"] == 2
    sections, meta = pdf(doc, "a.pdf", EngineConf(pdf_pages=1))
    assert len(sections) == 1 and meta["pages_truncated_to_cap"]
    bomb = build(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents 4 0 R >>", b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(b" " * 100_000) + b"\nendstream")
    with pytest.raises(R.ReadError) as e:
        pdf(bomb, "a.pdf", EngineConf(pdf_stream_bytes=1000))
    assert e.value.code == 4
