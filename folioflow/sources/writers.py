"""Small files of the formats that the readers know, made from rows: for queries, benches and tests.

Each writer takes a file's name and its rows (lists of strings, in order) and returns bytes.
"""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import zipfile
import zlib
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rows = list[list[str]]
#: Fixed value: written bytes that are handed on together.
BATCH_BYTES = 32 << 20
_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_SLIDE = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_ODF = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def docx(name: str, rows: Rows) -> bytes:
    """A heading, a paragraph per row, and a table of all rows."""
    p = lambda t, style="": f"<w:p>{style}<w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    table = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    body = p(name, '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>') + "".join(p(r[0]) for r in rows) + f"<w:tbl>{table}</w:tbl>"
    return _zip({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {_WORD}><w:body>{body}</w:body></w:document>"})


def xlsx(name: str, rows: Rows) -> bytes:
    """Per row: a shared string, a number, a date (days since 1899-12-30), and a gap before a truth value."""
    strings = {t: k for k, t in enumerate(dict.fromkeys(r[0] for r in rows))}
    cells = lambda k, r: (
        f'<c r="A{k}" t="s"><v>{strings[r[0]]}</v></c><c r="B{k}"><v>{r[1]}</v></c><c r="C{k}" s="1"><v>{r[2]}</v></c><c r="E{k}" t="b"><v>{r[3]}</v></c>'
    )
    data = "".join(f'<row r="{k}">{cells(k, r)}</row>' for k, r in enumerate(rows, 1))
    return _zip({
        "[Content_Types].xml": "<Types/>",
        "xl/workbook.xml": f'<workbook {_SHEET}><sheets><sheet name="{escape(name)}" sheetId="1" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId7" Target="worksheets/data.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {_SHEET}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {_SHEET}>" + "".join(f"<si><t>{escape(t)}</t></si>" for t in strings) + "</sst>",
        "xl/worksheets/data.xml": f"<worksheet {_SHEET}><sheetData>{data}</sheetData></worksheet>",
    })


def pptx(name: str, rows: Rows) -> bytes:
    """A slide per row: its first string, the second in the notes."""
    p = lambda t: f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
    parts = {"[Content_Types].xml": "<Types/>", "ppt/presentation.xml": f"<p:presentation {_SLIDE}/>"}
    for k, r in enumerate(rows, 1):
        parts[f"ppt/slides/slide{k}.xml"] = f"<p:sld {_SLIDE}>{p(r[0])}</p:sld>"
        parts[f"ppt/notesSlides/notesSlide{k}.xml"] = f"<p:notes {_SLIDE}>{p(r[1])}{p(str(k))}</p:notes>"
    return _zip(parts)


def odt(name: str, rows: Rows) -> bytes:
    lines = f'<text:h text:outline-level="2">{escape(name)}</text:h>' + "".join(f"<text:p>{escape(r[0])}<text:tab/>{escape(r[1])}</text:p>" for r in rows)
    return _zip({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f"<office:document-content {_ODF}><office:body>{lines}</office:body></office:document-content>"})


def epub(name: str, rows: Rows) -> bytes:
    """A chapter per row, in the order of the spine; the manifest lists them backwards."""
    items = "".join(f'<item id="c{k}" href="text/c{k}.xhtml"/>' for k in reversed(range(len(rows))))
    refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(rows)))
    parts = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>', "OPS/book.opf": f"<package><manifest>{items}</manifest><spine>{refs}</spine></package>"}
    return _zip(parts | {f"OPS/text/c{k}.xhtml": f"<html><body><h1>{escape(r[0])}</h1><p>{escape(r[1])}</p></body></html>" for k, r in enumerate(rows)})


def pdf(name: str, rows: Rows) -> bytes:
    """A page per row, a line per string."""
    literal = lambda t: t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    kids = " ".join(f"{3 + 2 * k} 0 R" for k in range(len(rows)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(rows)} >>".encode()]
    for k, r in enumerate(rows):
        content = zlib.compress(b"BT /F1 12 Tf " + b" 0 -14 Td ".join(b"(" + literal(t) + b") Tj" for t in r) + b" ET")
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * k} 0 R >>".encode(), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(content), content)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


def sqlite(name: str, rows: Rows) -> bytes:
    base = sqlite3.connect(":memory:")
    base.execute("create table items (id integer primary key, name text)")
    base.executemany("insert into items values (?, ?)", [(int(r[0]), r[1]) for r in rows])
    base.commit()
    return base.serialize()


def rtf(name: str, rows: Rows) -> bytes:
    return (r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}" + "".join(rf"{{\b {r[0]}}}\tab {r[1]}\par " for r in rows) + "}").encode("latin-1")


def eml(name: str, rows: Rows) -> bytes:
    return f"From: {name}@example.org\r\nSubject: {rows[0][0]}\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n".encode() + "\n".join(r[1] for r in rows).encode()


def ipynb(name: str, rows: Rows) -> bytes:
    cell = lambda r: {"cell_type": "code", "source": [r[0], "\n", r[1]], "outputs": [{"output_type": "stream", "name": "stdout", "text": [r[0]]}]}
    return json.dumps({"cells": [cell(r) for r in rows]}).encode()


def csv(name: str, rows: Rows) -> bytes:
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    return "".join(",".join(map(quoted, r)) + "\r\n" for r in rows).encode()


def jsonl(name: str, rows: Rows) -> bytes:
    return "".join(r[0] + "\n" for r in rows).encode()


def ini(name: str, rows: Rows) -> bytes:
    return (f"; rows\n[{name}]\n" + "".join(f"{r[0]}={r[1]}\n" for r in rows)).encode()


def toml(name: str, rows: Rows) -> bytes:
    return ("".join(f"{r[0]} = {json.dumps(r[1])}\n" for r in rows)).encode()


def xml(name: str, rows: Rows) -> bytes:
    return (f"<?xml version='1.0'?><!DOCTYPE list [<!ENTITY e 'x'>]><list name=\"{escape(name)}\">" + "".join(f'<item id="{r[0]}">{escape(r[1])}</item>' for r in rows) + "</list>").encode()


def archive(name: str, rows: Rows) -> bytes:
    """A stored entry per row, of as many bytes as its second string says."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for r in rows:
            z.writestr(r[0], b"x" * int(r[1]))
    return out.getvalue()


def png(name: str, rows: Rows) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + struct.pack(">II", int(rows[0][0]), int(rows[0][1])) + bytes(10)


WRITERS = {f.__name__: f for f in (docx, xlsx, pptx, odt, epub, pdf, sqlite, rtf, eml, ipynb, csv, jsonl, ini, toml, xml, archive, png)}


def written(batches, writer: str, extension: str):
    """Batches of names and rows to batches of names and files, each closed once its files reach BATCH_BYTES."""
    for batch in batches:
        names, made, size = [], [], 0
        for k in range(batch.num_rows):
            name = batch.column(0)[k].as_py()
            names.append(name + extension)
            made.append(WRITERS[writer](name, batch.column(1)[k].as_py()))
            size += len(made[-1])
            if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.binary())], ["doc_id", "content"])
                names, made, size = [], [], 0


def write_files(rows: DataFrame, name: Column, order: Column, cells: list[Column], writer: str, extension: str = "") -> DataFrame:
    """doc_id (the name), content: one file per name, its rows in order, nulls as empty strings.

    A file is one value, so the rows of a name meet in one task.  That task holds the files of a batch
    as rows, but only BATCH_BYTES of them written, or one larger file.
    """
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in cells]
    r = rows.select(name.cast("string").alias("doc_id"), F.struct(order.alias("at"), F.array(*text).alias("cells")).alias("r"))
    files = r.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["cells"]).alias("rows"))

    def run(batches):
        return written(batches, writer, extension)

    return files.mapInArrow(run, "doc_id string, content binary")
