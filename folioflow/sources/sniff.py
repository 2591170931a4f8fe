"""Format detection as one CASE over the first bytes, the extension and, last, the look of the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = 262_144
#: Magic bytes and what they mean, in order.
MAGIC = (
    (b"%PDF-", "pdf"), (b"PK\x03\x04", "zip-container"), (b"PK\x05\x06", "zip-container"), (b"{\\rtf", "rtf"), (b"SQLite format 3\x00", "sqlite"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole-legacy"), (b"\x89PNG\r\n\x1a\n", "image-png"), (b"\xff\xd8\xff", "image-jpeg"), (b"GIF87a", "image-gif"), (b"GIF89a", "image-gif"),
)
#: Extensions that decide before and after the look for JSON.
EARLY = {".ipynb": "ipynb", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".eml": "eml"}
LATE = {
    ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".conf": "ini", ".msg": "ole-legacy", ".csv": "delimited", ".tsv": "delimited", ".yaml": "yaml", ".yml": "yaml",
    ".html": "html", ".htm": "html", ".rtf": "rtf", ".sqlite": "sqlite", ".db": "sqlite", ".sqlite3": "sqlite",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def looks_like_json(content: Column) -> Column:
    """Whether a JSON value stands at the beginning, whatever follows it.

    Bytes that are no UTF-8 are read as Latin-1: their letters don't matter here.  What may follow a
    value is found where the value ends its line, or where no bracket of its kind stands behind it.
    """
    text = F.trim(F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")), F.lit(" \t\n\r"))
    whole = lambda t: F.try_parse_json(t).isNotNull()
    line = lambda t: F.try_parse_json(F.trim(F.substring_index(t, "\n", 1), F.lit(" \t\r"))).isNotNull()
    # A value closed by the last bracket of its kind, with other text behind it.
    closed = lambda t: F.try_parse_json(F.regexp_extract(t, r"(?s)^(\{.*\}|\[.*\])", 1)).isNotNull()
    return _let(text, lambda t: whole(t) | line(t) | closed(t))


def sniff(content: Column, ext: Column) -> Column:
    """Format tag of a binary column.  A null content is text."""
    begins = lambda magic: F.substring(content, 1, len(magic)) == F.lit(bytearray(magic))
    out = F
    for magic, fmt in MAGIC:
        out = out.when(begins(magic), fmt)
    out = out.when(begins(b"BM") & (F.octet_length(content) > 26), "image-bmp")
    out = out.when(begins(b"II*\x00") | begins(b"MM\x00*"), "image-tiff")
    out = out.when(begins(b"RIFF") & (F.substring(content, 9, 4) == F.lit(bytearray(b"WEBP"))), "image-webp")
    out = out.when(begins(b"\x1f\x8b"), "gzip")
    return out.otherwise(_let(F.lower(F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")), lambda head: _by_look(content, head, ext)))


def _by_look(content: Column, head: Column, ext: Column) -> Column:
    """Format of a content without magic bytes, by the look of its lower-case head and by its extension."""
    begins = lambda mark: head.rlike(rf"^[ \t\n\r\x0B\f]*{mark}")
    html = F.contains(head, F.lit("<html"))
    out = F.when(begins(r"<\?xml") | begins("<svg") | (begins("<") & ~html), "xml")
    out = out.when(html | F.contains(head, F.lit("<!doctype html")), "html")
    for e, fmt in EARLY.items():
        out = out.when(ext == e, fmt)
    out = out.when(begins(r"[\[{]") & looks_like_json(content), "json")
    for e, fmt in LATE.items():
        out = out.when(ext == e, fmt)
    return out.otherwise("text")
