"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Writing: pages with equal payloads share one response record, that of the largest page_id; the others
are revisit records that name it.  Payloads meet by digest in a lookup that stands hot digests.

Reading: a task gets a byte range.  It scans for the gzip magic, validates each candidate by decoding
its first bytes as a WARC header, and owns the records that start inside its range; the last one is
read past the range's end.  What a task took for records inside the last record of an earlier range - a
payload that holds archived records itself - is left out afterwards, so any split size gives the same rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are always stored.
SMALLEST = 1000
SPLIT = 8 << 20
#: A member that inflates beyond this many bytes counts as damaged: a row can't hold it.
LARGEST = 1 << 30
_CHUNK = 1 << 20
_PROBE = 1 << 12


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# --- writing ---------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member.  A revisit keeps the HTTP head, with the payload's length, and no body."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def with_references(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with digest and refers_to (null: a response)."""
    html = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    p = p.withColumn("shared", F.when(F.octet_length("html") >= SMALLEST, F.col("digest")))
    groups = p.where(F.col("shared").isNotNull()).groupBy("shared").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1")
    groups = base.materialize(groups, "shared")
    found = base.lookup(p, groups, "shared", "n", F.coalesce("page_id", F.lit(0)))
    return found.withColumn("refers_to", F.when(~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))).drop("shared", "keeper")


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write pages (page_id, url, html) as .warc.gz files below path; returns the manifest (uri, bytes, records).

    Each task attempt writes a file of its own name, and the manifest - itself committed by Spark -
    lists the files of the attempts that succeeded, so lost executors and retries leave no double records.
    Nulls: a null html is an empty payload, a null url leaves the header out, a null page_id sorts
    below all others and gives a record without a number.  Pages that repeat their group's largest
    page_id are all responses.  No pages: no files.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        out = uri = None
        size = n = 0
        for batch in batches:
            for part in base.columns_of([batch]):
                if out is None:
                    filesystem, folder = _open_fs(path)
                    filesystem.create_dir(folder)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    uri, out = f"{path}/{name}", filesystem.open_output_stream(f"{folder}/{name}", compression=None)
                for page_id, url, html, digest, ref in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    member = record(page_id, url, html, digest, ref)
                    out.write(member)
                    size += len(member)
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size]), pa.array([n])], ["uri", "bytes", "records"])

    rows = with_references(pages).select("page_id", "url", F.col("html").cast("binary"), "digest", "refers_to")
    manifest = rows.mapInArrow(run, "uri string, bytes long, records long")
    manifest.write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema("uri string, bytes long, records long").parquet(f"{path}/manifest")


# --- reading ---------------------------------------------------------------------------------


class _Window:
    """Bytes of a file from an offset on, read in chunks as they are asked for."""

    def __init__(self, handle, start: int, size: int):
        self.handle, self.start, self.size, self.data = handle, start, size, bytearray()
        handle.seek(start)

    def upto(self, end: int) -> None:
        while self.start + len(self.data) < min(end, self.size):
            got = self.handle.read(_CHUNK)
            if not got:
                break
            self.data += got

    def drop(self, before: int) -> None:
        if before - self.start >= _CHUNK:
            del self.data[: before - self.start]
            self.start = before


def _is_record(window: _Window, at: int) -> bool:
    """Whether a gzip member that begins a WARC record starts at this offset."""
    window.upto(at + _PROBE)
    try:
        head = zlib.decompressobj(31).decompress(bytes(window.data[at - window.start : at - window.start + _PROBE]), 256)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.") and b"\r\n" in head


def _inflate(window: _Window, at: int) -> tuple[bytes, int]:
    """The member at an offset and where it ends; a damaged one raises zlib.error."""
    unpack, parts, size = zlib.decompressobj(31), [], 0
    while not unpack.eof:
        window.upto(at + 1)
        piece = bytes(window.data[at - window.start : at - window.start + _CHUNK])
        if not piece:
            raise zlib.error("the file ends inside a member")
        parts.append(unpack.decompress(piece, LARGEST + 1 - size))
        size += len(parts[-1])
        if size > LARGEST:
            raise zlib.error("the member inflates beyond the cap")
        at += len(piece) - len(unpack.unused_data)
        window.drop(at)
    return b"".join(parts), at


def members(handle, size: int, start: int, end: int) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """(offset, end, content, None) of the records that start in [start, end); (offset, offset, None, why) of damaged ones."""
    window, at = _Window(handle, start, size), start
    while at < end:
        window.upto(min(end + len(MAGIC), at + _CHUNK))
        k = window.data.find(MAGIC, at - window.start)
        if k < 0:
            at = max(at + 1, window.start + len(window.data) - len(MAGIC) + 1)
            if window.start + len(window.data) >= min(size, end + len(MAGIC)):
                return
            window.drop(at)
            continue
        at = window.start + k
        if at >= end:
            return
        if not _is_record(window, at):
            at += 1
            continue
        try:
            content, after = _inflate(window, at)
        except zlib.error as e:  # a member that is cut or damaged: go on behind its magic
            yield at, at, None, str(e)
            window = _Window(handle, at + 1, size)
            at += 1
            continue
        yield at, after, content, None
        at = after


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    return headers, rest[: int(length)] if re.fullmatch(r"[0-9]{1,18}", length) else rest


def read_digest(value: str) -> str | None:
    """'sha1:BASE32' or hex, with or without a label, as bare lower-case hex; null if it is neither."""
    digest = value.rpartition(":")[2].strip()
    if re.fullmatch(r"(?:[0-9a-fA-F]{2}){16,64}", digest) and len(digest) in (32, 40, 64, 96, 128):
        return digest.lower()
    try:
        return base64.b32decode(digest.upper() + "=" * (-len(digest) % 8)).hex() or None
    except ValueError:
        return None


_RECORD = T.StructType(
    [
        T.StructField("uri", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_archives(files: DataFrame, split: int = SPLIT, payload: bool = True, damaged: bool = False) -> DataFrame:
    """Records of WARC files (files: uri, bytes), one task per byte range of `split` bytes.

    payload_digest is bare lower-case hex; for a revisit it and payload_bytes are those of the payload
    referred to, and payload is null.  With payload=False the payload is not returned.  Other records
    than response and revisit are returned with their block as payload.
    Headers: a missing one is null; a length that is no number is that of what follows, a digest that
    is neither base 32 nor hex is null.  Members that are cut, damaged or beyond LARGEST are skipped;
    with `damaged` each gives a row that has its uri, offset and error alone.  Files without bytes or
    records, and no files, give no rows; a file listed twice is read twice.
    """
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long")))
    ranges = files.select("uri", "bytes", cuts.alias("start"))
    total = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0]
    ranges = ranges.repartition(max(1, min(int(total or 1), 100_000)))

    def run(batches):
        for batch in batches:
            for uri, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                filesystem, path = _open_fs(uri)
                rows, held = [], 0
                with filesystem.open_input_file(path) as handle:
                    for offset, end, content, error in members(handle, size, start, min(start + split, size)):
                        row = {"uri": uri, "offset": offset, "error": error} if content is None else _row(uri, offset, content, payload)
                        rows.append(row | {"start": start, "end": end})
                        held += len(content or b"")
                        if held >= 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    schema = T.StructType([*_RECORD.fields, T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    rows = base.materialize(ranges.mapInArrow(run, schema), "records")
    # One row per range: how far the ranges before it reach, where that is beyond its first record.
    reach = F.max("last").over(Window.partitionBy("uri").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = rows.groupBy("uri", "start").agg(F.min("offset").alias("first"), F.max("end").alias("last"))
    inside = base.materialize(spans.withColumn("reach", reach).where("first < reach").select("uri", "start", "reach"), "inside")
    if inside.limit(1).count():
        rows = rows.join(inside, ["uri", "start"], "left").where(F.col("reach").isNull() | (F.col("offset") >= F.col("reach")))
    return rows.where(F.lit(damaged) | F.col("error").isNull()).select(*_RECORD.fieldNames())


_ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in _RECORD] + [("start", pa.int64()), ("end", pa.int64())])


def _row(uri: str, offset: int, content: bytes, payload: bool) -> dict:
    headers, block = parse(content)
    kind, body, length = headers.get("warc-type"), block, None
    if "application/http" in headers.get("content-type", ""):
        head, _, body = block.partition(b"\r\n\r\n")
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
        length = int(m[1]) if m and len(m[1]) < 19 else None
    if kind == "revisit":
        digest, n, body = read_digest(headers.get("warc-payload-digest", "")), length, None
    else:
        digest, n = hashlib.sha1(body).hexdigest(), len(body)
    strip = lambda x: x.strip("<>") if x is not None else None
    return {
        "uri": uri, "offset": offset, "record_type": kind, "record_id": strip(headers.get("warc-record-id")), "target_uri": headers.get("warc-target-uri"),
        "refers_to_id": strip(headers.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": n, "payload": body if payload else None,
    }


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: one row per page."""
    spark: SparkSession = pages.sparkSession
    path = base.scratch_path(spark, "warc")
    if "://" not in path:
        path = ("file://" if path.startswith("/") else "file:///") + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else f"file://{path}"
    records = read_archives(write_archives(pages, path), payload=False)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1), F.lit("")).cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"), F.col("target_uri").alias("url"))
