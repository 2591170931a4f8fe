"""Files to sections: binaryFile scan, format CASE, readers in Arrow batches, one status per file."""

from __future__ import annotations

import posixpath
import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import VERSION, EngineConf
from ..functions import text as X
from .sniff import extension, sniff

SECTION = "struct<section_idx: int, anchor: string, body: string, fetch_hint: string>"
_DDL = f"doc_id string, fmt string, sections array<{SECTION}>, meta map<string,string>, ok boolean, exit_code int, error string, bytes long, seconds double"
_SECTION = pa.struct([("section_idx", pa.int32()), ("anchor", pa.string()), ("body", pa.string()), ("fetch_hint", pa.string())])
_ARROW = pa.schema([("doc_id", pa.string()), ("fmt", pa.string()), ("sections", pa.list_(_SECTION)), ("meta", pa.map_(pa.string(), pa.string())), ("ok", pa.bool_()), ("exit_code", pa.int32()), ("error", pa.string()), ("bytes", pa.int64()), ("seconds", pa.float64())])
#: Names by which a caller may force a format.
FORCED = {
    **{k: k for k in ("pdf", "docx", "xlsx", "pptx", "odt", "ods", "odp", "epub", "rtf", "html", "xml", "json", "jsonl", "text", "sqlite", "ipynb", "eml", "yaml", "toml", "ini")},
    "csv": "delimited", "tsv": "delimited", "txt": "text", "zip": "zip-container", "yml": "yaml",
}
#: Formats whose reader output is sanitized.
SANITIZED = frozenset("pdf docx odt ods odp epub rtf html xml text yaml toml ini jsonl ipynb eml".split())


def scan(spark: SparkSession, path: str, conf: EngineConf | None = None, glob: str | None = None, force: str | None = None) -> DataFrame:
    """doc_id (the path), ext, length, content, fmt (that of `force` if it names one).  Files over the cap keep a row without content."""
    conf = conf or EngineConf.of(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    usable = F.col("length").between(1, conf.input_bytes)
    small = files.where(usable).select(F.col("path").alias("doc_id"), "length", "content")
    refused = files.where(~usable).select(F.col("path").alias("doc_id"), "length", F.lit(None).cast("binary").alias("content"))
    both = small.union(refused).withColumn("ext", extension(F.col("doc_id")))
    forced = FORCED.get((force or "").lower())
    return both.withColumn("fmt", F.lit(forced) if forced else sniff(F.col("content"), F.col("ext")))


def extract(files: DataFrame, conf: EngineConf | None = None, pages: str | None = None, sheets: str | None = None) -> DataFrame:
    """One row per file: doc_id, fmt, sections, meta, ok, exit_code, error, bytes, seconds (of the reader).  A bad file is a row, not a failure.

    files: doc_id, fmt, content.  pages ("1-3,5") selects pages of pdf files, sheets ("Sales,2-4") sheets
    of xlsx files, inside the readers; other formats ignore them.  A null content is an empty or oversized file (exit code 6).
    """
    conf = conf or EngineConf.of(files.sparkSession)

    def run(batches):
        from .readers import ReadError, read_file

        for batch in batches:
            rows = []
            for doc_id, fmt, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = {"doc_id": doc_id, "fmt": fmt, "sections": [], "meta": [], "ok": False, "exit_code": 6, "error": "the file is empty or over the size cap", "bytes": None, "seconds": None}
                if content is not None:
                    began = time.perf_counter()
                    try:
                        kind, sections, meta = read_file(content, fmt, posixpath.basename(doc_id or ""), conf, pages, sheets)
                        row |= {"fmt": kind, "ok": True, "exit_code": 0, "error": None, "meta": [(k, str(v)) for k, v in meta.items()]}
                        row["sections"] = [{"section_idx": k, "anchor": a, "body": _valid(b), "fetch_hint": h} for k, (a, b, h) in enumerate(sections)]
                    except ReadError as e:
                        row |= {"exit_code": e.code, "error": str(e)}
                    except (MemoryError, RecursionError) as e:
                        row |= {"exit_code": 4, "error": type(e).__name__}
                    except Exception as e:  # noqa: BLE001 - any damage to one file stays with that file
                        row |= {"exit_code": 5, "error": f"{type(e).__name__}: {e}"}
                if content is not None:
                    row |= {"bytes": len(content), "seconds": time.perf_counter() - began}
                rows.append(row)
                if sum(len(s["body"]) for s in row["sections"]) > 4 << 20 or len(rows) >= 64:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "fmt", "content").mapInArrow(run, _DDL)


def _valid(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def sections_of(extracted: DataFrame, keep: tuple = (), failed: bool = False) -> DataFrame:
    """doc_id, section_idx, anchor, body, fetch_hint, and the columns `keep`; text bodies cleaned inside the JVM.

    With `failed`, a file without sections keeps one row whose section is null.
    """
    each = (F.explode_outer if failed else F.explode)("sections").alias("s")
    s = extracted.select("doc_id", "fmt", *keep, each)
    names = [c for c in s.columns if c not in ("doc_id", "fmt", "s")]
    text = F.col("s.body")
    body = F.when(F.col("fmt").isin(*sorted(SANITIZED)), X.collapse_blank_runs(X.collapse_repeats(X.clean(text)))).otherwise(text)
    return s.select("doc_id", "s.section_idx", "s.anchor", body.alias("body"), "s.fetch_hint", *names)


def html_to_text(html: str):
    """Column of the text of an HTML column, by Arrow batches."""
    def convert(batch: pd.Series) -> pd.Series:
        from .readers import html_text

        return batch.map(lambda x: html_text(x) if x is not None else None)

    return F.pandas_udf(convert, "string")(F.col(html))


def document_text(spark: SparkSession, path: str, budget: int | None = None, full: bool = False, pages: str | None = None, sheets: str | None = None, force: str | None = None) -> DataFrame:
    """Files below a path to budgeted text, with the plan's columns and a header line."""
    from ..plans.budget import assemble

    conf = EngineConf.of(spark)
    got = extract(scan(spark, path, conf, force=force), conf, pages, sheets)
    return assemble(sections_of(got, (_header(),)), budget or conf.budget_tokens, full, ("header",))


#: What a reader may report of a file that its header line shows.
HEADER_COUNTS = ("pages", "sheets", "slides", "cells", "docs", "objects", "records", "words")


def _header():
    """File, size, format, the reader's counts and engine, and its time, in one line."""
    name = F.regexp_extract("doc_id", r"([^/]*)$", 1)
    counts = [F.concat(F.lit(f"{k}="), F.try_element_at("meta", F.lit(k))) for k in HEADER_COUNTS]
    engine = F.concat(F.lit("engine="), F.try_element_at("meta", F.lit("engine_note")))
    bits = F.concat_ws(" ", F.concat(F.lit("file="), name), F.concat(F.lit("size="), X.human_size(F.col("bytes"))), F.concat(F.lit("format="), F.col("fmt")), *counts, engine, F.concat(F.lit("time="), F.format_string("%.2fs", "seconds")))
    return F.concat(F.lit(f"[folioflow v{VERSION}] "), bits).alias("header")


def envelopes(spark: SparkSession, path: str, budget: int | None = None, full: bool = False, pages: str | None = None, sheets: str | None = None, force: str | None = None, stats_only: bool = False) -> DataFrame:
    """doc_id and json, one object per file, in one pass over the files.

    Read files: ok, tool, version, file, meta (the reader's and the plan's), text (not with stats_only).
    Others: ok false, tool, error, exit_code.
    """
    from ..plans.budget import assemble

    conf = EngineConf.of(spark)
    got = extract(scan(spark, path, conf, force=force), conf, pages, sheets)
    # Numbers and truth values leave the reader as text; a quote inside a JSON string is escaped, so these match whole values.
    plain = F.regexp_replace(F.regexp_replace(F.to_json("meta"), r':"(0|[1-9]\d{0,17})"', ":$1"), ':"(T|t)rue"', ":true")
    about = F.regexp_replace(plain, ':"(F|f)alse"', ":false").alias("about")
    s = sections_of(got, (_header(), about, "ok", "exit_code", "error"), failed=True)
    done = assemble(s, budget or conf.budget_tokens, full, ("header", "about", "ok", "exit_code", "error"))
    plan = F.to_json(F.struct("est_tokens_in", "est_tokens_out", "budget_tokens", "strategy", "sections_total", "sections_emitted", "untrusted_notice"))
    inner = F.substring(F.col("about"), F.lit(2), F.length("about") - 2)
    meta = F.parse_json(F.concat(F.lit("{"), inner, F.when(inner != "", ",").otherwise(""), F.substring(plan, 2, 1 << 30)))
    tool = F.lit("folioflow").alias("tool")
    file = F.regexp_extract("doc_id", r"([^/]*)$", 1).alias("file")
    good = F.to_json(F.struct("ok", tool, F.lit(VERSION).alias("version"), file, meta.alias("meta"), *([] if stats_only else ["text"])))
    bad = F.to_json(F.struct("ok", tool, "error", "exit_code"))
    return done.select("doc_id", F.when(F.col("ok"), good).otherwise(bad).alias("json"))
