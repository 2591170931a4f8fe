"""Where results go: a text beside each source file, JSON lines, Parquet by document."""

from __future__ import annotations

import posixpath
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDECAR = ".folioflow.md"


def sidecar_path(source: str, suffix: str = SIDECAR) -> str:
    """/in/a.pdf -> /in/.a.pdf.folioflow.md"""
    folder, name = posixpath.split(source)
    return posixpath.join(folder, f".{name}{suffix}")


def write_sidecars(texts: DataFrame, suffix: str = SIDECAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each text beside the file that `key` names; returns key and sidecar (the path written).

    The rows are the action: nothing is written before they are asked for.  A text is written under a
    name of its own and then moved, so a lost or repeated task leaves whole files or none.  Rows with a
    null key or text are not written.
    """

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            done = []
            for source, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = fs.FileSystem.from_uri(quote(source, safe=":/@")) if ":/" in source else (fs.LocalFileSystem(), source)
                target = sidecar_path(path, suffix)
                part = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(body.encode("utf-8", "replace"))
                store.move(part, target)
                done.append((source, sidecar_path(source, suffix)))
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in done], pa.string()) for k in (0, 1)], ["key", "sidecar"])

    rows = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key string, sidecar string").withColumnRenamed("key", key)


def write_envelopes(envelopes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, one object per document."""
    envelopes.select("json").write.mode(mode).text(path)


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet of texts and plans, or of plans alone where there is no text."""
    documents.write.mode(mode).parquet(path)
