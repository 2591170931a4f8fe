"""Caps and defaults of the engine; every one can be set as spark.folioflow.<name>, within its ceiling."""

from __future__ import annotations

import sys
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

#: Fixed values: (floor, ceiling) of each setting.
BOUNDS = {
    "input_bytes": (1, 2048 << 20), "zip_entries": (1, 20_000), "zip_bytes": (1, 2048 << 20), "zip_ratio": (1, 100_000), "xml_bytes": (1, 1024 << 20),
    "pdf_pages": (1, 100_000), "pdf_objects": (1, 2_000_000), "pdf_stream_bytes": (1, 2048 << 20), "budget_tokens": (200, 2_000_000), "head_rows": (1, 100_000), "tail_rows": (1, 100_000),
}
#: Settings that count a file's parts, and those that bound its bytes.
COUNTS, SIZES = ("zip_entries", "pdf_pages", "pdf_objects", "head_rows", "tail_rows"), ("input_bytes", "zip_bytes", "zip_ratio", "xml_bytes", "pdf_stream_bytes")


@dataclass(frozen=True)
class EngineConf:
    input_bytes: int = 512 << 20
    zip_entries: int = 5_000
    zip_bytes: int = 512 << 20
    zip_ratio: int = 300
    xml_bytes: int = 128 << 20
    pdf_pages: int = 4_096
    pdf_objects: int = 500_000
    pdf_stream_bytes: int = 256 << 20
    budget_tokens: int = 24_000
    head_rows: int = 2_000
    tail_rows: int = 200

    @classmethod
    def of(cls, spark: SparkSession) -> EngineConf:
        """The session's settings; what is no number falls back to the default."""
        found = {}
        for f in fields(cls):
            raw = spark.conf.get(f"spark.folioflow.{f.name}", None)
            try:
                value = int(raw) if raw is not None else f.default
            except ValueError:
                value = f.default
            low, high = BOUNDS[f.name]
            found[f.name] = min(max(value, low), high)
        return cls(**found)

    @classmethod
    def whole(cls) -> EngineConf:
        """For files that a job made itself: no cap on the number of their parts, and the ceilings for their bytes."""
        return cls(**dict.fromkeys(COUNTS, sys.maxsize), **{k: BOUNDS[k][1] for k in SIZES})


VERSION = "0.1.0"
#: Fixed values of the planner and the text pipeline.
HEAD_SHARE, TAIL_SHARE = 0.6, 0.4
SECTION_CHARS = 2_000_000
BLOB_CHARS, BLOB_RUN = 256, 240
REPEAT_LINES = 60
