"""Row operators over lines, records and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import REPEAT_LINES
from ..functions import text as X


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 0), line."""
    return df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "line"))


def collapse_repeats(df: DataFrame, key: str, text: str, most: int = REPEAT_LINES) -> DataFrame:
    """key, text with runs of equal lines cut: the first and most - 1 repeats stay, a mark follows.

    Lines compare without outer white space; blank lines never repeat.  Every row is cut by itself, in
    place, so rows that share a key, or have none, stay apart and nothing is exchanged.
    """
    return df.select(key, X.collapse_repeats(F.coalesce(F.col(text), F.lit("")), most).alias(text))


def sanitize(df: DataFrame, key: str, text: str, most: int = REPEAT_LINES) -> DataFrame:
    """key and sanitized text: controls, line ends, base64 runs, repeated lines, blank runs."""
    cleaned = df.select(key, X.clean(F.col(text)).alias(text))
    return collapse_repeats(cleaned, key, text, most).withColumn(text, X.collapse_blank_runs(F.col(text)))


def head_tail(df: DataFrame, partition: list[str], order: list, head: int, tail: int) -> DataFrame:
    """The first `head` and last `tail` rows of each group, with row_no and n_rows; the true tail."""
    w = Window.partitionBy(*partition)
    numbered = df.withColumn("row_no", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("n_rows", F.count(F.lit(1)).over(w).cast("long"))
    return numbered.where((F.col("n_rows") <= head + tail) | (F.col("row_no") <= head) | (F.col("row_no") > F.col("n_rows") - tail))


def tsv(*cells: Column) -> Column:
    """Cells flagged, flattened and joined by tabs."""
    return F.concat_ws("\t", *[F.translate(X.flag_formula(F.coalesce(c.cast("string"), F.lit(""))), "\t\n", "  ") for c in cells])
