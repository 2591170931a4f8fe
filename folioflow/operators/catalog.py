"""Reports over tables and archive entries, and sheet rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed list: suffixes of files that run.
EXECUTABLE = "exe|dll|scr|bat|cmd|ps1|psm1|vbs|vbe|js|jse|jar|msi|com|hta|sh|wsf|lnk"


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n_rows, n_columns, columns ('name:TYPE, ...') of each table; counts read no column."""
    rows = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(", ".join(f"{c}:{k.upper()}" for c, k in df.dtypes)).alias("columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def sample(df: DataFrame, order: list[str], rows: int = 5) -> DataFrame:
    """The first rows in a stated order: top-k, not a full sort."""
    return df.orderBy(*order).limit(rows)


def densify(cells: DataFrame, row: str, column: str, value: str, separator: str = "\t") -> DataFrame:
    """row, line: cells of a row at their columns, gaps empty.  Rows without cells have no line."""
    m = cells.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.col(column).cast("int"), F.col(value).cast("string")))).alias("m"))
    wide = F.transform(F.sequence(F.lit(1), F.array_max(F.map_keys("m"))), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    return m.select(row, F.array_join(wide, separator).alias("line"))


def archive_checks(entries: DataFrame) -> DataFrame:
    """entries (doc_id, entry_idx, name, file_size) with unsafe, executable and the running size."""
    path = F.replace("name", F.lit("\\"), F.lit("/"))
    w = Window.partitionBy("doc_id").orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    return entries.select(
        "*", (path.rlike(r"(^|/)\.\.(/|$)") | F.col("name").startswith("/")).alias("unsafe"), F.lower("name").rlike(rf"\.({EXECUTABLE})$").alias("executable"), F.sum("file_size").over(w).alias("running")
    )
