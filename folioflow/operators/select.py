"""Page and sheet selection."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_ranges(spec: str) -> list[tuple[int, int]]:
    """'1-3,5' -> [(1, 3), (5, 5)]; ranges may be reversed, what is no number or range is ignored."""
    out = []
    for part in spec.split(","):
        if m := re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part):
            a, b = int(m[1]), int(m[2] or m[1])
            out.append((min(a, b), max(a, b)))
    return out


def in_pages(page: Column, spec: str | None) -> Column:
    """Whether a page number is wanted; a spec without any number wants all.  Ranges stay ranges in the plan."""
    out = None
    for a, b in page_ranges(spec or ""):
        test = page.between(a, b)
        out = test if out is None else out | test
    return F.lit(True) if out is None else out


def page_test(spec: str | None) -> Callable[[int], bool]:
    """The same test for a number in a worker."""
    ranges = page_ranges(spec or "")
    return lambda n: not ranges or any(a <= n <= b for a, b in ranges)


def sheet_names(spec: str) -> list[str]:
    """The parts of a sheet spec that are names; numbers and ranges are not."""
    return [p.strip().lower() for p in spec.split(",") if p.strip() and not page_ranges(p)]


def sheet_test(spec: str) -> Callable[[int, str], bool]:
    """Whether the spec lists a sheet's number or its name, for a worker."""
    names, ranges = sheet_names(spec), page_ranges(spec)
    return lambda k, name: name.lower() in names or any(a <= k <= b for a, b in ranges)


def select_sheets(sections: DataFrame, spec: str, doc: str = "doc_id", name: str = "name", index: str = "idx") -> DataFrame:
    """Rows whose sheet name (in any case) or number the spec lists; a document without any such row keeps all."""
    names = sheet_names(spec)
    wanted = F.lower(F.col(name)).isin(names) if names else F.lit(False)
    if page_ranges(spec):
        wanted = wanted | in_pages(F.col(index), spec)
    from pyspark.sql import Window

    some = F.max(wanted.cast("int")).over(Window.partitionBy(doc)) == 1
    return sections.withColumn("__some", some).where(wanted | ~F.col("__some")).drop("__some")
