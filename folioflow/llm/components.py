"""Connected components of an edge table, by joins alone.

Each round every node looks at its neighbours' grandparents, hooks its own parent and itself onto
the least of them, and takes its own grandparent (min-label hooking with pointer jumping); rounds
end when nothing changes.  Labels only fall and always name a node of the same component.  Each
round's labels are a written table, so no round depends on an executor that held an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b longs) -> (node, component), component the smallest node; loops and repeats may occur.

    Neighbour lists are expected to be short (callers chain the members of a group instead of
    pairing them); a label that very many nodes share is looked up by broadcast.  Rows with a null
    end are ignored.  No edges: no rows.
    """
    ends = edges.where(F.col("a") != F.col("b"))
    both = ends.select("a", "b").union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = base.materialize(both, "edges")
    labels = base.materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("f")).withColumnRenamed("a", "node"), "labels")
    while True:
        sizes = labels.groupBy("f").agg(F.count("*").alias("n"))
        parents = labels.select(F.col("node").alias("p"), F.col("f").alias("g"))
        above = sizes.join(parents, sizes.f == parents.p).select(sizes.f, "n", "g")
        jumped = base.lookup(labels, above, "f", "n", F.col("node"))  # node, f, g
        jumped = base.materialize(jumped, "jumped")
        near = both.join(jumped.select(F.col("node").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
        seen = jumped.join(near, F.col("node") == F.col("a")).select("node", "f", "g", F.least("g", "m").alias("m"))
        offers = seen.select(F.explode(F.array(F.struct(F.col("node"), F.col("m"), F.col("f").alias("old")), F.struct(F.col("f").alias("node"), F.col("m"), F.lit(None).cast("long").alias("old")))).alias("o")).select("o.*")
        after = base.materialize(offers.groupBy("node").agg(F.min("m").alias("f"), F.max("old").alias("old")), "labels")
        changed = after.where(F.col("f") != F.col("old")).limit(1).count()
        labels = after.select("node", "f")
        if not changed:
            return labels.withColumnRenamed("f", "component")
