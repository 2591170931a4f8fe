"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions alone.

The mix is a sequence of slots, one block of equally many words each.  Slot k maps the golden-ratio
point frac(k * phi) through the cumulative targets to a source, so every stretch of the schedule has
the sources in nearly their target shares.  Slots are ranked within their source, and rank r takes
block r of the source's shuffled documents laid end to end, epoch after epoch.  The last block of a
source is cut where its target is reached; the sequence goes on until all sources have theirs.

Documents are shuffled by a hash of their id.  Their places on the source's line are prefix sums in
two levels - hash buckets within a source, then documents within a bucket - so no source, however
large, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

#: Slots of a schedule, about; the block size follows from it, so the schedule's size is bounded.
SLOTS = 1 << 20
#: Hash buckets per source.
BUCKETS = 4096
#: No document is taken more often than this.
REPEATS = 3
#: Sources of under FEW blocks get points from a sequence FAR times as long as the schedule.
FEW, FAR = 8, 16
_PHI = 0.6180339887498949
_CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(base.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), repeats: int = REPEATS) -> DataFrame:
    """sizes (source, size) -> sid, source, source_size, target: one row per source.

    Sources in order of code points, null last, take the weights in turn and share the sum of all
    sizes by weight; a target stops at `repeats` times its source's size and the excess goes to the
    others by weight.  That is target = min(repeats * size, level * weight), where level is the largest
    of (total - caps before k) / (weights from k on), k running in order of cap / weight.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    all_rows = Window.partitionBy(F.lit(0))
    before = F.sum("cap").over(by_ratio) - F.col("cap")
    rest = F.sum("weight").over(all_rows) - F.sum("weight").over(by_ratio) + F.col("weight")
    s = s.withColumn("level", (F.sum("source_size").over(all_rows) - before) / rest)
    level = F.max("level").over(all_rows)
    return s.select("sid", "source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def _places(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (doc_id, source, size) with sid, source_size, target, bucket, place and start on the source's line."""
    named = sources.select("sid", "source_size", "target", F.coalesce("source", F.lit("")).alias("__name"), F.col("source").isNull().alias("__none"))
    keyed = rows.withColumn("__name", F.coalesce("source", F.lit(""))).withColumn("__none", F.col("source").isNull())
    r = keyed.join(named, ["__name", "__none"]).drop("__name", "__none")
    h = F.xxhash64(F.coalesce("doc_id", "mark", F.lit(0)), F.lit("mix"))
    r = r.withColumn("__h", h).withColumn("bucket", F.pmod("__h", F.lit(BUCKETS)).cast("int"))
    sums = r.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    first = sums.select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("__first"))
    within = Window.partitionBy("sid", "bucket").orderBy("__h", "doc_id", "size", "mark")
    r = r.withColumn("place", F.row_number().over(within)).withColumn("__run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.join(first, ["sid", "bucket"])
    return r.withColumn("start", F.col("__first") + F.col("__run") - F.col("size")).drop("__h", "__run", "__first")


def schedule(sources: DataFrame, total: int, block: int) -> DataFrame:
    """slot, sid, rank: the order in which blocks of sources are read; about total / block rows.

    A source's slots are the first points of the sequence that fall on it, as many as its target has
    blocks, so no slot belongs to two.  Shares come out so evenly that about total / block points
    suffice; the sequence is followed twice as far, and for sources of under FEW blocks FAR times as
    far.  A source whose target is a small part of one block may still get no slot.
    """
    spark = sources.sparkSession
    n = -(-total // block) if total else 0
    upto = Window.orderBy("sid")
    cuts = sources.select("sid", F.ceil(F.round("target") / block).cast("long").alias("blocks"), (F.sum("target").over(upto) / F.sum("target").over(Window.partitionBy(F.lit(0)))).alias("high"))
    cuts = cuts.select("sid", "blocks", F.coalesce(F.lag("high").over(upto), F.lit(0.0)).alias("low"), "high").where("high > low")
    cell = lambda x: F.least(F.floor(x * _CELLS), F.lit(_CELLS - 1))
    cuts = cuts.select("sid", "blocks", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))

    def mapped(first: int, last: int, onto: DataFrame) -> DataFrame:
        point = F.col("id") * F.lit(_PHI)
        points = spark.range(first, last).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("x")).withColumn("cell", cell(F.col("x")))
        return points.join(onto, "cell").where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select("slot", "sid", "blocks")

    all_ = mapped(0, 2 * n, cuts).union(mapped(2 * n, FAR * n, cuts.where(F.col("blocks") < FEW)))
    ranked = all_.withColumn("rank", (F.row_number().over(Window.partitionBy("sid").orderBy("slot")) - 1).cast("long"))
    return ranked.where(F.col("rank") < F.col("blocks")).select("slot", "sid", "rank")


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", weights: tuple[float, ...] = (1.0, 2.0, 3.0), slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents) of the mix.

    pieces: slot, sid, rank, doc_id, epoch, first, last - which words of which document a slot reads
    (slot and epoch are null for a document that no slot reads).  documents: doc_id, size, source_size,
    target, taken, source, first_slot and n_slots (of the slots that read it) for every row of docs.

    Nulls: a null text has size 0; null sources are one source, last in order; rows without an id are
    shuffled by a hash of their text.  Rows that repeat an id are separate documents.  A source of size 0 has target 0.  No
    rows: no rows.  Reruns agree: the order depends on ids and sizes alone.
    """
    mark = F.when(F.col(id_col).isNull(), F.xxhash64(text)).alias("mark")
    thin = base.materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col(text)).alias("size"), mark), "sizes")
    sources = base.materialize(targets(thin.select("source", "size"), weights), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = max(1, -(-total // slots))
    slot = schedule(sources, total, block)
    placed = _places(thin, sources)
    want = F.round("target").cast("long")
    epochs = F.when(F.col("size") > 0, F.filter(F.transform(F.sequence(F.lit(0), F.lit(REPEATS - 1)), lambda e: F.struct(e.alias("epoch"), (F.col("start") + e * F.col("source_size")).alias("at"))), lambda e: e["at"] < F.round(F.col("target")).cast("long")))
    laid = placed.select("*", F.explode_outer(epochs).alias("e"))
    end = F.least(F.col("e.at") + F.col("size"), want)
    ranks = F.when(F.col("e").isNotNull(), F.sequence(F.floor(F.col("e.at") / block), F.floor((end - 1) / block)))
    laid = laid.select("*", F.explode_outer(ranks).alias("rank"))
    low, high = F.greatest(F.col("e.at"), F.col("rank") * block), F.least(end, (F.col("rank") + 1) * block)
    pieces = laid.select("doc_id", "source", "size", "source_size", "target", "sid", "bucket", "place", "rank", F.col("e.epoch").alias("epoch"), (low - F.col("e.at")).alias("first"), (high - F.col("e.at")).alias("last"))
    pieces = pieces.join(slot, ["sid", "rank"], "left")
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("last") - F.col("first"))), F.lit(0)).cast("long")
    documents = pieces.groupBy("sid", "bucket", "place", "doc_id", "source", "size", "source_size", "target").agg(taken.alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_slots"))
    return (
        pieces.select("slot", "sid", "rank", "doc_id", "epoch", "first", "last"),
        documents.select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "n_slots"),
    )
