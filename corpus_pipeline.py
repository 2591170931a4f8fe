"""A training-data pipeline: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, mixing, quality_classifier, simhash, substring_dedup
from folioflow.llm.base import materialize, read, remove, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more, learned from all labels of these documents.

    A null text scores as one without words, repeated rows score alike; without labels every score is
    a half and all stay.  No rows: no rows.
    """
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest id, of texts under one id that of the smallest hash.

    Rows without an id come after all others of their group and are judged by their text.  Rows that
    repeat both id and text are one document, and one of them stays.  No rows: no rows.
    """
    rows = materialize(simhash.classes(docs).select("doc_id", "text_hash", "keeper_id", "keeper_hash"), "judged")
    kept = F.col("doc_id").eqNullSafe(F.col("keeper_id")) & F.col("text_hash").eqNullSafe(F.col("keeper_hash"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["__id"]) & a["__hash"].eqNullSafe(b["__text"])
    names = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct()
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    gone = materialize(names(rows.where(~kept)), "gone")
    left = hashed.join(gone, same(hashed, gone), "left_anti")
    again = materialize(names(rows.where(kept).groupBy("doc_id", "text_hash").count().where("count > 1")), "again")
    if again.limit(1).count():
        repeated = left.join(again, same(left, again), "left_semi").dropDuplicates(["doc_id", "__hash"])
        left = left.join(again, same(left, again), "left_anti").unionByName(repeated)
    return left.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that a document of a smaller id has; others as they were.

    A null text stays null, a null id counts as the largest; rows under one id do not judge each other.
    """
    rest = ("lang", "source")
    out = substring_dedup.dedup(docs, carry=rest).withColumnRenamed("kept_text", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, literal or re-parameterised.

    A null or empty text holds none; without a benchmark all stay.
    """
    return decontaminate.annotate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), literal=True).where(F.size("hits") == 0).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it; null sources are one source, a null text has size 0."""
    return mixing.mix(docs)[1].select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: Learned scores and XXH64 fingerprints have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage wrote for itself, and its input, go when its result is written."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), name)
        remove(spark, before + made[:-1])
        before = made[-1:]
    return docs
