"""What the corpus operators share: scratch tables, lookups that stand hot keys, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pattern of a word, as Java and Python read it.
WORD = r"[^\x20\x09-\x0D]+"
#: Groups that a lookup broadcasts.  At most this many rows, whatever the input's size; every other
#: group then holds at most one part in HOT_GROUPS of all rows.
HOT_GROUPS = 1000


#: Bits of a bitmap: a fixed size, whatever the input's.
BITS = 1 << 25
_scratch: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    Where it is unset, a local master gets a temporary folder of its own; any other master is refused,
    since executors would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _scratch:
        made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that outlive any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Collects the scratch paths made inside; remove(spark, paths) deletes them when no result needs them."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch.remove(made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables.  Results that still read them must be written first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def bit_of(*keys: str | Column) -> Column:
    """The bit that a key has in a bitmap."""
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def bitmap(bits: DataFrame) -> np.ndarray:
    """The set of a one-column table of bit_of() numbers, as BITS bits in 64-bit words.

    A test by it lets every member pass, and of the others as many as share a bit with one.  Its size
    is fixed, so it may be broadcast; with very many members it lets all pass, which costs time alone.
    """
    b = bits.select(F.col(bits.columns[0]).alias("b"))
    words = b.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(BITS >> 6, dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, bits: pa.Array) -> np.ndarray:
    b = bits.to_numpy(zero_copy_only=False)
    return ((words[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def lookup(left: DataFrame, groups: DataFrame, key: str, size: str, row_id: Column) -> DataFrame:
    """Left join `groups` (one row per key, `size` rows of `left` each) to `left`; no key is hot.

    The HOT_GROUPS largest groups are broadcast; a row that found its group there, or has a null key,
    is dealt by its own id.  Any other group holds at most one part in HOT_GROUPS of all rows; where
    that is still much, the adaptive join splits its partition, since `groups` is a plain table.
    """
    values = [c for c in groups.columns if c not in (key, size)]
    kinds = dict(groups.dtypes)
    hot = groups.where(F.col(key).isNotNull()).orderBy(F.col(size).desc(), key).limit(HOT_GROUPS)
    hot = hot.select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__hot_{c}") for c in values])
    found = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    settled = F.col("__hot").isNotNull() | F.col(key).isNull()
    found = found.withColumn("__cold", F.when(~settled, F.col(key))).withColumn("__deal", F.when(settled, row_id))
    cold = groups.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__cold_key"), *[F.col(c).alias(f"__cold_{c}") for c in values]
    )
    kind = kinds[key]
    found = found.withColumn("__on", F.coalesce(F.concat(F.lit("k"), F.col("__cold").cast("string")), F.concat(F.lit("r"), F.col("__deal").cast("string"))))
    cold = cold.withColumn("__on_cold", F.concat(F.lit("k"), F.col("__cold_key").cast("string"))).drop("__cold_key")
    assert kind in ("bigint", "string", "int"), kind
    joined = found.join(cold, F.col("__on") == F.col("__on_cold"), "left")
    return joined.select(*left.columns, *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in values])


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def columns_of(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def other_columns(df: DataFrame, *replaced: str) -> tuple[list[str], DataFrame]:
    """Names of df's columns but those named as one of `replaced`, in any case; df of these, as c0, c1, ...

    Arrow maps can't take every name (dots, equal but for case); toDF gives the names back.
    """
    gone = {c.lower() for c in replaced}
    names = [c for c in df.columns if c.lower() not in gone]
    return names, df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"c{k}") for k, c in enumerate(names)])


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
