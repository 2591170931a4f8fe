"""A stream of arriving files through the same stateless transform; each batch is planned and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..conf import EngineConf
from ..plans.budget import assemble
from ..sources.ingest import extract, sections_of
from ..sources.sniff import extension, sniff


def stream_documents(spark: SparkSession, source: str, sink: str, checkpoint: str, budget: int | None = None) -> StreamingQuery:
    """Start a query that turns files new below `source` into Parquet below `sink`, then stops (availableNow)."""
    conf = EngineConf.of(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(source)
    named = files.where(F.col("length").between(1, conf.input_bytes)).select(F.col("path").alias("doc_id"), "content", sniff(F.col("content"), extension(F.col("path"))).alias("fmt"))

    def write(batch: DataFrame, number: int) -> None:
        out = assemble(sections_of(extract(batch, conf)), budget or conf.budget_tokens)
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
