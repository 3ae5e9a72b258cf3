"""Summaries of file versions as they arrive.

The stream drops keys it has seen within its watermark, and each micro-batch
anti-joins the cache on disk, so the state stays as small as the watermark
while keys of any age stay unique.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourcelake.operators.structure import extract_structure
from sourcelake.operators.summaries import summarize
from sourcelake.sources.cache import missing

#: Folders that keys fall into by hash, so that a batch reads those of its own keys only.
BUCKETS = 64
_SCHEMA = "key string, summary string, batch_id bigint, bucket int"


def read_batches(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache with the batch each entry came in; empty if there is none yet."""
    try:
        return spark.read.schema(_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if not missing(e):
            raise
        return spark.createDataFrame([], _SCHEMA)


def append_new(cache_path: str):
    """``foreachBatch`` body: write the batch's unseen keys as one partition.

    The partition is named by the batch and overwritten, and the anti-join
    leaves that partition out, so a batch run again gives the same table.  Of
    the cache only the buckets of the batch's keys are read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
        keyed = batch.select("key", "summary", bucket.alias("bucket")).dropDuplicates(["key"]).persist()
        buckets = [r.bucket for r in keyed.select("bucket").distinct().collect()]
        known = read_batches(batch.sparkSession, cache_path).where((F.col("batch_id") != batch_id) & F.col("bucket").isin(buckets))
        fresh = keyed.join(known.select("key"), "key", "left_anti")
        fresh.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{cache_path}/batch_id={batch_id}")
        keyed.unpersist()

    return write


def incremental_summaries(
    summarized: DataFrame, cache_path: str, checkpoint: str, *, watermark: tuple[str, str] | None = None
) -> StreamingQuery:
    """Start a query that adds the summaries of a stream of ``(key, summary)`` to
    the cache and stops when the input is used up.  ``watermark`` is an
    ``(event time column, delay)`` bounding the deduplication state."""
    if watermark:
        summarized = summarized.withWatermark(*watermark).dropDuplicatesWithinWatermark(["key"])
    return (
        summarized.writeStream.foreachBatch(append_new(cache_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def summarize_stream(files: DataFrame) -> DataFrame:
    """``(key, summary)`` of a streaming ``files`` table; map-only."""
    return summarize(extract_structure(files)).select("key", "summary")
