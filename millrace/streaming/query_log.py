"""The query log as a stream: hourly tiers, late rows, repeated queries and promotion by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "query_id string, ts timestamp, query string, answered_by string, confidence double, latency_ms double"


def read_log(spark: SparkSession, path: str, schema: str = LOG, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def tiers_by_window(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and mean latency of each window and tier; state older than the watermark is dropped."""
    return (
        log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "answered_by").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("latency_ms_mean"))
        .select(F.col("w.start").alias("hour"), "answered_by", "n", "latency_ms_mean")
    )


def first_of_each(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Without later rows of the same query id within the watermark."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["query_id"])


def run_batches(log: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each micro-batch to ``handle``; with ``once`` what is there is worked off and the query ends."""
    writer = log.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to Parquet; work off what is there."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
