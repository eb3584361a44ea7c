"""Streams of tiles and of annotation events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_new(spark: SparkSession, source: str, schema: str, target: str, state: str, keep=lambda df: df) -> StreamingQuery:
    """Writes what arrives in a folder of Parquet to another, once, after `keep`; a restart continues from `state`."""
    arriving = spark.readStream.schema(schema).parquet(source)
    return keep(arriving).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, label: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, label, n): events of each window and label; state is held until the watermark has passed. Works on tables too."""
    timed = events.withColumn("_at", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("_at", window).alias("w"), F.col(label).alias("label")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "label", "n")
