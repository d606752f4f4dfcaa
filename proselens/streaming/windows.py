"""Extension: event windows, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def scan_stream(spark: SparkSession, source: str, schema: str, transform, sink: str, checkpoint: str) -> StreamingQuery:
    """New files of a folder through a stateless transform, appended once each to Parquet."""
    stream = spark.readStream.schema(schema).parquet(source)
    return transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
