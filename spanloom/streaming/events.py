"""Windows and sessions over an event stream; an extension, with the same results as over the table at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """(beg, event_type, n, users) by tumbling windows; on a stream, rows later than `late` go and windows come out when they are over."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users") if events.isStreaming else F.countDistinct("user_id").alias("users"))
    return g.select(F.col("w.start").alias("beg"), "event_type", "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    """(user_id, beg, end, n): a user's events with less than `gap` between them; `end` is the gap after the last one."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("beg"), F.col("w.end").alias("end"), "n")


def replayed(spark: SparkSession, path: str, name: str, build, mode: str = "complete") -> DataFrame:
    """The result of a streaming query over all files of a folder, kept in memory; for checks against the table at rest."""
    schema = spark.read.parquet(path).schema
    stream = build(spark.readStream.schema(schema).parquet(path))
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
