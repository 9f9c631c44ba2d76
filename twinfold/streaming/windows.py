"""Streams of events: windowed counts with a watermark; the text expressions work on streams unchanged."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.session import scratch_dir

QUERIES, SQL = {}, {}


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(hour, event_type, n, total): events per hour and type. On a stream, events later than ``late`` are left out."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def events_per_hour(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream, run to its end; its last state goes to a table."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    out = f"{scratch_dir(spark)}/twinfold-{uuid.uuid4().hex}"

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/state")

    stream = spark.readStream.schema(schema).parquet(_folder(path))
    q = hourly(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    t = spark.read.parquet(f"{out}/state")
    return t.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def _folder(path: str) -> str:
    """A stream source reads a folder or a pattern; a single file is given as a pattern that only it fits."""
    return path.replace("events.parquet", "event[s].parquet")


QUERIES["events_per_hour"] = events_per_hour
SQL["events_per_hour"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
