"""The evidence log as a stream: the latest record of each key, kept up as lines arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import evidence


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of JSON records (line_no, value) as files of them arrive."""
    return spark.readStream.schema("line_no long, value string").json(folder)


def latest(lines: DataFrame) -> DataFrame:
    found = evidence(lines)
    last = found.groupBy("smoke_key").agg(F.max_by(F.struct(*[c for c in found.columns if c != "smoke_key"]), "line_no").alias("e"))
    return last.select("smoke_key", "e.*")


def windowed_counts(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events of each type by tumbling windows of ts; those later than `delay` are dropped by the watermark."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select("window.start", "window.end", "event_type", "n", "total")


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
