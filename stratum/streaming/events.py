"""Structured Streaming over event tables: windows with watermarks, and stateless bucket rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(stream: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum of each window; rows later than the watermark are left out and closed windows leave the state."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Exactly-once files: the checkpoint names the batches that are done."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (q.trigger(availableNow=True) if once else q).start(path)
