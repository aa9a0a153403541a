"""Streams: files as they arrive, and events by gaps in time with late photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.functions.columns import format_of

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """Supported files that appear below ``root``, each once, hashed as they come."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(root)
    supported = files.where(format_of(F.col("path")).isNotNull())
    return supported.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"))


def time_events(photos: DataFrame, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """Events by gaps alone, closed when no photo can come that would still join them; neighbours exactly a gap apart join."""
    dated = photos.where("captured_at is not null").withWatermark("captured_at", late)
    return dated.groupBy("library_id", F.session_window("captured_at", gap)).agg(F.count(F.lit(1)).alias("photo_count"), F.min("captured_at").alias("started_at"), F.max("captured_at").alias("ended_at")).drop("session_window")
