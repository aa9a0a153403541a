"""Byte-identical files: groups, the copy to keep, members and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.config import clamp_limit
from photonlake.functions.columns import path_depth


def keep_order() -> Column:
    """The copy to keep is the least: shallow, then short, then first by path."""
    path = F.col("relative_path")
    return F.struct(path_depth(path).alias("depth"), F.length(path).alias("length"), path.alias("path"), F.col("photo_id").alias("id"))


def usable(photos: DataFrame) -> DataFrame:
    return photos.where("state <> 'missing' and sha256 is not null")


def groups(photos: DataFrame, by: tuple[str, ...] = ("library_id",)) -> DataFrame:
    """One row per content with two copies or more; sums and the keeper are combined before the shuffle."""
    made = usable(photos).groupBy(*by, "sha256").agg(
        F.count(F.lit(1)).alias("photo_count"),
        F.sum("file_size_bytes").alias("total_bytes"),
        F.min("file_size_bytes").alias("one"),
        F.min(keep_order()).alias("keep"),
    )
    return made.where("photo_count > 1").select(*by, "sha256", "photo_count", "total_bytes", (F.col("total_bytes") - F.col("one")).alias("reclaimable_bytes"), F.col("keep.id").alias("suggested_keep_photo_id"))


def members(photos: DataFrame, made: DataFrame, by: tuple[str, ...] = ("library_id",)) -> DataFrame:
    own = usable(photos).join(made.select(*by, "sha256", "suggested_keep_photo_id"), [*by, "sha256"])
    return own.select(*by, "sha256", "photo_id", "relative_path", "file_size_bytes", (F.col("photo_id") == F.col("suggested_keep_photo_id")).alias("suggested_keep"))


def listing(photos: DataFrame, made: DataFrame, limit: int = 50, offset: int = 0, by: tuple[str, ...] = ("library_id",)) -> DataFrame:
    """A page of groups, most reclaimable first, each with its members by path."""
    page = made.orderBy(F.desc("reclaimable_bytes"), "sha256", *by).offset(max(offset, 0)).limit(clamp_limit(limit, 50, 200))
    nested = members(photos, page, by).groupBy(*by, "sha256").agg(F.array_sort(F.collect_list(F.struct("relative_path", "photo_id", "file_size_bytes", "suggested_keep"))).alias("members"))
    return page.join(nested, [*by, "sha256"])


def summary(photos: DataFrame, made: DataFrame) -> DataFrame:
    """One row: hashed and unhashed files, groups, their files, bytes to reclaim."""
    counts = photos.agg(F.count_if(F.col("hashed_at").isNotNull()).alias("hashed"), F.count_if(F.col("hashed_at").isNull() & (F.col("state") != "missing")).alias("to_hash"))
    return counts.crossJoin(F.broadcast(made.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("photo_count"), F.lit(0)).alias("photos"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"))))
