"""The whole analysis of a folder as one plan: features of each file, then groups, events and summaries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.graph import cut, replace
from photonlake.operators import duplicates, events, images, search, similar
from photonlake.sources import scan


class Analysis(NamedTuple):
    photos: DataFrame
    duplicate_groups: DataFrame
    duplicate_members: DataFrame
    similar_groups: DataFrame
    similar_members: DataFrame
    clusters: DataFrame
    cluster_members: DataFrame


def photos(spark: SparkSession, root: str, library_id: str = "library", entries: DataFrame | None = None) -> DataFrame:
    """One row per supported file with all features; each is null where it couldn't be measured, never 0.

    Spark's listing follows links and leaves out empty files; with the ``entries`` of a walk, exactly the files found
    there count.
    """
    listed = scan.listing(spark, root, library_id).select("library_id", "relative_path", "path")
    if entries is not None:
        listed = listed.join(scan.found(entries).select("relative_path"), "relative_path", "left_semi")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).join(listed.select("path"), "path", "left_semi")
    read = files.withColumns({"sha256": F.sha2("content", 256), "file_size_bytes": F.octet_length("content").cast("long"), "file_modified_at": F.col("modificationTime")})
    meta = images.metadata(read, keep=("sha256", "file_size_bytes", "file_modified_at"))
    pixels = images.measured(images.pictures(spark, root), "path").drop("width", "height")
    joined = listed.join(meta, "path").join(pixels, "path", "left")
    # Decoders fill up what a broken-off file lacks; nothing was measured there.
    whole, error = F.col("complete"), F.col("last_error")
    broken = F.when(error.isNull(), images.BROKEN_OFF).otherwise(F.concat_ws("; ", error, F.lit(images.BROKEN_OFF)))
    joined = joined.withColumns({c: F.when(whole, F.col(c)) for c in pixels.columns if c not in ("path", "quality_flags")} | {"quality_flags": F.when(whole, F.col("quality_flags")), "last_error": F.when(whole | (F.col("state") == "failed"), error).otherwise(broken)}).drop("complete")
    if entries is not None:
        empty = scan.found(entries).where("file_size_bytes = 0").select(F.lit(library_id).alias("library_id"), "relative_path", "file_size_bytes", "file_modified_at")
        known = {"sha256": F.sha2(F.lit("").cast("binary"), 256), "state": F.lit("failed"), "last_error": F.lit(images.NO_IMAGE)}
        joined = joined.unionByName(empty.withColumns(known), allowMissingColumns=True)
    done = F.current_timestamp()
    return joined.withColumns(
        {
            "photo_id": F.left(F.sha2(F.concat_ws("\n", "library_id", "relative_path"), 256), F.lit(32)),
            "quality_flags": F.coalesce("quality_flags", F.array().cast("array<string>")),
            "original_filename": F.substring_index("relative_path", "/", -1),
            "hashed_at": done,
            "metadata_extracted_at": done,
            **{c: F.lit(None).cast("int") for c in ("thumbnail_width", "thumbnail_height", "thumbnail_bytes")},
            "created_seconds": F.lit(0).cast("long"),
        }
    ).drop("path")


def marked(rows: DataFrame, now: object) -> DataFrame:
    """``rows`` of :func:`photos` with the marks of the stages that need pixels; thumbnails are still to be made."""
    done = F.when(F.col("state") != "failed", F.lit(now).cast("timestamp"))
    return rows.withColumns({"phashed_at": done, "quality_analyzed_at": done, "thumbnailed_at": F.lit(None).cast("timestamp")})


def run(spark: SparkSession, root: str, library_id: str = "library", threshold: int = 0, gap_seconds: float = 0, radius_metres: float = 0, entries: DataFrame | None = None) -> Analysis:
    """Everything about the photos of a folder; running it again gives the same rows."""
    rows = cut(photos(spark, root, library_id, entries))
    dup = duplicates.groups(rows)
    sim, sim_members = similar.groups(similar.candidates(rows), threshold)
    placed = cut(events.members(rows.where("state not in ('missing', 'failed')"), gap_seconds, radius_metres))
    return Analysis(rows, dup, duplicates.members(rows, dup), sim, sim_members, events.clusters(placed, gap_seconds, radius_metres), placed)


def store(a: Analysis, folder: str) -> None:
    """Write all tables of an analysis below a folder, each in place of an older one as a whole."""
    for name, table in a._asdict().items():
        replace(table, f"{folder.rstrip('/')}/{name}.parquet")


def overview(a: Analysis) -> dict[str, DataFrame]:
    """The five summaries of a library."""
    return {
        "metadata": search.metadata_summary(a.photos),
        "duplicates": duplicates.summary(a.photos, a.duplicate_groups),
        "similar": similar.summary(a.photos, a.similar_groups),
        "quality": search.quality_summary(a.photos),
        "events": events.summary(a.photos, a.clusters),
    }
