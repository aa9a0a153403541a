"""Rows of photos as they are shown and looked up, and what stages write into them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from photonlake.functions.columns import hex64
from photonlake.operators import search

#: The columns that stages read and write.
NARROW = (
    "photo_id", "library_id", "relative_path", "original_filename", "file_size_bytes", "file_modified_at", "detected_format", "width", "height", "orientation", "captured_at", "captured_at_source",
    "latitude", "longitude", "camera_make", "camera_model", "metadata_extracted_at", "state", "last_error", "created_at", "updated_at",
)
#: The columns of a photo as it is shown, before its groups.
SHOWN = (
    "photo_id", "library_id", "relative_path", "original_filename", "file_size_bytes", "detected_format", "state", "width", "height", "orientation", "camera_make", "camera_model", "captured_at", "captured_at_source",
    "latitude", "longitude", "sharpness_score", "exposure_score", "contrast_score", "resolution_score", "quality_score", "quality_flags", "sha256", "phash",
)
#: What a stage writes, and when it did; those of a failed stage become null, but for scores.
MARKERS = {"metadata": "metadata_extracted_at", "hash": "hashed_at", "phash": "phashed_at", "quality": "quality_analyzed_at", "thumbnail": "thumbnailed_at"}
METADATA = ("width", "height", "orientation", "captured_at", "captured_at_source", "latitude", "longitude", "camera_make", "camera_model", "state", "last_error")
SCORES = ("sharpness_score", "exposure_score", "contrast_score", "resolution_score", "quality_score", "raw_laplacian_variance", "mean_luminance", "shadow_clipping", "highlight_clipping", "quality_flags")
THUMBNAIL = ("thumbnail_width", "thumbnail_height", "thumbnail_bytes")


def narrow(photos: DataFrame) -> DataFrame:
    return photos.select(*NARROW)


def view(photos: DataFrame, duplicate_members: DataFrame, similar_members: DataFrame, event_members: DataFrame) -> DataFrame:
    """The 30 columns of a photo as it is shown; the members are (photo_id, group_id).

    A group's id is joined from one row for each photo, so that no photo comes twice; null where it has no group.
    """
    rows = photos
    for members, name in ((duplicate_members, "duplicate_group_id"), (similar_members, "similar_group_id"), (event_members, "cluster_id")):
        rows = rows.join(members.groupBy("photo_id").agg(F.min(F.col("group_id").cast("string")).alias(name)), "photo_id", "left")
    shown = [hex64(F.col("phash")).alias("phash") if c == "phash" else F.col(c) for c in SHOWN]
    return rows.select(*shown, "duplicate_group_id", "similar_group_id", "cluster_id", "thumbnail_width", "thumbnail_height", "last_error")


def lookup(rows: DataFrame, value: object, key: str = "photo_id") -> DataFrame:
    """The row with an id; an error if there is none."""
    found = rows.where(F.col(key) == value)
    if found.isEmpty():
        raise LookupError("not found")
    return found


def thumbnail_made_at(photos: DataFrame, value: object) -> DataFrame:
    """When a photo's thumbnail was made; an error if there is no such photo or it has none."""
    return lookup(photos.where("thumbnailed_at is not null and thumbnail_width is not null"), value).select("thumbnailed_at")


def detail(photos: DataFrame, value: object, duplicate_members: DataFrame, similar_members: DataFrame, event_members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the photo as it is shown, what it shares a group with in order); members as :func:`search.relations` takes them."""
    one = lookup(photos, value)
    groups = (
        duplicate_members.select("photo_id", F.concat_ws("/", "library_id", "sha256").alias("group_id")),
        similar_members.select("photo_id", "group_id"),
        event_members.select("photo_id", F.concat_ws("/", "library_id", "segment", "part").alias("group_id")),
    )
    related = search.relations(photos, one.select("photo_id"), duplicate_members, similar_members, event_members)
    return view(one, *groups), search.in_order(related)


def missing_a_stage(photos: DataFrame) -> DataFrame:
    """Photos that didn't fail and still lack a stage."""
    lacking = F.lit(False)
    for marker in MARKERS.values():
        lacking |= F.col(marker).isNull()
    return photos.where((F.col("state") != "failed") & lacking)


def _write(photos: DataFrame, results: DataFrame, columns: Sequence[str], marker: str, now: object, error: Column, **own: Column) -> DataFrame:
    """``photos`` with the columns that ``results`` (photo_id, ...) brings for some of them; others stay as they are."""
    new = results.select("photo_id", *(F.col(c).alias(f"new_{c}") for c in results.columns if c != "photo_id"), F.lit(True).alias("hit"))
    joined = photos.join(new, "photo_id", "left")
    values = {c: F.col(f"new_{c}") for c in columns} | {"last_error": error, marker: F.lit(now)} | own
    kinds = {c: photos.schema[c].dataType for c in values}
    typed = {c: v if isinstance(kinds[c], ArrayType) else v.cast(kinds[c]) for c, v in values.items()}
    return joined.withColumns({c: F.when(F.col("hit"), v).otherwise(F.col(c)) for c, v in typed.items()}).select(*photos.columns)


def _first_error() -> Column:
    return F.coalesce("new_last_error", "last_error")


def set_metadata(photos: DataFrame, results: DataFrame, now: object) -> DataFrame:
    """After extraction: all of METADATA is overwritten, nulls included; a known format stays where none was detected."""
    return _write(photos, results, METADATA, MARKERS["metadata"], now, F.col("new_last_error"), detected_format=F.coalesce("new_detected_format", "detected_format"))


def set_hash(photos: DataFrame, results: DataFrame, now: object) -> DataFrame:
    """After hashing (photo_id, sha256, last_error): the mark is set on failure, too, so that it isn't tried for ever."""
    return _write(photos, results, ("sha256",), MARKERS["hash"], now, _first_error())


def set_phash(photos: DataFrame, results: DataFrame, now: object) -> DataFrame:
    return _write(photos, results, ("phash",), MARKERS["phash"], now, _first_error())


def set_quality(photos: DataFrame, results: DataFrame, now: object) -> DataFrame:
    return _write(photos, results, SCORES, MARKERS["quality"], now, F.col("last_error"))


def set_thumbnail(photos: DataFrame, results: DataFrame, now: object) -> DataFrame:
    return _write(photos, results, THUMBNAIL, MARKERS["thumbnail"], now, F.col("last_error"))


def mark_failed(photos: DataFrame, stage: str, results: DataFrame, now: object) -> DataFrame:
    """After a stage that couldn't run for (photo_id, last_error): marked as done, its measurements null, never 0."""
    columns = {"phash": ("phash",), "quality": SCORES, "thumbnail": THUMBNAIL}[stage]
    empty = {c: F.array().cast("array<string>") if c == "quality_flags" else F.lit(None) for c in columns}
    return _write(photos, results, (), MARKERS[stage], now, F.col("new_last_error"), **empty)


def mark_missing(photos: DataFrame, gone: DataFrame, now: object) -> DataFrame:
    """After a stage found no file any more for (photo_id, last_error): missing, without derived metadata."""
    empty = {c: F.lit(None) for c in METADATA if c not in ("state", "last_error")}
    return _write(photos, gone, (), MARKERS["metadata"], now, F.col("new_last_error"), state=F.lit("missing"), **empty)
