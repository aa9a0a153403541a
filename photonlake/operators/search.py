"""Filters, sorting, paging, summaries and relations of photos."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.config import FLAGS, SORTS, STATES, clamp_limit
from photonlake.functions.columns import escape_like, located


@dataclass(frozen=True)
class Query:
    """What a search asks for; None means no condition."""

    library: object | None = None
    state: str | None = None
    flag: str | None = None
    taken_from: datetime | None = None
    taken_to: datetime | None = None
    text: str | None = None
    has_gps: bool | None = None
    has_flags: bool | None = None
    duplicate: bool | None = None
    similar: bool | None = None
    sort: str = "path"
    descending: bool = False
    limit: int = 100
    offset: int = 0


def parse_bool(text: str | None) -> bool | None:
    if text is None or text == "":
        return None
    if text in ("true", "1", "yes"):
        return True
    if text in ("false", "0", "no"):
        return False
    raise ValueError(f"not a yes or no: {text}")


def parse_time(text: str | None) -> datetime | None:
    """RFC 3339, or a date, which means its midnight in UTC: as an upper bound it excludes the day itself."""
    if not text:
        return None
    if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        return datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=timezone.utc)
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", text):
        raise ValueError(f"not a time: {text}")
    return datetime.fromisoformat(text)


def parse(params: dict[str, str]) -> Query:
    """A query from request parameters; a bad value is an error, never an empty result."""
    known = {"library", "state", "flag", "from", "to", "q", "has_gps", "has_flags", "duplicate", "similar", "sort", "order", "limit", "offset"}
    if set(params) - known:
        raise ValueError(f"unknown: {sorted(set(params) - known)}")
    for name, allowed in (("state", STATES), ("flag", FLAGS), ("sort", SORTS), ("order", ("asc", "desc"))):
        if params.get(name) and params[name] not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    start, end = parse_time(params.get("from")), parse_time(params.get("to"))
    if start and end and end < start:
        raise ValueError("to is before from")
    limit = clamp_limit(int(params.get("limit") or 0), 100, 500)
    return Query(
        params.get("library"), params.get("state") or None, params.get("flag") or None, start, end, params.get("q") or None, *(parse_bool(params.get(n)) for n in ("has_gps", "has_flags", "duplicate", "similar")),
        sort=params.get("sort") or "path", descending=params.get("order") == "desc", limit=limit, offset=max(int(params.get("offset") or 0), 0),
    )


def _time(value: datetime) -> Column:
    """A moment, or a time without a zone where the value has none."""
    return F.lit(value) if value.tzinfo else F.to_timestamp_ntz(F.lit(value.isoformat(sep=" ")))


def predicate(q: Query) -> Column:
    """The conditions on a photo's own columns, shared by page and total."""
    c = F.lit(True)
    if q.library is not None:
        c &= F.col("library_id") == q.library
    if q.state is not None:
        c &= F.col("state") == q.state
    if q.flag is not None:
        c &= F.array_contains("quality_flags", q.flag)
    if q.taken_from is not None:
        c &= F.col("captured_at") >= _time(q.taken_from)
    if q.taken_to is not None:
        c &= F.col("captured_at") <= _time(q.taken_to)
    if q.text is not None:
        c &= F.col("relative_path").ilike(f"%{escape_like(q.text)}%")
    if q.has_gps is not None:
        place = located(F.col("latitude"), F.col("longitude"))
        c &= place if q.has_gps else ~place
    if q.has_flags is not None:
        c &= (F.size("quality_flags") > 0) == q.has_flags
    return c


def matching(photos: DataFrame, q: Query, duplicate_members: DataFrame | None = None, similar_members: DataFrame | None = None) -> DataFrame:
    rows = photos.where(predicate(q))
    for wanted, members in ((q.duplicate, duplicate_members), (q.similar, similar_members)):
        if wanted is not None:
            rows = rows.join(members.select("photo_id").distinct(), "photo_id", "left_semi" if wanted else "left_anti")
    return rows


def ordering(q: Query) -> list[Column]:
    """Total orders, nulls last in both directions, ties by id."""
    column = F.col({"path": "relative_path", "captured_at": "captured_at", "file_size": "file_size_bytes", "quality": "quality_score", "created_at": "created_seconds"}[q.sort])
    return [column.desc_nulls_last() if q.descending else column.asc_nulls_last(), F.col("photo_id").asc()]


def page(rows: DataFrame, q: Query) -> DataFrame:
    return rows.orderBy(*ordering(q)).offset(q.offset).limit(q.limit)


def search(photos: DataFrame, q: Query, duplicate_members: DataFrame | None = None, similar_members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the page, one row with the total)."""
    rows = matching(photos, q, duplicate_members, similar_members)
    return page(rows, q), rows.agg(F.count(F.lit(1)).alias("total"))


def keyset(rows: DataFrame, after: object | None, limit: int) -> DataFrame:
    """The next rows by id after a cursor."""
    rows = rows if after is None else rows.where(F.col("photo_id") > after)
    return rows.orderBy("photo_id").limit(clamp_limit(limit, 1000, 10_000))


STAGES = ("metadata", "hash", "phash", "quality", "thumbnail")


def _needs(stage: str) -> Column:
    marker = {"metadata": "metadata_extracted_at", "hash": "hashed_at", "phash": "phashed_at", "quality": "quality_analyzed_at", "thumbnail": "thumbnailed_at"}[stage]
    states = {"metadata": F.lit(True), "hash": F.col("state") != "missing"}.get(stage, ~F.col("state").isin("missing", "failed"))
    return F.col(marker).isNull() & states


def needing(photos: DataFrame, stage: str) -> DataFrame:
    """Photos a stage has still to measure."""
    return photos.where(_needs(stage))


def needing_counts(photos: DataFrame) -> DataFrame:
    """One row: all photos, and how many each stage has still to measure, in one pass."""
    return photos.agg(F.count(F.lit(1)).alias("photos"), *(F.count_if(_needs(stage)).alias(stage) for stage in STAGES))


def work_list(photos: DataFrame, stage: str, limit: int = 500) -> DataFrame:
    """The next photos a stage has still to measure, by id."""
    return needing(photos, stage).orderBy("photo_id").limit(clamp_limit(limit, 500, 5000))


def metadata_summary(photos: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    source = F.col("captured_at_source")
    return photos.agg(
        F.count(F.lit(1)).alias("total"),
        n(F.col("metadata_extracted_at").isNotNull(), "extracted"),
        n(F.col("metadata_extracted_at").isNull(), "pending"),
        n(source == "exif", "dated_by_camera"),
        n(source == "filesystem", "dated_by_file"),
        n(F.col("captured_at").isNull(), "undated"),
        n(F.col("latitude").isNotNull(), "with_gps"),
        n(F.col("state") == "failed", "failed"),
    )


def quality_summary(photos: DataFrame) -> DataFrame:
    return photos.agg(
        F.count_if(F.col("quality_score").isNotNull()).alias("analyzed"),
        F.count_if(F.size("quality_flags") > 0).alias("flagged"),
        F.count_if(F.col("quality_score").isNull() & ~F.col("state").isin("missing", "failed")).alias("pending"),
        F.round(F.avg("quality_score"), 6).alias("mean_quality"),
    )


def flag_counts(photos: DataFrame) -> DataFrame:
    """How many photos have each flag, the most frequent first."""
    return photos.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "flag")


def flag_map(photos: DataFrame) -> DataFrame:
    """One row: by_flag, from a flag to its number of photos, as JSON."""
    each = flag_counts(photos).select(F.struct("flag", "n").alias("e"))
    return each.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list("e")))).alias("by_flag"))


def flagged(photos: DataFrame, flag: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    if flag is not None and flag not in FLAGS:
        raise ValueError(f"unknown flag: {flag}")
    rows = photos.where(F.size("quality_flags") > 0) if flag is None else photos.where(F.array_contains("quality_flags", flag))
    return rows.orderBy(F.col("quality_score").asc_nulls_last(), "relative_path", "photo_id").offset(max(offset, 0)).limit(clamp_limit(limit, 100, 500))


def relations(photos: DataFrame, me: DataFrame, duplicate_members: DataFrame, similar_members: DataFrame, event_members: DataFrame) -> DataFrame:
    """(of, kind, place, photo_id, distance, suggested_keep, is_self, ...): what the photos ``me`` (photo_id) share a group with.

    ``place`` orders a kind, ties by path: duplicates by whether they are the copy to keep, others by rank or sequence.
    """
    asked = me.select(F.col("photo_id").alias("of"))

    def beside(rows: DataFrame, key: list[str], kind: str, distance: Column, keep: Column, place: Column) -> DataFrame:
        own = rows.join(asked, F.col("photo_id") == F.col("of")).select("of", *key)
        return rows.join(own, key).select("of", F.lit(kind).alias("kind"), place.cast("long").alias("place"), "photo_id", distance.cast("double").alias("distance"), keep.alias("suggested_keep"), (F.col("photo_id") == F.col("of")).alias("is_self"))

    keep = F.col("suggested_keep")
    found = beside(duplicate_members, ["library_id", "sha256"], "duplicate", F.lit(None), keep, F.when(keep, 0).otherwise(1))
    found = found.unionByName(beside(similar_members, ["group_id"], "similar", F.col("distance"), F.col("rank") == 1, F.col("rank")))
    found = found.unionByName(beside(event_members, ["library_id", "segment", "part"], "event", F.col("distance_meters"), F.lit(False), F.col("sequence")))
    return found.join(photos.select("photo_id", "relative_path", "file_size_bytes", "width", "height", "quality_score"), "photo_id")


def in_order(related: DataFrame) -> DataFrame:
    """Relations as they are shown: duplicates, similar ones, then the event, each by place and path."""
    kind = F.when(F.col("kind") == "duplicate", 0).when(F.col("kind") == "similar", 1).otherwise(2)
    return related.orderBy("of", kind, "place", "relative_path", "photo_id")


def new_files(discovered: DataFrame, known: DataFrame) -> DataFrame:
    """Discovered files that the library doesn't know yet; known ones are left as they are."""
    return discovered.dropDuplicates(["library_id", "relative_path"]).join(known, ["library_id", "relative_path"], "left_anti")
