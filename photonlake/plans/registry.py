"""Queries over the photo-shaped views, each with SQL for DuckDB that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.functions import columns as C
from photonlake.functions import display as D
from photonlake.functions import json as J
from photonlake.operators import duplicates, events, images, ledger, search, similar, workers
from photonlake.operators import photos as shown
from photonlake.operators.search import Query
from photonlake.sources import tables as t
from photonlake.streaming import incremental

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}
ALL = ()
THRESHOLD = 18


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def _photos(*ctes: str) -> str:
    return "with recursive " + ",\n".join(x.strip() for x in (t.PHOTOS_SQL, *ctes)) + "\n"


DEPTH = "length(relative_path) - length(replace(relative_path, '/', ''))"
KEEP = f"{DEPTH}, length(relative_path), relative_path, photo_id"


def _dup(by: str = "") -> str:
    key = f"{by}sha256"
    return f"""
ranked as (select *, count(*) over (partition by {key}) as n, row_number() over (partition by {key} order by {KEEP}) as k from photos where state <> 'missing' and sha256 is not null),
dup as (select {key}, count(*) as photo_count, sum(file_size_bytes)::bigint as total_bytes, (sum(file_size_bytes) - min(file_size_bytes))::bigint as reclaimable_bytes,
  min(case when k = 1 then photo_id end) as suggested_keep_photo_id from ranked where n > 1 group by all),
dup_members as (select r.*, r.k = 1 as suggested_keep from ranked r where n > 1)"""


# Exact duplicates, all sources as one library, and by library.
@query("exact_duplicate_groups", _photos(_dup()) + "select * from dup")
def _(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.groups(t.photos(spark, d), ALL)


@query("exact_duplicate_groups_by_library", _photos(_dup("library_id, ")) + "select * from dup")
def _(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.groups(t.photos(spark, d))


@query("exact_duplicate_members", _photos(_dup()) + "select sha256, photo_id, relative_path, file_size_bytes, suggested_keep from dup_members")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.photos(spark, d)
    return duplicates.members(p, duplicates.groups(p, ALL), ALL)


@query(
    "exact_duplicate_listing",
    _photos(_dup()) + "select dup.*, array_to_string(list(m.photo_id || ':' || m.relative_path order by m.relative_path), ';') as members from (select * from dup order by reclaimable_bytes desc, sha256 limit 20) dup join dup_members m using (sha256) group by all",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.photos(spark, d)
    rows = duplicates.listing(p, duplicates.groups(p, ALL), limit=20, by=ALL)
    return rows.withColumn("members", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["photo_id"], m["relative_path"])), ";"))


@query("duplicates_summary", _photos(_dup()) + "select (select count(*) from photos where hashed_at is not null) as hashed, (select count(*) from photos where hashed_at is null and state <> 'missing') as to_hash, count(*) as groups, coalesce(sum(photo_count), 0)::bigint as photos, coalesce(sum(reclaimable_bytes), 0)::bigint as reclaimable_bytes from dup")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.photos(spark, d)
    return duplicates.summary(p, duplicates.groups(p, ALL))


# Near-duplicates.
CANDIDATES = f"""
cand as (select * exclude (k), width::bigint * height as pixels from (select *, row_number() over (partition by coalesce(sha256, 'id:' || photo_id) order by {KEEP}) as k
  from photos where phash is not null and state <> 'missing') where k = 1)"""
SIMILAR = (
    CANDIDATES
    + f""",
arcs as (select a.photo_id as a, b.photo_id as b from cand a join cand b on a.photo_id <> b.photo_id and bit_count(xor(a.phash, b.phash))::int <= {THRESHOLD}),
reach as (select a as node, a as other from arcs union select r.node, arcs.b from reach r join arcs on arcs.a = r.other),
roots as (select node as photo_id, min(other) as group_id from reach group by node),
own as (select c.*, group_id from cand c join roots using (photo_id)),
fights as (select a.group_id, a.photo_id, bit_count(xor(a.phash, b.phash))::int as apart,
    case when a.quality_score is not null and b.quality_score is not null and abs(a.quality_score - b.quality_score) > 0.02 then b.quality_score > a.quality_score
    else (-b.pixels, -b.file_size_bytes, length(b.relative_path) - length(replace(b.relative_path, '/', '')), length(b.relative_path), b.relative_path, b.photo_id)
       < (-a.pixels, -a.file_size_bytes, length(a.relative_path) - length(replace(a.relative_path, '/', '')), length(a.relative_path), a.relative_path, a.photo_id) end as lost
  from own a join own b on a.group_id = b.group_id and a.photo_id <> b.photo_id),
beaten as (select photo_id, count(*) filter (lost) as losses, max(apart) as widest from fights group by photo_id),
placed as (select o.*, losses, widest, row_number() over (partition by group_id order by losses, -pixels, -file_size_bytes, {KEEP}) as rank from own o join beaten using (photo_id)),
kept as (select group_id, photo_id as suggested_keep_photo_id, phash as keep_hash, file_size_bytes as keep_bytes from placed where rank = 1),
sim_members as (select p.*, suggested_keep_photo_id, keep_bytes, bit_count(xor(phash, keep_hash))::int as distance from placed p join kept using (group_id)),
sim as (select group_id, suggested_keep_photo_id, count(*) as photo_count, {THRESHOLD} as threshold, max(widest) as max_distance, greatest(sum(file_size_bytes) - max(keep_bytes), 0)::bigint as reclaimable_bytes from sim_members group by all)"""
)


def _similar(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    return similar.groups(similar.candidates(p, ALL), THRESHOLD, ALL)


@query("similar_candidates", _photos(CANDIDATES) + "select photo_id, relative_path, file_size_bytes, pixels, quality_score from cand")
def _(spark: SparkSession, d: str) -> DataFrame:
    return similar.candidates(t.photos(spark, d), ALL).select("photo_id", "relative_path", "file_size_bytes", "pixels", "quality_score")


@query("hamming_pairs", _photos(CANDIDATES) + f"select least(x, y) as hash_a, greatest(x, y) as hash_b, max(apart) as distance from (select lpad(lower(to_hex(a.phash)), 16, '0') as x, lpad(lower(to_hex(b.phash)), 16, '0') as y, bit_count(xor(a.phash, b.phash))::int as apart from cand a join cand b on a.phash < b.phash and bit_count(xor(a.phash, b.phash))::int <= {THRESHOLD}) group by 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = similar.pairs(similar.candidates(t.photos(spark, d), ALL), THRESHOLD, ALL)
    a, b = C.hex64(F.col("hash_a")), C.hex64(F.col("hash_b"))
    return rows.select(F.least(a, b).alias("hash_a"), F.greatest(a, b).alias("hash_b"), "distance")


@query("similar_groups", _photos(SIMILAR) + "select * from sim")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _similar(t.photos(spark, d))[0]


@query("similar_members", _photos(SIMILAR) + "select group_id, photo_id, relative_path, distance, rank::int as rank from sim_members")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _similar(t.photos(spark, d))[1]


@query("similar_listing", _photos(SIMILAR) + "select s.*, max_distance > threshold as chained, array_to_string(list(m.photo_id order by m.rank), ';') as members from (select * from sim order by photo_count desc, reclaimable_bytes desc, group_id limit 10) s join sim_members m using (group_id) group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = similar.listing(*_similar(t.photos(spark, d)), limit=10)
    return rows.withColumn("members", F.array_join(F.transform("members", lambda m: m["photo_id"].cast("string")), ";"))


@query("similar_summary", _photos(SIMILAR) + "select (select count(*) from photos where phash is not null) as hashed, (select count(*) from photos where phash is null and state not in ('missing', 'failed')) as to_hash, count(*) as groups, coalesce(sum(photo_count), 0)::bigint as photos, coalesce(sum(reclaimable_bytes), 0)::bigint as reclaimable_bytes, count(*) filter (max_distance > threshold) as chained from sim")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.photos(spark, d)
    return similar.summary(p, _similar(p)[0])


# Events.
GAP, RADIUS = 6 * 3600.0, 9000.0
METRES = "2 * 6371008.8 * atan2(sqrt({a}), sqrt(greatest(1 - {a}, 0)))"


def _metres(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    return METRES.format(a=a)


TIMES = f"""
dated as (select *, row_number() over w as rn, case when epoch_us(captured_at) - lag(epoch_us(captured_at)) over w > {GAP} * 1e6 then 1 else 0 end as cut from points where captured_at is not null
  window w as (partition by library_id order by captured_at, photo_id)),
segments as (select * exclude (cut), sum(cut) over (partition by library_id order by rn)::bigint as segment from dated)"""
FOLD = (
    TIMES
    + f""",
placed as (select *, row_number() over (partition by library_id, segment order by rn) as i from segments),
fold as (
  select library_id, segment, i, photo_id, captured_at, captured_at_source, latitude as lat, longitude as lon, 0::bigint as part, 1::bigint as sequence, latitude as alat, longitude as alon, case when latitude is not null then 0.0::double end as metres from placed where i = 1
  union all
  select library_id, segment, i, photo_id, captured_at, captured_at_source, lat, lon, part + cut, case when cut = 1 then 1 else sequence + 1 end, case when cut = 1 or alat is null then lat else alat end, case when cut = 1 or alat is null then lon else alon end,
    case when lat is null then null when cut = 1 or alat is null then 0.0 else m end
  from (select p.library_id, p.segment, p.i, p.photo_id, p.captured_at, p.captured_at_source, p.latitude as lat, p.longitude as lon, f.part, f.sequence, f.alat, f.alon,
      {_metres("f.alat", "f.alon", "p.latitude", "p.longitude")} as m, case when {_metres("f.alat", "f.alon", "p.latitude", "p.longitude")} > {RADIUS} then 1 else 0 end as cut
    from fold f join placed p on p.library_id = f.library_id and p.segment = f.segment and p.i = f.i + 1)),
clusters as (select library_id, segment, part, count(*) as photo_count, min(captured_at) as started_at, max(captured_at) as ended_at, round(max(alat), 6) as anchor_latitude, round(max(alon), 6) as anchor_longitude,
  round(coalesce(max(metres), 0), 3) as max_distance_meters, count(metres) as located_count, count(*) filter (captured_at_source = 'filesystem') as filesystem_dated_count from fold group by library_id, segment, part)"""
)
_POINTS = "with recursive " + t.POINTS_SQL.strip() + ",\n"


def _members(spark: SparkSession, d: str) -> DataFrame:
    return events.members(t.points(spark, d), GAP, RADIUS)


def _rounded(made: DataFrame) -> DataFrame:
    return made.withColumns({"anchor_latitude": F.round("anchor_latitude", 6), "anchor_longitude": F.round("anchor_longitude", 6), "max_distance_meters": F.round("max_distance_meters", 3)}).drop("max_gap_seconds", "max_radius_meters")


@query("event_time_gaps", _POINTS + TIMES.strip() + " select library_id, photo_id, segment from segments")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events.time_segments(t.points(spark, d), GAP).select("library_id", "photo_id", "segment")


@query("event_members", _POINTS + FOLD.strip() + " select library_id, segment, part, sequence, photo_id, round(metres, 3) as distance_meters from fold")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).select("library_id", "segment", "part", "sequence", "photo_id", F.round("distance_meters", 3).alias("distance_meters"))


@query("event_segments", _POINTS + FOLD.strip() + " select *, case when filesystem_dated_count = 0 then 'high' when filesystem_dated_count = photo_count then 'low' else 'mixed' end as confidence from clusters")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(events.clusters(_members(spark, d), GAP, RADIUS))


@query("event_summary", _POINTS + FOLD.strip() + " select count(*) as clusters, sum(photo_count)::bigint as clustered, sum(located_count)::bigint as located, count(*) filter (filesystem_dated_count = photo_count) as low_confidence, max(photo_count) as largest, (select count(*) from points where captured_at is null) as undated from clusters")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events.summary(t.points(spark, d), events.clusters(_members(spark, d), GAP, RADIUS))


@query("event_listing", _POINTS + FOLD.strip() + " select c.library_id, c.segment, c.part, c.photo_count, array_to_string(list(f.photo_id order by f.sequence), ';') as members from (select * from clusters order by started_at desc, library_id, segment, part limit 100) c join fold f on f.library_id = c.library_id and f.segment = c.segment and f.part = c.part group by all")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _members(spark, d)
    found = events.listing(events.clusters(rows, GAP, RADIUS), rows)
    return found.select("library_id", "segment", "part", "photo_count", F.array_join(F.transform("members", lambda m: m["photo_id"].cast("string")), ";").alias("members"))


@query("event_day_changes", _POINTS.rstrip().rstrip(",") + " select library_id, photo_id, coalesce(lag(captured_at::date) over w <> captured_at::date, true) as new_day from points where captured_at is not null window w as (partition by library_id order by captured_at, photo_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events.day_changes(t.points(spark, d))


@query("haversine_pairs", _POINTS + f"near as (select photo_id, latitude, longitude, lag(latitude) over w as plat, lag(longitude) over w as plon from points where latitude is not null window w as (partition by library_id order by photo_id)) select photo_id, round({_metres('plat', 'plon', 'latitude', 'longitude')}, 3) as metres from near where plat is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("library_id").orderBy("photo_id")
    rows = t.points(spark, d).where("latitude is not null").withColumns({"plat": F.lag("latitude").over(order), "plon": F.lag("longitude").over(order)}).where("plat is not null")
    return rows.select("photo_id", F.round(C.haversine(*map(F.col, ("plat", "plon", "latitude", "longitude"))), 3).alias("metres"))


# Search: the page of each query, with the place of each row, and the totals.
SEARCHES = {
    "path": (Query(), "true", "relative_path"),
    "page2": (Query(limit=50, offset=50), "true", "relative_path"),
    "quality_desc": (Query(sort="quality", descending=True), "true", "quality_score desc"),
    "captured": (Query(sort="captured_at"), "true", "captured_at"),
    "size_desc": (Query(sort="file_size", descending=True, limit=500), "true", "file_size_bytes desc"),
    "created": (Query(sort="created_at"), "true", "created_seconds"),
    "library": (Query(library="src3"), "library_id = 'src3'", "relative_path"),
    "state": (Query(state="missing"), "state = 'missing'", "relative_path"),
    "flag": (Query(flag="low_resolution"), "list_contains(quality_flags, 'low_resolution')", "relative_path"),
    "range": (Query(taken_from=datetime(2024, 1, 1, 12), taken_to=datetime(2024, 1, 2)), "captured_at >= timestamp '2024-01-01 12:00:00' and captured_at <= timestamp '2024-01-02'", "relative_path"),
    "ilike": (Query(text="EN/src1_"), "relative_path ilike '%EN/src1\\_%' escape '\\'", "relative_path"),
    "gps_true": (Query(has_gps=True), "latitude is not null and longitude is not null", "relative_path"),
    "gps_false": (Query(has_gps=False), "latitude is null or longitude is null", "relative_path"),
    "flags_true": (Query(has_flags=True), "len(quality_flags) > 0", "relative_path"),
    "flags_false": (Query(has_flags=False), "len(quality_flags) = 0", "relative_path"),
    "dup_true": (Query(duplicate=True), "photo_id in (select photo_id from dup_members)", "relative_path"),
    "dup_false": (Query(duplicate=False), "photo_id not in (select photo_id from dup_members)", "relative_path"),
    "sim_true": (Query(similar=True), "photo_id in (select photo_id from sim_members)", "relative_path"),
    "sim_false": (Query(similar=False), "photo_id not in (select photo_id from sim_members)", "relative_path"),
}


def _search(q: Query) -> Run:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = t.photos(spark, d)
        dup = duplicates.members(p, duplicates.groups(p, ALL), ALL) if q.duplicate is not None else None
        sim = _similar(p)[1] if q.similar is not None else None
        rows, total = search.search(p, q, dup, sim)
        return rows.select("photo_id", "relative_path", "state", "quality_score", F.array_join("quality_flags", ",").alias("flags"), C.hex64(F.col("phash")).alias("phash_hex")).crossJoin(F.broadcast(total))

    return run


for _name, (_q, _where, _order) in SEARCHES.items():
    _parts = [_dup()] if "dup_members" in _where else [SIMILAR] if "sim_members" in _where else []
    query(
        f"photo_search_{_name}",
        _photos(*_parts) + f"select photo_id, relative_path, state, quality_score, array_to_string(quality_flags, ',') as flags, lpad(lower(to_hex(phash)), 16, '0') as phash_hex, (select count(*) from photos where {_where}) as total from photos where {_where} order by {_order} nulls last, photo_id limit {_q.limit} offset {_q.offset}",
    )(_search(_q))


# Summaries and work lists.
@query("metadata_summary", _photos() + "select count(*) as total, count(metadata_extracted_at) as extracted, count(*) filter (metadata_extracted_at is null) as pending, count(*) filter (captured_at_source = 'exif') as dated_by_camera, count(*) filter (captured_at_source = 'filesystem') as dated_by_file, count(*) filter (captured_at is null) as undated, count(latitude) as with_gps, count(*) filter (state = 'failed') as failed from photos")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.metadata_summary(t.photos(spark, d))


@query("quality_summary", _photos() + "select count(quality_score) as analyzed, count(*) filter (len(quality_flags) > 0) as flagged, count(*) filter (quality_score is null and state not in ('missing', 'failed')) as pending, round(avg(quality_score), 6) as mean_quality from photos")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.quality_summary(t.photos(spark, d))


@query("flag_counts", _photos() + "select flag, count(*) as n from (select unnest(quality_flags) as flag from photos) group by flag")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.flag_counts(t.photos(spark, d))


@query("photos_by_state", _photos() + "select state, count(*) as n from photos group by state")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.photos(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("flagged_photos", _photos() + "select photo_id, relative_path, quality_score from photos where len(quality_flags) > 0 order by quality_score nulls last, relative_path, photo_id limit 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.flagged(t.photos(spark, d)).select("photo_id", "relative_path", "quality_score")


for _stage, _condition in {"metadata": "metadata_extracted_at is null", "hash": "hashed_at is null and state <> 'missing'", "phash": "phashed_at is null and state not in ('missing', 'failed')", "quality": "quality_analyzed_at is null and state not in ('missing', 'failed')", "thumbnail": "thumbnailed_at is null and state not in ('missing', 'failed')"}.items():
    query(f"needs_work_{_stage}", _photos() + f"select photo_id, relative_path from photos where {_condition}")(lambda spark, d, stage=_stage: search.needing(t.photos(spark, d), stage).select("photo_id", "relative_path"))


@query("keyset_page", _photos() + "select photo_id, relative_path from photos where photo_id > 100 order by photo_id limit 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.keyset(t.photos(spark, d), 100, 50).select("photo_id", "relative_path")


@query(
    "photo_relations",
    _photos(
        _dup(),
        SIMILAR.replace("placed as", "sim_placed as").replace("from placed", "from sim_placed"),
        "points as (select photo_id, 'all' as library_id, captured_at, captured_at_source, latitude, longitude from photos)",
        FOLD.strip(),
        "me as (select photo_id as seeker from photos where photo_id % 20 = 0)",
        """found as (
  select seeker, 'duplicate' as kind, case when m.suggested_keep then 0 else 1 end as place, m.photo_id, null::double as distance, m.suggested_keep from me join dup_members s on s.photo_id = seeker join dup_members m on m.sha256 = s.sha256
  union all select seeker, 'similar', m.rank, m.photo_id, m.distance::double, m.rank = 1 from me join sim_members s on s.photo_id = seeker join sim_members m on m.group_id = s.group_id
  union all select seeker, 'event', m.sequence, m.photo_id, m.metres, false from me join fold s on s.photo_id = seeker join fold m on m.segment = s.segment and m.part = s.part)""",
    )
    + 'select seeker as "of", kind, place::bigint as place, photo_id, round(distance, 3) as distance, suggested_keep, photo_id = seeker as is_self, relative_path, file_size_bytes, width, height, quality_score from found join photos using (photo_id)',
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.photos(spark, d)
    dup = duplicates.members(p, duplicates.groups(p, ALL), ALL).withColumn("library_id", F.lit("all"))
    event = events.members(p.withColumn("library_id", F.lit("all")), GAP, RADIUS)
    found = search.relations(p, p.where("photo_id % 20 = 0"), dup, _similar(p)[1], event)
    return found.withColumn("distance", F.round("distance", 3))


@query("rescan_inserts", _photos() + "select library_id, relative_path from photos union select library_id, 'new/' || photo_id || '.jpg' from photos except select library_id, relative_path from photos")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.photos(spark, d)
    seen = p.select("library_id", "relative_path")
    fresh = p.select("library_id", F.concat(F.lit("new/"), F.col("photo_id"), F.lit(".jpg")).alias("relative_path"))
    return search.new_files(seen.union(fresh), p.select("library_id", "relative_path"))


# The ledger.
_JOBS = "with " + t.JOBS_SQL.strip()
_BOTH = _JOBS + ",\n" + t.EXECUTIONS_SQL.strip()


@query("job_counts_by_type", _JOBS + "select job_type, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'running') as running, count(*) filter (status = 'succeeded') as succeeded, count(*) filter (status = 'dead') as dead, count(*) as total from jobs group by job_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger.counts_by_type(t.jobs(spark, d))


@query("job_outstanding", _JOBS + "select job_type, count(*) as n from jobs where status in ('pending', 'running') group by job_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger.outstanding(t.jobs(spark, d))


@query("stage_latency", _BOTH + "select job_type, count(*) as n, round(quantile_cont(duration_ms, 0.5), 1) as p50, round(quantile_cont(duration_ms, 0.95), 1) as p95, round(avg(duration_ms), 1) as mean from executions join jobs on id = job_id where outcome = 'succeeded' group by job_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger.stage_latency(t.jobs(spark, d), t.executions(spark, d))


@query("deferrals", _BOTH + "select job_type, count(*) as n from executions join jobs on id = job_id where outcome = 'deferred' group by job_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger.deferrals(t.jobs(spark, d), t.executions(spark, d))


def _now() -> Column:
    """A time without a zone, as the tables have them."""
    return F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))


_WORK = _JOBS + ",\n" + t.WORKERS_SQL.strip()
HELD = "(select count(*) from jobs where status = 'running' and leased_by = worker_id)"


@query("worker_running", _JOBS + "select w as worker_id, (select count(*) from jobs where status = 'running' and leased_by = w) as running from range(10) r(w)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return workers.running(spark.range(10).withColumnRenamed("id", "worker_id"), t.jobs(spark, d))


@query("worker_listing", _WORK + f" select worker_id, hostname, status, slots, last_heartbeat_at, {HELD} as running from workers")
def _(spark: SparkSession, d: str) -> DataFrame:
    return workers.listing(t.workers(spark, d), t.jobs(spark, d)).select("worker_id", "hostname", "status", "slots", "last_heartbeat_at", "running")


@query("worker_rollup", _WORK + f" select count(*) as workers, count(*) filter (status = 'active') as active, coalesce(sum(slots) filter (status = 'active'), 0)::bigint as slots, coalesce(sum({HELD}), 0)::bigint as running from workers")
def _(spark: SparkSession, d: str) -> DataFrame:
    return workers.rollup(t.workers(spark, d), t.jobs(spark, d))


@query("worker_reap", _WORK + " select worker_id, case when status = 'active' and last_heartbeat_at < timestamp '1995-12-31 23:59:45' then 'dead' else status end as status, case when status = 'active' and last_heartbeat_at < timestamp '1995-12-31 23:59:45' then timestamp '1996-01-01' else stopped_at end as stopped_at from workers")
def _(spark: SparkSession, d: str) -> DataFrame:
    return workers.reap(t.workers(spark, d), _now()).select("worker_id", "status", "stopped_at")


@query("worker_purge", _WORK + f" select worker_id, status from workers where not (status in ('stopped', 'dead') and stopped_at < timestamp '1995-12-31 23:59:40' and {HELD} = 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return workers.purge(t.workers(spark, d), t.jobs(spark, d), _now(), 20).select("worker_id", "status")


@query("worker_victim", _WORK + " select worker_id, hostname, count(*) as running from jobs join workers on worker_id = leased_by where jobs.status = 'running' group by worker_id, hostname order by running desc, worker_id limit 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return workers.victim(t.workers(spark, d), t.jobs(spark, d))


@query("job_counts", _JOBS + " select count(*) filter (status = 'pending') as pending, count(*) filter (status = 'running') as running, count(*) filter (status = 'succeeded') as succeeded, count(*) filter (status = 'dead') as dead, count(*) as total from jobs where library_id = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger.counts(t.jobs(spark, d), 1)


_TYPES = "select job_type, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'running') as running, count(*) filter (status = 'succeeded') as succeeded, count(*) filter (status = 'dead') as dead, count(*) as total from jobs group by job_type"


@query("job_counts_map", _JOBS + f""" select '{{' || string_agg('"' || job_type || '":{{"pending":' || pending || ',"running":' || running || ',"succeeded":' || succeeded || ',"dead":' || dead || ',"total":' || total || '}}', ',' order by job_type) || '}}' as by_type from ({_TYPES})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger.counts_map(t.jobs(spark, d))


@query("duration_spread", _BOTH + " select worker_id, count(duration_ms) as n, median(duration_ms) as median, min(duration_ms) as least, max(duration_ms) as greatest from executions group by worker_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger.spread(t.executions(spark, d), "duration_ms", "worker_id")


@query("recovery_pairs", _BOTH + "select x.job_id, x.attempt, min(case when y.started_at > x.started_at then y.started_at end) as taken_up_at, count(*) filter (y.outcome = 'succeeded') as succeeded_elsewhere, status from executions x join jobs on id = x.job_id left join executions y on y.job_id = x.job_id and y.worker_id <> 3 where x.worker_id = 3 and x.outcome = 'abandoned' group by x.job_id, x.attempt, status")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger.recoveries(t.jobs(spark, d), t.executions(spark, d), 3)


@query("job_enqueue_dedupe", _JOBS + "select distinct o_orderpriority as job_type, o_custkey as target_id from orders except select job_type, target_id from jobs where status in ('pending', 'running')")
def _(spark: SparkSession, d: str) -> DataFrame:
    wanted = t.table(spark, d, "orders").select(F.col("o_orderpriority").alias("job_type"), F.col("o_custkey").alias("target_id"))
    return ledger.enqueue(t.jobs(spark, d), wanted)


_NOW_SQL = "timestamp '1996-01-01'"


_HELD = "status = 'running' and leased_by = 3"
_WAIT = "least(300.0::double, 2 * pow(2, greatest(attempt_count, 1) - 1))"


_UNSET = {"leased_by": -1, "lease_expires_at": "1970-01-01 00:00:00", "started_at": "1970-01-01 00:00:00", "completed_at": "1970-01-01 00:00:00", "last_error": ""}
_UNSET_SQL = {c: f"timestamp '{v}'" if c.endswith("_at") else repr(v) for c, v in _UNSET.items()}


def _job(rows: DataFrame) -> DataFrame:
    """The columns that transitions change; what is unset by a value that all engines show alike."""
    unset = {c: F.coalesce(F.col(c), F.lit(v).cast(rows.schema[c].dataType)) for c, v in _UNSET.items()}
    return rows.withColumns(unset).select("id", "status", "leased_by", "lease_expires_at", "attempt_count", "next_attempt_at", "started_at", "completed_at", "last_error")


def _changed(where: str, rest: str = "", **to: str) -> str:
    kept = ("status", "leased_by", "lease_expires_at", "attempt_count", "next_attempt_at", "started_at", "completed_at", "last_error")
    return _JOBS + " select id, " + ", ".join(f"coalesce({to.get(c, c)}, {_UNSET_SQL[c]}) as {c}" if c in _UNSET else f"{to.get(c, c)} as {c}" for c in kept) + f" from jobs where {where} {rest}"


_FREE = {"leased_by": "null::bigint", "lease_expires_at": "null::timestamp"}
_OVER = "attempt_count >= max_attempts"


@query("job_claim_topk", _changed(f"status = 'pending' and next_attempt_at <= {_NOW_SQL}", "order by priority, id limit 25", status="'running'", leased_by="3::bigint", lease_expires_at=f"{_NOW_SQL} + interval 60 second", attempt_count="attempt_count + 1", started_at=f"coalesce(started_at, {_NOW_SQL})"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _job(ledger.claim(t.jobs(spark, d), 3, 25, _now()))


@query("job_complete_transition", _changed(_HELD, status="'succeeded'", **_FREE, completed_at=_NOW_SQL, last_error="null::varchar"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _job(ledger.complete(t.jobs(spark, d), 3, _now()))


_RETRY = f"case when {_OVER} then next_attempt_at else {_NOW_SQL} + to_microseconds(({_WAIT} * 1000000)::bigint) end"


@query("job_fail_transition", _changed(_HELD, status=f"case when {_OVER} then 'dead' else 'pending' end", **_FREE, next_attempt_at=_RETRY, completed_at=f"case when {_OVER} then {_NOW_SQL} end", last_error="'broken'"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _job(ledger.fail(t.jobs(spark, d), 3, _now(), "broken"))


@query("job_fail_permanently", _changed(_HELD, status="'dead'", **_FREE, completed_at=_NOW_SQL, last_error="'not an image'"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _job(ledger.fail(t.jobs(spark, d), 3, _now(), "not an image", permanent=True))


@query("job_defer_transition", _changed(_HELD, status="'pending'", **_FREE, attempt_count="greatest(attempt_count - 1, 0)", next_attempt_at=f"{_NOW_SQL} + interval 2 second", last_error="'hashing first'"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _job(ledger.defer(t.jobs(spark, d), 3, _now(), 2, "hashing first"))


@query("job_renew_leases", _changed(_HELD, lease_expires_at=f"{_NOW_SQL} + interval 60 second"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _job(ledger.renew(t.jobs(spark, d), 3, _now()))


@query("job_release_leases", _changed(_HELD, status="'pending'", **_FREE, next_attempt_at=_NOW_SQL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _job(ledger.release(t.jobs(spark, d), 3, _now()))


_LOST = f"status = 'running' and lease_expires_at < {_NOW_SQL}"


@query(
    "job_reap_transition",
    _changed(_LOST, status=f"case when {_OVER} then 'dead' else 'pending' end", **_FREE, next_attempt_at=f"case when {_OVER} then next_attempt_at else {_NOW_SQL} + interval 2 second end", completed_at=f"case when {_OVER} then {_NOW_SQL} end", last_error="'lease expired: worker stopped responding (attempt ' || attempt_count || ' of ' || max_attempts || ')'"),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _job(ledger.reap(t.jobs(spark, d), _now(), 2))


@query("job_reap_counts", _JOBS + f" select count(*) filter (not ({_OVER})) as requeued, count(*) filter ({_OVER}) as died from jobs where {_LOST}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ledger.reaped_counts(ledger.reap(t.jobs(spark, d), _now()))


@query("job_reap_executions", _BOTH + f" select job_id, attempt, {_NOW_SQL} as finished_at, 'abandoned' as outcome, 'lease expired' as error from executions where finished_at is null and job_id in (select id from jobs where {_LOST})")
def _(spark: SparkSession, d: str) -> DataFrame:
    closed = ledger.reaped_executions(t.executions(spark, d), ledger.reap(t.jobs(spark, d), _now()), _now())
    return closed.select("job_id", "attempt", "finished_at", "outcome", "error")


@query("job_ledger_after_claim", _JOBS + f", chosen as (select id from jobs where status = 'pending' and next_attempt_at <= {_NOW_SQL} order by priority, id limit 25) select status, count(*) as n, sum(attempt_count)::bigint as attempts from (select case when id in (from chosen) then 'running' else status end as status, attempt_count + (id in (from chosen))::int as attempt_count from jobs) group by status")
def _(spark: SparkSession, d: str) -> DataFrame:
    jobs = t.jobs(spark, d)
    return ledger.applied(jobs, ledger.claim(jobs, 3, 25, _now())).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("attempt_count").alias("attempts"))


_NEEDS = {"EXTRACT_METADATA": "metadata_extracted_at is null", "COMPUTE_FILE_HASH": "hashed_at is null and state <> 'missing'", "COMPUTE_PERCEPTUAL_HASH": "phashed_at is null and state not in ('missing', 'failed')", "ANALYZE_QUALITY": "quality_analyzed_at is null and state not in ('missing', 'failed')", "GENERATE_THUMBNAIL": "thumbnailed_at is null and state not in ('missing', 'failed')"}


@query(
    "job_fan_out",
    _photos()
    + " union all ".join(f"select '{kind}' as job_type, 'photo' as target_type, photo_id::varchar as target_id, library_id, 100 as priority, 5 as max_attempts from photos where {needs}" for kind, needs in _NEEDS.items())
    + "".join(f" union all select '{kind}', 'library', library_id, library_id, 200, 5 from (select distinct library_id from photos)" for kind in ledger.LIBRARY_JOBS),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.photos(spark, d)
    return ledger.fan_out(p, p.select("library_id").distinct(), {stage: search.needing(p, stage) for stage in ledger.PHOTO_JOBS})


# Photos as they are shown.
_SHOWN = "p.photo_id, p.library_id, relative_path, original_filename, file_size_bytes, detected_format, state, width, height, orientation, camera_make, camera_model, captured_at, captured_at_source, latitude, longitude, sharpness_score, exposure_score, contrast_score, resolution_score, quality_score"
_VIEW = _photos(_dup(), SIMILAR, "points as (select photo_id, library_id, captured_at, captured_at_source, latitude, longitude from photos where state not in ('missing', 'failed'))", FOLD.strip().replace("placed as", "event_placed as").replace("from placed", "from event_placed").replace("join placed", "join event_placed"))
_VIEW += f"""select {_SHOWN}, array_to_string(quality_flags, ',') as flags, p.sha256, lpad(lower(to_hex(p.phash)), 16, '0') as phash, (select min(m.sha256) from dup_members m where m.photo_id = p.photo_id) as duplicate_group_id, (select min(m.group_id)::varchar from sim_members m where m.photo_id = p.photo_id) as similar_group_id,
  (select min(f.library_id || '/' || f.segment || '/' || f.part) from fold f where f.photo_id = p.photo_id) as cluster_id, coalesce(thumbnail_width, -1) as thumbnail_width, coalesce(thumbnail_height, -1) as thumbnail_height, last_error from photos p"""


def _view(spark: SparkSession, d: str) -> DataFrame:
    p = t.photos(spark, d)
    dup = duplicates.members(p, duplicates.groups(p, ALL), ALL).select("photo_id", F.col("sha256").alias("group_id"))
    event = events.members(p.where("state not in ('missing', 'failed')"), GAP, RADIUS).select("photo_id", F.concat_ws("/", "library_id", "segment", "part").alias("group_id"))
    rows = shown.view(p, dup, _similar(p)[1], event)
    sizes = {c: F.coalesce(F.col(c), F.lit(-1)) for c in ("thumbnail_width", "thumbnail_height")}
    return rows.withColumns({"flags": F.array_join("quality_flags", ","), **sizes}).drop("quality_flags")


@query("photo_view", _VIEW)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d)


@query("photo_lookup", _photos() + "select photo_id, relative_path, state from photos where photo_id = 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown.lookup(t.photos(spark, d), 100).select("photo_id", "relative_path", "state")


@query("photos_missing_a_stage", _photos() + "select photo_id, state from photos where state <> 'failed' and (metadata_extracted_at is null or hashed_at is null or phashed_at is null or quality_analyzed_at is null or thumbnailed_at is null)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return shown.missing_a_stage(t.photos(spark, d)).select("photo_id", "state")


@query("flag_map", _photos() + """select '{' || string_agg('"' || flag || '":' || n, ',' order by flag) || '}' as by_flag from (select flag, count(*) as n from (select unnest(quality_flags) as flag from photos) group by flag)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.flag_map(t.photos(spark, d))


@query("photos_as_json", _photos() + """select photo_id, '{"photo_id":' || photo_id || ',"state":"' || state || '"' || case when camera_make is not null then ',"camera_make":"' || camera_make || '"' else '' end || case when thumbnail_width is not null then ',"thumbnail_width":' || thumbnail_width else '' end || '}' as json from photos""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return J.encoded(t.photos(spark, d).select("photo_id", "state", "camera_make", "thumbnail_width"), "photo_id")


_MARKED = "case when photo_id % 3 = 0 then {} else {} end as {}"


@query(
    "stage_results",
    _photos()
    + "select photo_id, "
    + ", ".join(_MARKED.format(new, old, name) for name, old, new in (("sha256", "sha256", "'abc'"), ("phash", "phash::hugeint::varchar", "null"), ("thumbnail_width", "coalesce(thumbnail_width, -1)", "200"), ("quality_score", "quality_score", "null::double")))
    + f", case when photo_id % 3 = 0 then 'bad pixels' else last_error end as last_error, case when photo_id % 3 = 0 then {_NOW_SQL} else hashed_at end as hashed_at, case when photo_id % 3 = 0 then {_NOW_SQL} else phashed_at end as phashed_at from photos",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.photos(spark, d).withColumn("thumbnail_bytes", F.lit(None).cast("int"))
    for c in ("raw_laplacian_variance", "mean_luminance", "shadow_clipping", "highlight_clipping"):
        p = p.withColumn(c, F.lit(None).cast("double"))
    some = p.where("photo_id % 3 = 0").select("photo_id", F.lit("bad pixels").alias("last_error"))
    p = shown.set_hash(p, some.select("photo_id", F.lit("abc").alias("sha256"), F.lit(None).cast("string").alias("last_error")), _now())
    p = shown.mark_failed(shown.mark_failed(p, "quality", some, _now()), "phash", some, _now())
    p = shown.set_thumbnail(p, some.select("photo_id", F.lit(200).alias("thumbnail_width"), F.lit(100).alias("thumbnail_height"), F.lit(9).alias("thumbnail_bytes")), _now())
    digits = F.when(F.col("phash") < 0, F.col("phash").cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.col("phash").cast("decimal(20,0)"))
    return p.select("photo_id", "sha256", digits.cast("string").alias("phash"), F.coalesce("thumbnail_width", F.lit(-1)).alias("thumbnail_width"), "quality_score", "last_error", "hashed_at", "phashed_at")


@query("backoff_schedule", _JOBS + "select distinct attempt_count, least(300.0::double, 2 * pow(2, least(greatest(attempt_count, 1) - 1, 30))) as wait_seconds, greatest(max_attempts - attempt_count, 0) as attempts_remaining from jobs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.jobs(spark, d).select("attempt_count", C.backoff_seconds(F.col("attempt_count")).alias("wait_seconds"), C.attempts_remaining(F.col("attempt_count"), F.col("max_attempts")).alias("attempts_remaining")).distinct()


# Rules over numbers and texts.
@query(
    "quality_rules",
    """with m as (select l_orderkey, l_linenumber, l_extendedprice / 200 as v, l_quantity * 5 as mean, l_discount * 800 as dev, l_tax as sh, l_discount as hi, 400 + l_partkey % 1600 as w, 300 + l_suppkey % 900 as h from lineitem),
s as (select *, case when v <= 0 then 0 else least(1, sqrt(v / 310)) end as sharp, greatest(0, least(1, 1 - case when mean < 46 then (46 - mean) / 46 when mean > 190 then (mean - 190) / 65 else 0 end - 0.5::double * sh - 0.5::double * hi)) as expo, least(1, dev / 64) as con, least(1, w * h / 2000000.0::double) as res from m)
select l_orderkey, l_linenumber, floor(greatest(0, least(1, 0.45::double * sharp + 0.3::double * expo + 0.15::double * con + 0.1::double * res)) * 1e5::double + 0.5::double)::bigint as quality_score,
  concat_ws(',', case when sharp < 0.12 then 'possibly_blurry' end, case when mean < 46 then 'possibly_underexposed' end, case when mean > 190 then 'possibly_overexposed' end, case when con < 0.1 then 'possibly_low_contrast' end, case when w * h < 307200 then 'low_resolution' end, case when sh > 0.05 then 'shadows_clipped' end, case when hi > 0.05 then 'highlights_clipped' end) as flags from s""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x = t.table(spark, d, "lineitem")
    c = F.col
    scores = C.quality_scores(c("l_extendedprice") / 200, c("l_quantity") * 5, c("l_discount") * 800, c("l_tax"), c("l_discount"), 400 + c("l_partkey") % 1600, 300 + c("l_suppkey") % 900)
    return x.select("l_orderkey", "l_linenumber", F.floor(scores["quality_score"] * 1e5 + 0.5).alias("quality_score"), F.array_join(scores["quality_flags"], ",").alias("flags"))


@query("exif_time_parse", "select event_id, case when event_id % 5 = 0 then null when event_id % 7 = 0 and event_id % 3 <> 0 then null when event_id % 7 = 0 then date_trunc('second', ts) else date_trunc('second', ts) end as taken from events")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events")
    text = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    i = F.col("event_id")
    first = F.when(i % 5 == 0, "0000:00:00 00:00:00").when(i % 7 == 0, "garbage").otherwise(text)
    second = F.when((i % 5 != 0) & (i % 7 == 0) & (i % 3 == 0), text).otherwise("1850:01:01 00:00:00")
    return e.select("event_id", C.exif_time(first, second).alias("taken"))


@query("gps_sanitise", "select event_id, case when ok then lat end as lat, case when ok then lon end as lon from (select event_id, lat, lon, lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0) as ok from (select event_id, case when event_id % 9 = 0 then 0 else value - 20 end as lat, case when event_id % 9 = 0 then 0 when event_id % 10 = 0 then null else value * 3 end as lon from events))")
def _(spark: SparkSession, d: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    lat, lon = F.when(i % 9 == 0, 0.0).otherwise(v - 20), F.when(i % 9 == 0, 0.0).when(i % 10 == 0, None).otherwise(v * 3)
    lat, lon = C.clean_place(lat, lon)
    return t.table(spark, d, "events").select("event_id", lat.alias("lat"), lon.alias("lon"))


@query("orientation_dims", "select p_partkey, case when o between 5 and 8 then h else w end as width, case when o between 5 and 8 then w else h end as height from (select p_partkey, p_size % 10 as o, 100 + p_size as w, 200 + p_size as h from part)")
def _(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    w, h = C.display_size(100 + size, 200 + size, size % 10)
    return t.table(spark, d, "part").select("p_partkey", w.alias("width"), h.alias("height"))


@query(
    "display_texts",
    """select o_orderkey, case when s < 60 then printf('%ds', s) when s < 3600 then printf('%dm', s // 60) when s < 86400 then printf('%dh%02dm', s // 3600, s // 60 % 60) else printf('%dd%02dh', s // 86400, s // 3600 % 24) end as span,
case when b < 1024 then printf('%d B', b) when b < 1048576 then printf('%.1f KB', b / 1024.0::double) when b < 1073741824 then printf('%.1f MB', b / 1048576.0::double) else printf('%.1f GB', b / 1073741824.0::double) end as bytes,
case when o_custkey * 2 < 1000 then printf('%.0fm', o_custkey * 2.0::double) else printf('%.1fkm', o_custkey * 2.0::double / 1000) end as metres,
(length(o_orderpriority || '/' || o_orderstatus) - length(replace(o_orderpriority || '/' || o_orderstatus, '/', '')))::int as depth, o_orderpriority || ':' || o_custkey as dedupe_key
from (select *, o_orderkey * 37 % 200000 as s, o_orderkey * 1000003 % 9000000000 as b from orders)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i, o = F.col("o_orderkey"), t.table(spark, d, "orders")
    return o.select(
        "o_orderkey", C.human_span(i * 37 % 200000).alias("span"), C.human_bytes(i * 1000003 % F.lit(9000000000)).alias("bytes"), C.human_metres(F.col("o_custkey") * 2.0).alias("metres"),
        C.path_depth(F.concat_ws("/", "o_orderpriority", "o_orderstatus")).alias("depth"), C.dedupe_key(F.col("o_orderpriority"), F.col("o_custkey")).alias("dedupe_key"),
    )


_FIXED = "printf('%.1f', case when ({x}) * 4 % 1 = 0 then floor(({x}) * 10 + 0.5) / 10 else {x} end)"
_UNIT = "case when b / {u}.0::double < 100 then " + _FIXED.format(x="b / {u}.0::double") + " else floor(b / {u}.0::double + 0.5)::bigint::varchar end || ' {n}'"


@query(
    "display_shown",
    f"""select o_orderkey, case when b is null or b < 0 then '\u2014' when b < 1024 then b || ' B' when b < 1048576 then {_UNIT.format(u=1024, n="KB")} when b < 1073741824 then {_UNIT.format(u=1048576, n="MB")} else {_UNIT.format(u=1073741824, n="GB")} end as bytes,
case when m is null then '\u2014' when m < 1000 then floor(m + 0.5)::bigint || ' m' else {_FIXED.format(x="m / 1000")} || ' km' end as metres,
case when mins < 1 then 'under a minute' when mins < 60 then mins || ' min' when mins < 1440 then case when mins % 60 > 0 then mins // 60 || ' h ' || mins % 60 || ' min' else mins // 60 || ' h' end else mins // 1440 || ' d ' || mins // 60 % 24 || ' h' end as span,
case when o_orderkey % 4 = 0 then '\u2014' else strftime(o_orderdate, '%-d %b %Y, %H:%M') end as taken, format('{{:,}}', o_custkey) || case when o_custkey = 1 then ' order' else ' orders' end as counted,
case when length(p) <= 12 then p else '...' || right(p, 9) end as short_path, case when length(p) <= 12 then p else left(p, 9) || '...' end as short_text, upper(left(q, 1)) || substr(q, 2) as flag, p_last as name
from (select *, case when o_orderkey % 6 = 0 then null else o_orderkey * 1000003 % 9000000000 end as b, case when o_orderkey % 5 = 0 then null else o_custkey * 2.5::double end as m, (o_orderkey * 37 % 200000 + 30) // 60 as mins,
  o_orderpriority || '/' || o_orderstatus as p, replace('possibly_' || lower(o_orderstatus), '_', ' ') as q, o_orderstatus as p_last from orders)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    o = t.table(spark, d, "orders")
    path = F.concat_ws("/", "o_orderpriority", "o_orderstatus")
    return o.select(
        "o_orderkey", D.size_text(F.when(i % 6 != 0, i * 1000003 % F.lit(9000000000))).alias("bytes"), D.distance_text(F.when(i % 5 != 0, F.col("o_custkey") * 2.5)).alias("metres"), D.span_text(i * 37 % 200000).alias("span"),
        D.time_text(F.when(i % 4 != 0, F.col("o_orderdate"))).alias("taken"), D.counted(F.col("o_custkey"), "order").alias("counted"), D.shorten_path(path, 12).alias("short_path"), D.shorten(path, 12).alias("short_text"),
        D.flag_text(F.concat(F.lit("possibly_"), F.lower("o_orderstatus"))).alias("flag"), D.library_name(path).alias("name"),
    )


@query("scan_states", "select o_orderkey, case when o_orderkey % 5 = 0 then 'never_scanned' when o_orderkey % 3 = 0 or o_orderkey % 7 = 1 then 'scanning' else 'complete' end as state from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    i, day = F.col("o_orderkey"), F.col("o_orderdate")
    started, finished = F.when(i % 5 != 0, day), F.when(i % 3 == 0, None).when(i % 7 == 1, day - F.expr("interval 1 hour")).otherwise(day)
    return t.table(spark, d, "orders").select("o_orderkey", C.scan_state(started, finished).alias("state"))


@query("image_features")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Perceptual hash and quality of small grey pictures made of the embeddings: pixels, so not for SQL."""
    pixels = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), 127.5 + 60 * x)).cast("int"))
    # Small rows, long work: dealt to all cores, whatever the files' layout.
    rows = t.table(spark, d, "embeddings").repartition(spark.sparkContext.defaultParallelism).select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), pixels.alias("grey"))
    return images.measured(images.from_grey(rows, "vec_id"), "vec_id")


_PIXELS = "select vec_id, list_transform(embedding, lambda x: floor(greatest(0.0::double, least(255.0::double, 127.5::double + 60 * x::double)))::bigint) as v from embeddings"
_SAMPLES = """
samples as (select vec_id, v, y, x, (x + 0.5::double) * (8 / 9::double) - 0.5 as pos from pixels, range(8) r(y), range(9) c(x)),
mixed as (select vec_id, y, x, case when pos < 0 then (v[y * 8 + 1] * 257) // 256 when floor(pos) >= 7 then (v[y * 8 + 8] * 257) // 256
  else floor((1 - (pos - floor(pos))) * (v[y * 8 + floor(pos)::int + 1] * 257) + (pos - floor(pos)) * (v[y * 8 + floor(pos)::int + 2] * 257))::bigint // 256 end as c from samples)"""


@query(
    "image_hashes",
    f"with pixels as ({_PIXELS}), {_SAMPLES.strip()} select a.vec_id, lpad(lower(to_hex(bit_or(case when a.c > b.c then 1::ubigint << (a.y * 8 + a.x)::ubigint else 0::ubigint end))), 16, '0') as phash from mixed a join mixed b on a.vec_id = b.vec_id and a.y = b.y and b.x = a.x + 1 group by a.vec_id",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Perceptual hashes of the pictures of image_features, with pixels that all engines cut alike."""
    pixels = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 127.5 + 60 * x.cast("double")))).cast("int"))
    rows = t.table(spark, d, "embeddings").repartition(spark.sparkContext.defaultParallelism).select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), pixels.alias("grey"))
    return images.measured(images.from_grey(rows, "vec_id"), "vec_id").select("vec_id", C.hex64(F.col("phash")).alias("phash"))


_SPANS = "case when s < 2 then 'just now' when s < 60 then s || 's ago' when s < 3600 then s // 60 || 'm ago' else s // 3600 || 'h ago' end"
_UPTIME = "case when s < 60 then s || 's' when s < 3600 then s // 60 || 'm' || s % 60 || 's' else s // 3600 || 'h' || s % 3600 // 60 || 'm' end"


@query(
    "display_states",
    f"""select o_orderkey, {_SPANS} as ago, {_UPTIME} as uptime, case when o_orderkey % 4 = 0 then '\u2014' else printf('%.2f', o_orderkey % 5 / 4.0::double) end as score,
case when o_orderkey % 3 = 0 then '\u2014' else s || '×' || o_custkey end as size, nullif(trim(case when o_orderkey % 7 = 0 then '   ' else ' ' || o_orderstatus || ' ' end), '') as cleaned from (select *, o_orderkey * 37 % 9000 as s from orders)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("o_orderkey"), F.col("o_orderkey") * 37 % 9000
    text = F.when(i % 7 == 0, "   ").otherwise(F.concat(F.lit(" "), "o_orderstatus", F.lit(" \0")))
    return t.table(spark, d, "orders").select(
        "o_orderkey", C.human_ago(s).alias("ago"), C.uptime(s).alias("uptime"), D.score_text(F.when(i % 4 != 0, i % 5 / 4)).alias("score"), D.dimensions(F.when(i % 3 != 0, s), F.col("o_custkey")).alias("size"), C.clean_text(text).alias("cleaned"),
    )


@query("event_sessions", _POINTS + TIMES.strip() + " select library_id, min(captured_at) as started_at, max(captured_at) as ended_at, count(*) as photo_count from segments group by library_id, segment")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = t.points(spark, d).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    found = incremental.time_events(rows, f"{int(GAP)} seconds")
    return found.select("library_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "ended_at")), "photo_count")


_KINDS = "case o_orderkey % 6 when 0 then 'EXTRACT_METADATA' when 1 then 'COMPUTE_FILE_HASH' when 2 then 'BUILD_CLUSTERS' when 3 then 'BUILD_DUPLICATE_GROUPS' when 4 then 'BUILD_SIMILAR_GROUPS' else 'ANALYZE_QUALITY' end"


@query(
    "job_prerequisites",
    _JOBS
    + f""", own as (select j.* exclude (job_type, library_id), o_custkey % 50 as library_id, {_KINDS} as job_type from jobs j join orders on id = o_orderkey),
needs(job_type, needed) as (values ('BUILD_CLUSTERS', 'EXTRACT_METADATA'), ('BUILD_DUPLICATE_GROUPS', 'COMPUTE_FILE_HASH'), ('BUILD_SIMILAR_GROUPS', 'COMPUTE_FILE_HASH'), ('BUILD_SIMILAR_GROUPS', 'COMPUTE_PERCEPTUAL_HASH'), ('BUILD_SIMILAR_GROUPS', 'ANALYZE_QUALITY')),
open_ as (select * from own where status in ('pending', 'running'))
select a.id, needed, count(*) as outstanding from open_ a join needs using (job_type) join open_ b on b.library_id = a.library_id and b.job_type = needed group by a.id, needed""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    kinds = ["EXTRACT_METADATA", "COMPUTE_FILE_HASH", "BUILD_CLUSTERS", "BUILD_DUPLICATE_GROUPS", "BUILD_SIMILAR_GROUPS", "ANALYZE_QUALITY"]
    rows = t.jobs(spark, d).withColumns({"job_type": F.element_at(F.array(*map(F.lit, kinds)), (i % 6 + 1).cast("int")), "library_id": F.col("target_id") % 50})
    return ledger.waiting(rows)


_ENDED = "case id % 4 when 0 then 'succeeded' when 1 then 'failed' when 2 then 'permanent' else 'deferred' end"
_DEAD = f"(ended = 'permanent' or ended = 'failed' and {_OVER})"


@query(
    "job_settled",
    _JOBS
    + f""", held as (select *, {_ENDED} as ended, 'error ' || id as error from jobs where {_HELD})
select id, case when ended = 'succeeded' then ended when {_DEAD} then 'dead' else 'pending' end as status, case when ended = 'deferred' then greatest(attempt_count - 1, 0) else attempt_count end as attempt_count,
  case when ended = 'deferred' then {_NOW_SQL} + interval 2 second when ended = 'failed' and not ({_OVER}) then {_NOW_SQL} + to_microseconds(({_WAIT} * 1000000)::bigint) else next_attempt_at end as next_attempt_at,
  case when ended = 'succeeded' or {_DEAD} then {_NOW_SQL} else timestamp '1970-01-01' end as completed_at, case when ended = 'succeeded' then '' else error end as last_error from held""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    jobs = t.jobs(spark, d)
    ends = F.element_at(F.array(*map(F.lit, ledger.ENDS)), (F.col("id") % 4 + 1).cast("int"))
    results = jobs.select("id", ends.alias("ended"), F.concat(F.lit("error "), "id").alias("error"))
    return _job(ledger.settled(jobs, 3, results, _now())).drop("leased_by", "lease_expires_at", "started_at")


@query("work_list_hash", _photos() + "select photo_id, relative_path from photos where hashed_at is null and state <> 'missing' order by photo_id limit 500")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.work_list(t.photos(spark, d), "hash").select("photo_id", "relative_path")


@query("needs_counts", _photos() + "select count(*) as photos, " + ", ".join(f"count(*) filter ({needs}) as {stage}" for stage, needs in zip(search.STAGES, _NEEDS.values(), strict=True)) + " from photos")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.needing_counts(t.photos(spark, d))
