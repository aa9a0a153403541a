"""Photo-shaped views over general tables, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sign_hash(values: Column) -> Column:
    """64 signs as the bits of a long; null for null."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(values, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(values.isNotNull(), F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


#: Parts of a quality label as scores of the view.
SCORES = {"sharpness": 0.5, "exposure": 0.25, "contrast": 0.75, "resolution": 0.625}


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files, embeddings as perceptual hashes, events as capture time and place, labels as quality."""
    d, e, l, m = (table(spark, sf_dir, t) for t in ("documents", "events", "labels", "embeddings"))  # noqa: E741
    hashes = m.select(F.col("vec_id").alias("doc_id"), sign_hash(F.col("embedding")).alias("phash"))
    rows = d.join(e, d["doc_id"] == e["event_id"], "left").join(l, "doc_id", "left").join(hashes, "doc_id", "left")
    i, size = F.col("doc_id"), F.col("n_chars")
    dated, placed = i % 11 != 0, F.col("event_type").isin("view", "click", "purchase")
    flags = F.array_compact(F.array(F.when(F.col("quality") == 0, "possibly_blurry"), F.when(F.col("toxic") == 1, "highlights_clipped"), F.when(size < 200, "low_resolution")))
    return rows.select(
        i.alias("photo_id"),
        F.col("source").alias("library_id"),
        F.concat(F.expr("repeat('sub/', cast(doc_id % 3 as int))"), "lang", F.lit("/"), "source", F.lit("_"), i.cast("string"), F.lit(".jpg")).alias("relative_path"),
        size.alias("file_size_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.when(i % 41 == 0, "missing").when(i % 37 == 0, "failed").otherwise("processing").alias("state"),
        F.when(dated, F.col("ts")).alias("captured_at"),
        F.when(dated, F.when(F.col("event_type") == "error", "filesystem").otherwise("exif")).alias("captured_at_source"),
        F.when(placed, 30 + F.col("user_id") % 20 * F.lit(0.01)).alias("latitude"),
        F.when(placed, -97 - F.col("user_id") % 7 * F.lit(0.01)).alias("longitude"),
        "phash",
        F.when(F.col("quality").isNotNull(), F.round(0.5 * F.col("quality") + F.least(size.cast("double") / 4000, F.lit(0.5)), 6)).alias("quality_score"),
        flags.alias("quality_flags"),
        (640 + i % 5 * 160).alias("width"),
        (480 + i % 3 * 120).alias("height"),
        F.when(i % 17 != 0, F.col("ts")).alias("metadata_extracted_at"),
        F.when(i % 13 != 0, F.col("ts")).alias("hashed_at"),
        (i * 60).alias("created_seconds"),
        F.concat(F.col("source"), F.lit("_"), i.cast("string"), F.lit(".jpg")).alias("original_filename"),
        F.when(i % 5 != 0, "jpeg").alias("detected_format"),
        (i % 9).cast("int").alias("orientation"),
        F.when(i % 4 != 0, F.concat(F.lit("make"), (i % 3).cast("string"))).alias("camera_make"),
        F.when(i % 6 != 0, F.concat(F.lit("model"), (i % 7).cast("string"))).alias("camera_model"),
        *(F.when(F.col("quality").isNotNull(), F.lit(part) * F.col("quality") + F.lit(0.125)).alias(f"{name}_score") for name, part in SCORES.items()),
        F.when((i % 23 != 0) & (F.col("phash").isNotNull() | (i % 10 == 0)), F.col("ts")).alias("phashed_at"),
        F.when(F.col("quality").isNotNull() | (i % 10 == 0), F.col("ts")).alias("quality_analyzed_at"),
        F.when(i % 6 != 0, F.col("ts")).alias("thumbnailed_at"),
        F.when(i % 12 > 6, 400).alias("thumbnail_width"),
        F.when(i % 12 > 6, 300).alias("thumbnail_height"),
        F.when((i % 37 == 0) & (i % 41 != 0), "not an image").alias("last_error"),
    )


#: The same view for DuckDB, as the first of a query's common table expressions.
PHOTOS_SQL = """
photos as (
  select d.doc_id as photo_id, d.source as library_id,
    concat(repeat('sub/', cast(d.doc_id % 3 as int)), d.lang, '/', d.source, '_', cast(d.doc_id as varchar), '.jpg') as relative_path,
    d.n_chars as file_size_bytes, sha256(d.text) as sha256,
    case when d.doc_id % 41 = 0 then 'missing' when d.doc_id % 37 = 0 then 'failed' else 'processing' end as state,
    case when d.doc_id % 11 = 0 then null else e.ts end as captured_at,
    case when d.doc_id % 11 = 0 then null when e.event_type = 'error' then 'filesystem' else 'exif' end as captured_at_source,
    case when e.event_type in ('view', 'click', 'purchase') then 30 + (e.user_id % 20) * cast(0.01 as double) end as latitude,
    case when e.event_type in ('view', 'click', 'purchase') then -97 - (e.user_id % 7) * cast(0.01 as double) end as longitude,
    case when m.embedding is null then null else list_reduce(list_transform(range(64), lambda i: case when m.embedding[i + 1] > 0 then (1::ubigint << i::ubigint) else 0::ubigint end), lambda a, b: a | b) end as phash,
    case when l.doc_id is null then null else round(cast(0.5 as double) * l.quality + least(cast(d.n_chars as double) / 4000, cast(0.5 as double)), 6) end as quality_score,
    list_filter([case when l.quality = 0 then 'possibly_blurry' end, case when l.toxic = 1 then 'highlights_clipped' end, case when d.n_chars < 200 then 'low_resolution' end], lambda x: x is not null) as quality_flags,
    640 + d.doc_id % 5 * 160 as width, 480 + d.doc_id % 3 * 120 as height,
    case when d.doc_id % 17 <> 0 then e.ts end as metadata_extracted_at, case when d.doc_id % 13 <> 0 then e.ts end as hashed_at,
    d.doc_id * 60 as created_seconds,
    concat(d.source, '_', cast(d.doc_id as varchar), '.jpg') as original_filename, case when d.doc_id % 5 <> 0 then 'jpeg' end as detected_format, (d.doc_id % 9)::int as orientation,
    case when d.doc_id % 4 <> 0 then 'make' || (d.doc_id % 3) end as camera_make, case when d.doc_id % 6 <> 0 then 'model' || (d.doc_id % 7) end as camera_model,
    0.5::double * l.quality + 0.125::double as sharpness_score, 0.25::double * l.quality + 0.125::double as exposure_score, 0.75::double * l.quality + 0.125::double as contrast_score, 0.625::double * l.quality + 0.125::double as resolution_score,
    case when d.doc_id % 23 <> 0 and (m.embedding is not null or d.doc_id % 10 = 0) then e.ts end as phashed_at,
    case when l.quality is not null or d.doc_id % 10 = 0 then e.ts end as quality_analyzed_at, case when d.doc_id % 6 <> 0 then e.ts end as thumbnailed_at,
    case when d.doc_id % 12 > 6 then 400 end as thumbnail_width, case when d.doc_id % 12 > 6 then 300 end as thumbnail_height,
    case when d.doc_id % 37 = 0 and d.doc_id % 41 <> 0 then 'not an image' end as last_error
  from documents d left join events e on e.event_id = d.doc_id left join labels l on l.doc_id = d.doc_id left join embeddings m on m.vec_id = d.doc_id)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as dated photos of their user: some undated, some without a place, half of those dated by the file system."""
    e = table(spark, sf_dir, "events")
    i, placed = F.col("event_id"), F.col("event_type").isin("view", "click", "purchase")
    return e.select(
        i.alias("photo_id"),
        F.col("user_id").alias("library_id"),
        F.when(i % 11 != 0, F.col("ts")).alias("captured_at"),
        F.when(F.col("event_type") == "error", "filesystem").otherwise("exif").alias("captured_at_source"),
        F.when(placed, 30 + F.col("value") / 4000).alias("latitude"),
        F.when(placed, -97 - F.col("value") / 8000).alias("longitude"),
    )


POINTS_SQL = """
points as (
  select event_id as photo_id, user_id as library_id, case when event_id % 11 <> 0 then ts end as captured_at,
    case when event_type = 'error' then 'filesystem' else 'exif' end as captured_at_source,
    case when event_type in ('view', 'click', 'purchase') then 30 + value / 4000 end as latitude,
    case when event_type in ('view', 'click', 'purchase') then -97 - value / 8000 end as longitude
  from events)
"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a ledger of jobs."""
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    status = F.when(i % 19 == 0, "dead").when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return o.select(
        i.alias("id"), F.col("o_orderpriority").alias("job_type"), F.col("o_custkey").alias("target_id"), (i % 3).alias("library_id"), status.alias("status"), (100 + i % 2 * 100).alias("priority"),
        (i % 7).alias("attempt_count"), F.lit(5).alias("max_attempts"), F.col("o_orderdate").alias("next_attempt_at"), F.when(status == "running", i % 8).alias("leased_by"), F.when(status == "running", F.col("o_orderdate")).alias("lease_expires_at"),
        F.when(i % 4 == 0, F.col("o_orderdate")).alias("started_at"), F.when(status.isin("succeeded", "dead"), F.col("o_orderdate")).alias("completed_at"), F.when(i % 5 == 0, "unreadable").alias("last_error"),
    )


JOBS_SQL = """
jobs as (
  select *, case when status = 'running' then id % 8 end as leased_by, case when status = 'running' then next_attempt_at end as lease_expires_at,
      case when id % 4 = 0 then next_attempt_at end as started_at, case when status in ('succeeded', 'dead') then next_attempt_at end as completed_at, case when id % 5 = 0 then 'unreadable' end as last_error from (
    select o_orderkey as id, o_orderpriority as job_type, o_custkey as target_id, o_orderkey % 3 as library_id,
      case when o_orderkey % 19 = 0 then 'dead' when o_orderstatus = 'F' then 'succeeded' when o_orderstatus = 'O' then 'pending' else 'running' end as status,
      100 + o_orderkey % 2 * 100 as priority, o_orderkey % 7 as attempt_count, 5 as max_attempts, o_orderdate as next_attempt_at from orders))
"""


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the executions of those jobs."""
    x = table(spark, sf_dir, "lineitem")
    outcome = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "N", "succeeded").when(F.col("l_linestatus") == "O", "deferred").otherwise("abandoned")
    return x.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("attempt"), (F.col("l_suppkey") % 8).alias("worker_id"), F.col("l_shipdate").alias("started_at"), (F.col("l_quantity") * 10 + F.col("l_discount") * 100).alias("duration_ms"), outcome.alias("outcome"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_shipdate")).alias("finished_at"), F.lit(None).cast("string").alias("error"))


EXECUTIONS_SQL = """
executions as (
  select l_orderkey as job_id, l_linenumber as attempt, l_suppkey % 8 as worker_id, l_shipdate as started_at, l_quantity * 10 + l_discount * 100 as duration_ms,
    case when l_returnflag = 'R' then 'failed' when l_returnflag = 'N' then 'succeeded' when l_linestatus = 'O' then 'deferred' else 'abandoned' end as outcome,
    case when l_linenumber % 3 <> 0 then l_shipdate end as finished_at, null::varchar as error
  from lineitem)
"""


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers as workers, each seen a few seconds before 1996 began; more than hold jobs."""
    i = F.col("s_suppkey")
    seen = F.expr("timestamp_ntz'1996-01-01 00:00:00'") - F.make_dt_interval(secs=(i * 37 % 50).cast("decimal(18,6)"))
    status = F.when(i % 7 == 0, "dead").when(i % 5 == 0, "stopped").otherwise("active")
    return table(spark, sf_dir, "supplier").select(
        (i - 1).cast("long").alias("worker_id"), F.col("s_name").alias("hostname"), (1 + i % 4).cast("int").alias("slots"), status.alias("status"), F.expr("timestamp_ntz'1995-12-31 23:00:00'").alias("started_at"), seen.alias("last_heartbeat_at"), F.when(status != "active", seen).alias("stopped_at")
    )


WORKERS_SQL = """
workers as (
  select *, case when status <> 'active' then last_heartbeat_at end as stopped_at from (
    select s_suppkey - 1 as worker_id, s_name as hostname, 1 + s_suppkey % 4 as slots, case when s_suppkey % 7 = 0 then 'dead' when s_suppkey % 5 = 0 then 'stopped' else 'active' end as status,
      timestamp '1995-12-31 23:00:00' as started_at, timestamp '1996-01-01 00:00:00' - (s_suppkey * 37 % 50) * interval 1 second as last_heartbeat_at from supplier))
"""
