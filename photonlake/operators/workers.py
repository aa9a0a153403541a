"""The registry of workers: listing, roll-up, liveness, and who holds the most jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds between signs of life, and after how many missed ones a worker counts as dead.
HEARTBEAT_SECONDS, MISSED = 5, 3


def running(workers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each worker with the number of jobs it holds, 0 included."""
    held = jobs.where("status = 'running'").groupBy(F.col("leased_by").alias("worker_id")).agg(F.count(F.lit(1)).alias("running"))
    return workers.join(held, "worker_id", "left").withColumn("running", F.coalesce("running", F.lit(0)))


def listing(workers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Workers with what they hold: active ones first, then stopped ones, then the rest, each the last seen first."""
    place = F.when(F.col("status") == "active", 0).when(F.col("status") == "stopped", 1).otherwise(2)
    return running(workers, jobs).orderBy(place, F.desc("last_heartbeat_at"), "worker_id")


def rollup(workers: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: workers, active ones, their slots, and all jobs held."""
    active = F.col("status") == "active"
    return running(workers, jobs).agg(F.count(F.lit(1)).alias("workers"), F.count_if(active).alias("active"), F.coalesce(F.sum(F.when(active, F.col("slots"))), F.lit(0)).alias("slots"), F.coalesce(F.sum("running"), F.lit(0)).alias("running"))


def victim(workers: DataFrame, jobs: DataFrame, library: object | None = None) -> DataFrame:
    """The worker that holds most running jobs, with their number; ties go to the least id."""
    rows = jobs.where("status = 'running'")
    rows = rows if library is None else rows.where(F.col("library_id") == library)
    held = rows.groupBy(F.col("leased_by").alias("worker_id")).agg(F.count(F.lit(1)).alias("running"))
    return workers.select("worker_id", "hostname").join(held, "worker_id").orderBy(F.desc("running"), "worker_id").limit(1)


def register(workers: DataFrame, new: DataFrame, now: object) -> DataFrame:
    """The registry with ``new`` (worker_id, hostname, slots): one that comes back is active again and keeps when it began."""
    when = F.lit(now).cast("timestamp")
    began = workers.select("worker_id", F.col("started_at"))
    fresh = new.join(began, "worker_id", "left").withColumns({"status": F.lit("active"), "started_at": F.coalesce("started_at", when), "last_heartbeat_at": when, "stopped_at": F.lit(None).cast("timestamp")})
    return workers.join(new.select("worker_id"), "worker_id", "left_anti").unionByName(fresh.select(*workers.columns))


def _with(workers: DataFrame, chosen: object, **changes: object) -> DataFrame:
    return workers.withColumns({c: F.when(chosen, v.cast(workers.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def heartbeat(workers: DataFrame, worker: object, now: object) -> DataFrame:
    """The registry after a sign of life, which only an active worker can give."""
    return _with(workers, (F.col("worker_id") == worker) & (F.col("status") == "active"), last_heartbeat_at=F.lit(now))


def unregister(workers: DataFrame, worker: object, now: object) -> DataFrame:
    return _with(workers, F.col("worker_id") == worker, status=F.lit("stopped"), stopped_at=F.lit(now))


def _before(now: object, seconds: float) -> object:
    return F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - F.lit(int(seconds * 1_000_000)))


def reap(workers: DataFrame, now: object, seconds: float = HEARTBEAT_SECONDS * MISSED) -> DataFrame:
    """The registry in which active workers that were silent for longer are dead; their jobs aren't touched."""
    silent = (F.col("status") == "active") & (F.col("last_heartbeat_at") < _before(now, seconds))
    return _with(workers, silent, status=F.lit("dead"), stopped_at=F.lit(now))


def purge(workers: DataFrame, jobs: DataFrame, now: object, seconds: float) -> DataFrame:
    """The registry without workers that stopped longer ago and hold no running job."""
    gone = workers.where(F.col("status").isin("stopped", "dead") & (F.col("stopped_at") < _before(now, seconds)))
    gone = gone.join(jobs.where("status = 'running'").select(F.col("leased_by").alias("worker_id")), "worker_id", "left_anti")
    return workers.join(gone.select("worker_id"), "worker_id", "left_anti")
