"""The ledger of jobs: roll-ups, latency, recovery, and the transitions of a job's state.

A transition takes the ledger and gives the rows that change, as they are afterwards; :func:`applied` puts
them into the ledger.  ``now`` is a value that the caller chooses, so that a transition can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.functions.columns import backoff_seconds

# Fixed values of the ledger.
STATUSES = ("pending", "running", "succeeded", "dead")
PHOTO_JOBS = {"metadata": "EXTRACT_METADATA", "hash": "COMPUTE_FILE_HASH", "phash": "COMPUTE_PERCEPTUAL_HASH", "quality": "ANALYZE_QUALITY", "thumbnail": "GENERATE_THUMBNAIL"}
LIBRARY_JOBS = ("BUILD_DUPLICATE_GROUPS", "BUILD_SIMILAR_GROUPS", "BUILD_CLUSTERS")
PHOTO_PRIORITY, LIBRARY_PRIORITY = 100, 200
MAX_ATTEMPTS = 5
LEASE_SECONDS = 60
LEASE_EXPIRED = "lease expired"
SILENT_WORKER = "lease expired: worker stopped responding (attempt "


def _counts() -> list[Column]:
    return [*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count(F.lit(1)).alias("total")]


def counts_by_type(jobs: DataFrame, library: object | None = None) -> DataFrame:
    return _of(jobs, library).groupBy("job_type").agg(*_counts())


def counts(jobs: DataFrame, library: object | None = None) -> DataFrame:
    """One row: the jobs of a library, or of all, by status."""
    return _of(jobs, library).agg(*_counts())


def counts_map(jobs: DataFrame, library: object | None = None) -> DataFrame:
    """One row: by_type, from a job's type to its numbers by status, as JSON."""
    each = counts_by_type(jobs, library).select(F.struct("job_type", F.struct(*STATUSES, "total").alias("n")).alias("e"))
    return each.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list("e")))).alias("by_type"))


def _of(rows: DataFrame, library: object | None) -> DataFrame:
    return rows if library is None else rows.where(F.col("library_id") == library)


def outstanding(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("pending", "running")).groupBy("job_type").agg(F.count(F.lit(1)).alias("n"))


def stage_latency(jobs: DataFrame, executions: DataFrame) -> DataFrame:
    """Count, exact median and 95th percentile, and mean of the milliseconds of successful executions by type."""
    rows = executions.where("outcome = 'succeeded'").join(jobs.select(F.col("id").alias("job_id"), "job_type"), "job_id")
    ms = F.col("duration_ms")
    return rows.groupBy("job_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(ms, F.lit(0.5)), 1).alias("p50"), F.round(F.percentile(ms, F.lit(0.95)), 1).alias("p95"), F.round(F.avg(ms), 1).alias("mean"))


def spread(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, median, least and greatest of a measurement, as a report of repeated runs gives them."""
    x = F.col(value)
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.median(x).alias("median"), F.min(x).alias("least"), F.max(x).alias("greatest"))


def deferrals(jobs: DataFrame, executions: DataFrame) -> DataFrame:
    rows = executions.where("outcome = 'deferred'").join(jobs.select(F.col("id").alias("job_id"), "job_type"), "job_id")
    return rows.groupBy("job_type").agg(F.count(F.lit(1)).alias("n"))


def recoveries(jobs: DataFrame, executions: DataFrame, worker: object) -> DataFrame:
    """For each execution that ``worker`` began and didn't end: when another took the job up, and how often another succeeded."""
    lost = executions.where((F.col("worker_id") == worker) & (F.col("outcome").isNull() | (F.col("outcome") == "abandoned"))).select("job_id", "attempt", "started_at")
    others = executions.where(F.col("worker_id") != worker).select("job_id", F.col("started_at").alias("other_start"), "outcome")
    both = lost.join(others, "job_id", "left").groupBy("job_id", "attempt").agg(
        F.min(F.when(F.col("other_start") > F.col("started_at"), F.col("other_start"))).alias("taken_up_at"), F.count_if(F.col("outcome") == "succeeded").alias("succeeded_elsewhere")
    )
    return both.join(jobs.select(F.col("id").alias("job_id"), "status"), "job_id")


#: What has to be done before an aggregate job of a library can run.
NEEDED_FIRST = {"BUILD_CLUSTERS": ("EXTRACT_METADATA",), "BUILD_DUPLICATE_GROUPS": ("COMPUTE_FILE_HASH",), "BUILD_SIMILAR_GROUPS": ("COMPUTE_FILE_HASH", "COMPUTE_PERCEPTUAL_HASH", "ANALYZE_QUALITY")}
DEFER_SECONDS = 2


def waiting(jobs: DataFrame) -> DataFrame:
    """(id, needed, outstanding): aggregate jobs that have to wait, with what they wait for; one row for each kind of job."""
    pairs = F.array(*(F.struct(F.lit(a).alias("job_type"), F.lit(n).alias("needed")) for a, needed in NEEDED_FIRST.items() for n in needed))
    first = jobs.sparkSession.range(1).select(F.explode(pairs).alias("x")).select("x.*")
    open_ = jobs.where(F.col("status").isin("pending", "running"))
    left = open_.groupBy("library_id", F.col("job_type").alias("needed")).agg(F.count(F.lit(1)).alias("outstanding"))
    return open_.select("id", "job_type", "library_id").join(F.broadcast(first), "job_type").join(left, ["library_id", "needed"]).select("id", "needed", "outstanding")


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (job_type, target_id, ...) without an outstanding job, each once; a finished one may be queued again."""
    open_ = jobs.where(F.col("status").isin("pending", "running")).select("job_type", "target_id")
    return wanted.dropDuplicates(["job_type", "target_id"]).join(open_, ["job_type", "target_id"], "left_anti")


def fan_out(photos: DataFrame, libraries: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """(job_type, target_type, target_id, library_id, priority, max_attempts): jobs of each photo a stage has still to measure, and of each library.

    ``stages`` has the photos by stage; the jobs of a library come later, by their priority.
    """

    def jobs(rows: DataFrame, kind: str, target: str, key: str, priority: int) -> DataFrame:
        return rows.select(F.lit(kind).alias("job_type"), F.lit(target).alias("target_type"), F.col(key).cast("string").alias("target_id"), F.col("library_id").cast("string").alias("library_id"), F.lit(priority).alias("priority"), F.lit(MAX_ATTEMPTS).alias("max_attempts"))

    parts = [jobs(rows, PHOTO_JOBS[stage], "photo", "photo_id", PHOTO_PRIORITY) for stage, rows in stages.items()]
    parts += [jobs(libraries, kind, "library", "library_id", LIBRARY_PRIORITY) for kind in LIBRARY_JOBS]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def applied(jobs: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The ledger with rows in place of those with the same key."""
    return jobs.join(changes.select(key), key, "left_anti").unionByName(changes.select(*jobs.columns))


def _after(now: object, seconds: object) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) + (seconds * 1_000_000).cast("long")).cast("timestamp")


def _none(jobs: DataFrame, column: str) -> Column:
    return F.lit(None).cast(jobs.schema[column].dataType)


def _lease(jobs: DataFrame, worker: Column | None, until: Column | None) -> dict[str, Column]:
    kinds = {c: jobs.schema[c].dataType for c in ("leased_by", "lease_expires_at")}
    return {"leased_by": (F.lit(None) if worker is None else worker).cast(kinds["leased_by"]), "lease_expires_at": (F.lit(None) if until is None else until).cast(kinds["lease_expires_at"])}


def _held(jobs: DataFrame, worker: object, ids: Sequence[object] | None = None) -> DataFrame:
    """Running jobs that the worker holds: no one else's are changed by it."""
    rows = jobs.where((F.col("status") == "running") & (F.col("leased_by") == worker))
    return rows if ids is None else rows.where(F.col("id").isin(list(ids)))


def claim(jobs: DataFrame, worker: object, k: int, now: object, lease_seconds: float = LEASE_SECONDS) -> DataFrame:
    """The next k pending jobs that are due, by priority and id, leased to the worker; the attempt is paid for at once."""
    due = jobs.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= F.lit(now))).orderBy("priority", "id").limit(max(k, 0))
    return due.withColumns({"status": F.lit("running"), **_lease(jobs, F.lit(worker), _after(now, lease_seconds)), "attempt_count": F.col("attempt_count") + 1, "started_at": F.coalesce("started_at", F.lit(now).cast(jobs.schema["started_at"].dataType))})


def started(claimed: DataFrame, now: object) -> DataFrame:
    """(job_id, worker_id, attempt, started_at, finished_at, outcome, error): the executions that claimed jobs begin."""
    when = F.lit(now).cast("timestamp")
    return claimed.select(F.col("id").alias("job_id"), F.col("leased_by").alias("worker_id"), F.col("attempt_count").alias("attempt"), when.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("error"))


def ended(executions: DataFrame, outcome: str, now: object, error: str | None = None) -> DataFrame:
    """Executions closed with an outcome."""
    return executions.withColumns({"finished_at": F.lit(now).cast(executions.schema["finished_at"].dataType), "outcome": F.lit(outcome), "error": F.lit(error).cast("string")})


def complete(jobs: DataFrame, worker: object, now: object, ids: Sequence[object] | None = None) -> DataFrame:
    """Running jobs that ``worker`` holds, as done."""
    return _held(jobs, worker, ids).withColumns({"status": F.lit("succeeded"), **_lease(jobs, None, None), "completed_at": F.lit(now).cast(jobs.schema["completed_at"].dataType), "last_error": _none(jobs, "last_error")})


def fail(jobs: DataFrame, worker: object, now: object, error: str, permanent: bool = False, ids: Sequence[object] | None = None) -> DataFrame:
    """Running jobs that ``worker`` holds after a failure: dead if out of attempts or hopeless, else pending after a wait."""
    return _returned(_held(jobs, worker, ids), F.lit(permanent) | (F.col("attempt_count") >= F.col("max_attempts")), now, F.lit(error))


def _returned(rows: DataFrame, over: Column, now: object, error: Column, seconds: Column | None = None) -> DataFrame:
    wait = backoff_seconds(F.col("attempt_count")) if seconds is None else seconds
    kinds = {c: rows.schema[c].dataType for c in ("next_attempt_at", "completed_at")}
    return rows.withColumns(
        {
            "status": F.when(over, "dead").otherwise("pending"),
            **_lease(rows, None, None),
            "next_attempt_at": F.when(over, F.col("next_attempt_at")).otherwise(_after(now, wait).cast(kinds["next_attempt_at"])),
            "completed_at": F.when(over, F.lit(now).cast(kinds["completed_at"])),
            "last_error": error,
        }
    )


def defer(jobs: DataFrame, worker: object, now: object, seconds: float, reason: str, ids: Sequence[object] | None = None) -> DataFrame:
    """Running jobs that ``worker`` holds put off: pending, the attempt undone."""
    due = _after(now, seconds).cast(jobs.schema["next_attempt_at"].dataType)
    return _held(jobs, worker, ids).withColumns({"status": F.lit("pending"), **_lease(jobs, None, None), "next_attempt_at": due, "attempt_count": F.greatest(F.col("attempt_count") - 1, F.lit(0)), "last_error": F.lit(reason)})


def renew(jobs: DataFrame, worker: object, now: object, lease_seconds: float = LEASE_SECONDS) -> DataFrame:
    """Running jobs that ``worker`` holds, with a longer lease."""
    return _held(jobs, worker).withColumns(_lease(jobs, F.col("leased_by"), _after(now, lease_seconds)))


def release(jobs: DataFrame, worker: object, now: object) -> DataFrame:
    """Running jobs that ``worker`` holds given back at once; the attempts stay spent."""
    return _held(jobs, worker).withColumns({"status": F.lit("pending"), **_lease(jobs, None, None), "next_attempt_at": F.lit(now).cast(jobs.schema["next_attempt_at"].dataType)})


#: How a run of a job can end, beside being interrupted, which leaves the job to :func:`release`.
ENDS = ("succeeded", "failed", "permanent", "deferred")


def settled(jobs: DataFrame, worker: object, results: DataFrame, now: object) -> DataFrame:
    """Running jobs that ``worker`` holds, after results (id, ended, error): each goes the way that its end demands.

    A passing failure is tried again after a wait, a permanent one never; a deferral costs no attempt.
    """
    held = _held(jobs, worker).join(results.select("id", "ended", "error"), "id")
    ways = {
        "succeeded": lambda rows: complete(rows, worker, now),
        "failed": lambda rows: _returned(rows, F.col("attempt_count") >= F.col("max_attempts"), now, F.col("error")),
        "permanent": lambda rows: _returned(rows, F.lit(True), now, F.col("error")),
        "deferred": lambda rows: defer(rows, worker, now, DEFER_SECONDS, "").withColumn("last_error", F.col("error")),
    }
    parts = [ways[end](held.where(F.col("ended") == end)).select(*jobs.columns) for end in ENDS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reap(jobs: DataFrame, now: object, seconds: float = 0) -> DataFrame:
    """Running jobs whose lease ran out before ``now``: dead if out of attempts, else pending after a wait."""
    lost = jobs.where((F.col("status") == "running") & (F.col("lease_expires_at") < F.lit(now)))
    reason = F.concat(F.lit(SILENT_WORKER), F.col("attempt_count"), F.lit(" of "), F.col("max_attempts"), F.lit(")"))
    return _returned(lost, F.col("attempt_count") >= F.col("max_attempts"), now, reason, F.lit(seconds))


def reaped_executions(executions: DataFrame, reaped: DataFrame, now: object) -> DataFrame:
    """Open executions of reaped jobs, closed as abandoned."""
    open_ = executions.where("finished_at is null").join(reaped.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return ended(open_, "abandoned", now, LEASE_EXPIRED)


def reaped_counts(reaped: DataFrame) -> DataFrame:
    return reaped.agg(F.count_if(F.col("status") == "pending").alias("requeued"), F.count_if(F.col("status") == "dead").alias("died"))
