"""Scanning folders of photos: what is there, what is skipped and why."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.config import MAX_FILE_BYTES
from photonlake.functions.columns import format_of

ENTRIES = "library_id string, relative_path string, original_filename string, file_size_bytes bigint, file_modified_at timestamp, outcome string"


def resolve_within(root: str, target: str) -> Path:
    """The real path of ``target``; an error, which doesn't name it, unless it lies in ``root`` after links are followed."""
    base, real = Path(root).resolve(strict=True), Path(target).resolve()
    if not real.is_relative_to(base):
        raise ValueError("the path leaves the library")
    return real


def relative_to(root: str, path: str) -> str:
    """``path`` below ``root`` with forward slashes; an error for the root itself and for what lies outside."""
    own = resolve_within(root, path).relative_to(Path(root).resolve())
    if own == Path("."):
        raise ValueError("the path is the library itself")
    return own.as_posix()


def _walk(root: str, max_bytes: int) -> Iterator[tuple]:
    base = Path(root).resolve()
    stack = [base]
    while stack:
        try:
            entries = sorted(os.scandir(stack.pop()), key=lambda e: e.name)
        except OSError:
            yield ("", "", 0, None, "unreadable")
            continue
        for e in entries:
            path = Path(e.path).relative_to(base).as_posix()
            if e.name.startswith("."):
                yield (path, e.name, 0, None, "hidden")
            elif e.is_symlink():
                continue
            elif e.is_dir():
                stack.append(Path(e.path))
                yield (path, e.name, 0, None, "directory")
            elif e.is_file():
                try:
                    s = e.stat()
                except OSError:
                    yield (path, e.name, 0, None, "unreadable")
                    continue
                yield (path, e.name, s.st_size, s.st_mtime, "too_large" if s.st_size > max_bytes else "file")


def walk(spark: SparkSession, root: str, library_id: str = "", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Every entry below a folder of the driver's file system with its outcome; hidden ones and links aren't followed."""
    from datetime import datetime, timezone

    rows = [(library_id, p, n, s, datetime.fromtimestamp(m, timezone.utc) if m else None, o) for p, n, s, m, o in _walk(root, max_bytes)]
    entries = spark.createDataFrame(rows, ENTRIES).withColumn("detected_format", format_of(F.col("relative_path")))
    return entries.withColumn("outcome", F.when((F.col("outcome") == "file") & F.col("detected_format").isNull(), "unsupported").otherwise(F.col("outcome")))


def listing(spark: SparkSession, root: str, library_id: str = "", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The supported files of :func:`listed`."""
    return listed(spark, root, library_id, max_bytes).where("outcome = 'file'").drop("outcome")


def listed(spark: SparkSession, root: str, library_id: str = "", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The files below a path of any store with their outcome, listed by Spark without reading contents.

    :func:`statistics` counts them.  Spark leaves out folders, empty files and names that begin with a dot or an
    underscore; ``walk`` sees those, one folder after another on the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    rows = files.select(
        F.lit(library_id).alias("library_id"), F.expr(f"substring(path, {len(full) + 2})").alias("relative_path"), F.substring_index("path", "/", -1).alias("original_filename"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("file_modified_at"), format_of(F.col("path")).alias("detected_format"), "path"
    )
    return rows.withColumn("outcome", F.when(F.col("file_size_bytes") > max_bytes, "too_large").when(F.col("detected_format").isNull(), "unsupported").otherwise("file"))


def found(entries: DataFrame) -> DataFrame:
    return entries.where("outcome = 'file'").drop("outcome")


def statistics(entries: DataFrame) -> DataFrame:
    """One row: files seen, folders, supported, and what was skipped by reason."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return entries.agg(n("file", "unsupported", "too_large").alias("files"), n("directory").alias("directories"), n("file").alias("supported"), *(n(x).alias(f"skipped_{x}") for x in ("unsupported", "hidden", "too_large")), n("unreadable").alias("unreadable"))


def result(entries: DataFrame, known: DataFrame) -> DataFrame:
    """One row: discovered, inserted and already known files."""
    keys = found(entries).select("library_id", "relative_path")
    old = known.select("library_id", "relative_path", F.lit(1).alias("old")).distinct()
    return keys.join(old, ["library_id", "relative_path"], "left").agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("old").isNull()).alias("inserted"), F.count("old").alias("already_known"))


def vanished(known: DataFrame, entries: DataFrame) -> DataFrame:
    """(photo_id, last_error): known photos whose file isn't found any more, as :func:`photos.mark_missing` takes them."""
    there = found(entries).select("library_id", "relative_path")
    gone = known.where("state <> 'missing'").join(there, ["library_id", "relative_path"], "left_anti")
    return gone.select("photo_id", F.lit("file not found").alias("last_error"))


def register_library(libraries: DataFrame, new: DataFrame) -> DataFrame:
    """``libraries`` with those of ``new`` whose kind and root aren't there yet; an existing one keeps its name.

    ``created`` says which are new.
    """
    key = ["source_kind", "root_path"]
    fresh = new.dropDuplicates(key).join(libraries.select(*key), key, "left_anti")
    return libraries.withColumn("created", F.lit(False)).unionByName(fresh.withColumn("created", F.lit(True)), allowMissingColumns=True)


def libraries_in_order(libraries: DataFrame) -> DataFrame:
    """The newest first."""
    return libraries.orderBy(F.desc("created_at"), "id")


def may_start(state: str, force: bool = False) -> bool:
    """Whether a scan may begin: not while another runs, unless it is forced."""
    return force or state != "scanning"


def _with(libraries: DataFrame, chosen: Column, **changes: Column) -> DataFrame:
    return libraries.withColumns({c: F.when(chosen, v.cast(libraries.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})


def begin_scan(libraries: DataFrame, library: object, now: object, force: bool = False) -> DataFrame:
    """``libraries`` with a scan begun; the library stays as it is while another runs, unless it is forced."""
    free = F.lit(force) | F.col("last_scan_started_at").isNull() | F.col("last_scan_finished_at").isNotNull()
    return _with(libraries, (F.col("id") == library) & free, last_scan_started_at=F.lit(now), last_scan_finished_at=F.lit(None))


def finish_scan(libraries: DataFrame, library: object, now: object) -> DataFrame:
    return _with(libraries, F.col("id") == library, last_scan_finished_at=F.lit(now))


def interrupted(libraries: DataFrame) -> DataFrame:
    """Libraries whose scan began and never ended."""
    return libraries.where("last_scan_started_at is not null and last_scan_finished_at is null")


def reconcile(libraries: DataFrame, now: object) -> DataFrame:
    """``libraries`` after a crash: scans that never ended are closed, so that the next may begin."""
    open_ = F.col("last_scan_started_at").isNotNull() & F.col("last_scan_finished_at").isNull()
    return _with(libraries, open_, last_scan_finished_at=F.lit(now))


def content_features(files: DataFrame) -> DataFrame:
    """(path, sha256, short, file_size_bytes, note) of rows (path, content, length): the hash of each file, and whether its size changed."""
    size = F.octet_length("content").cast("long")
    sha = F.sha2("content", 256)
    # Fixed texts around the two sizes.
    note = F.when((F.col("length") > 0) & (F.col("length") != size), F.concat(F.lit("file size changed since scan: "), F.col("length"), F.lit(" -> "), size, F.lit(" bytes")))
    return files.select("path", sha.alias("sha256"), F.left(sha, F.lit(12)).alias("short"), size.alias("file_size_bytes"), note.alias("note"))
