"""Lineage cuts in shared storage, broadcasts of checked size, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that is sent to all tasks at most.
SENT_BYTES = 32 << 20


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="photonlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one in local mode only."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, and read from there.

    A table is written rather than a checkpoint taken: its size is known when it is read, while the estimates
    that checkpoints carry along multiply with every join of a loop until planning takes all the time and
    memory of the driver.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{spark.sparkContext.applicationId}/{''.join(f'{s}/' for s in _SCOPES)}{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of the scopes that are open, the outer ones first.
_SCOPES: list[str] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut within the scope are deleted at its end; what is made of them has to be written by then."""
    _SCOPES.append(f"scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _remove(spark, f"{shared_folder(spark)}/cut-{spark.sparkContext.applicationId}/{'/'.join(_SCOPES)}")
        _SCOPES.pop()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote, when nothing that is still to run reads them."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            if "/cut-" in folder:
                _remove(table.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application cut and kept; call it when its results have been written."""
    _remove(spark, f"{shared_folder(spark)}/cut-{spark.sparkContext.applicationId}")


def replace(df: DataFrame, path: str) -> None:
    """``df`` in place of the table at ``path``: written beside it, then renamed, so that readers see the one or the other.

    ``df`` may read the table that it replaces.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = path.rstrip("/")
    new, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.parquet(new)
    place, new_place, old_place = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, new, old))
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = files.exists(place)
    if had and not files.rename(place, old_place):
        raise OSError(f"{path} can't be moved")
    if not files.rename(new_place, place):
        if had:
            files.rename(old_place, place)
        raise OSError(f"{path} can't be replaced")
    if had:
        files.delete(old_place, True)


def sent(df: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """``df`` computed once, and marked to be broadcast if its rows, as measured, take few bytes."""
    return measured(cut(df), most)


def measured(rows: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """A table that :func:`cut` wrote, marked to be broadcast if its rows, as measured, take few bytes.

    Beyond that it is joined by a shuffle, whose skewed partitions adaptive execution splits.
    """
    plain = ("string", "binary")
    texts = [F.octet_length(c) for c, kind in rows.dtypes if kind in plain]
    # Arrays and structs by the length of their text form, which is longer than what they take for numbers.
    nested = [F.octet_length(F.to_json(F.struct(c))) for c, kind in rows.dtypes if kind.startswith(("array", "struct"))]
    widths = [F.coalesce(F.sum(w), F.lit(0)) for w in (*texts, *nested)]
    fixed = 24 + 8 * len(rows.columns)
    taken = rows.agg((F.count(F.lit(1)) * fixed + sum(widths, F.lit(0))).alias("bytes")).first()["bytes"]
    return F.broadcast(rows) if taken <= most else rows


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): for each end of an edge (a, b) that has two ends, the least node that edges lead to.

    Each round hooks every node onto its least neighbour if that is smaller, takes the root of the root
    until nothing changes, and leaves the edges between the trees that this makes, by their roots.  Roots
    are least among their neighbours; those still there after a second round are as many as the nodes hooked
    in the first at most.  So two rounds halve the nodes whatever the order of ids, and the loop ends when no
    edge is left.  Joins are on nodes that are unique on one side, and minima are combined before they are
    shuffled, so a node with very many edges doesn't gather in one task.
    """
    # Both directions from one reading: a union would compute the edges twice.
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    left = cut(edges.where("a <> b").select(F.inline(both)).distinct())
    roots = None
    while True:
        trees = cut(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
        while True:
            above = trees.select(F.col("node").alias("to"), F.col("root").alias("top"))
            moved = cut(trees.withColumnRenamed("root", "to").join(above, "to").select("node", F.col("top").alias("root"), F.col("to").alias("was")))
            discard(trees)
            trees = moved.select("node", "root")
            if moved.where("root <> was").isEmpty():
                break
        above = trees.select(F.col("node").alias("to"), F.col("root").alias("top"))
        if roots is None:
            roots = trees
        else:
            lower = cut(roots.join(above, F.col("root") == F.col("to"), "left").select("node", F.coalesce("top", "root").alias("root")))
            discard(roots)
            roots = lower
        ends = left.join(trees.select(F.col("node").alias("a"), F.col("root").alias("c")), "a").join(trees.select(F.col("node").alias("b"), F.col("root").alias("d")), "b")
        fewer = cut(ends.where("c <> d").select(F.col("c").alias("a"), F.col("d").alias("b")).distinct())
        discard(left)
        left = fewer
        if left.isEmpty():
            discard(left)
            return roots
        if roots is not trees:
            discard(trees)
