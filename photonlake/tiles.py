"""Rows of a group compared with each other in vectorised blocks, without a row for each pair.

A group is dealt into tiles by hash; each two of its tiles, and each tile with itself, are a unit of work, so
that a large group is spread over many tasks, each of which holds two tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.graph import cut, measured

#: Rows of a tile, about.
TILE = 8192
#: Pairs whose comparison is in memory at a time.
BLOCK = 1 << 20
Columns = dict[str, np.ndarray]


def numbered(rows: DataFrame, by: tuple[str, ...], most: int = TILE) -> DataFrame:
    """(by, g, tiles): each group with a number and how many tiles it has."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("tiles"))
    return cut(counts.withColumn("g", F.monotonically_increasing_id()))


def units(rows: DataFrame, groups: DataFrame, by: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """(g, a, b, side, values): the rows for each unit they take part in; side 1 is the tile b of a unit of two."""
    sent = measured(groups)
    own = rows.join(sent, list(by)) if by else rows.crossJoin(F.broadcast(sent))  # without groups: one row
    tile = F.pmod(F.xxhash64(*values), F.col("tiles")).cast("int")
    placed = own.select("g", *values, tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    return placed.select("g", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), (F.col("other") < F.col("tile")).cast("int").alias("side"), *values)


def compared(rows: DataFrame, values: tuple[str, ...], work: Callable[[int, Columns, Columns | None], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` (g, side 0, side 1 or None for a tile with itself) on each unit of :func:`units`."""
    key = ("g", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[list[Columns]] = [[], []]

        def close() -> pa.RecordBatch:
            sides = [{c: np.concatenate([p[c] for p in parts]) for c in values} if parts else None for parts in held]
            return work(now[0], sides[0], None if now[1] == now[2] else sides[1]) if sides[0] is not None else None

        for batch in batches:
            unit = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*key, "side")], 1)
            data = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in values}
            edges = np.concatenate([[0], np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1, [len(unit)]])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if tuple(unit[lo, :3].tolist()) != now:
                    if now is not None and (out := close()) is not None:
                        yield out
                    now, held = tuple(unit[lo, :3].tolist()), [[], []]
                held[unit[lo, 3]].append({c: v[lo:hi] for c, v in data.items()})
        if now is not None and (out := close()) is not None:
            yield out

    return rows.repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(run, schema)


def blocks(n: int, width: int) -> Iterator[slice]:
    """Rows 0 to n - 1 in steps whose comparison with ``width`` others is BLOCK pairs, about."""
    step = max(1, BLOCK // max(width, 1))
    for at in range(0, n, step):
        yield slice(at, min(at + step, n))
