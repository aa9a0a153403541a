"""Connected components by the names that the training-data operators use; the rest is that of :mod:`photonlake.graph`."""

from __future__ import annotations

from pyspark.sql import DataFrame

from photonlake.graph import connected, cut, discard, measured, sent

__all__ = ["components", "cut", "discard", "measured", "sent"]


def components(edges: DataFrame) -> DataFrame:
    """(id, label): for each end of an edge (u, v), the least id that edges lead to."""
    return connected(edges.toDF("a", "b")).toDF("id", "label")
