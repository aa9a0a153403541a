"""Near-duplicates: pairs of perceptual hashes within a distance, their groups and ranks.

Hashes of 64 bits within 12 or more of each other share no part that would make a selective key, so they are
compared all with all, but in tiles of packed numbers: a pair that isn't near is never a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonlake import tiles
from photonlake.config import QUALITY_EPSILON, clamp_limit, effective_threshold
from photonlake.functions.columns import hamming
from photonlake.graph import connected, cut
from photonlake.operators.duplicates import keep_order


def candidates(photos: DataFrame, by: tuple[str, ...] = ("library_id",)) -> DataFrame:
    """Files with a perceptual hash, one per content: of exact copies the keeper, unhashed contents each for itself."""
    own = photos.where("phash is not null and state <> 'missing'")
    content = F.coalesce("sha256", F.concat(F.lit("id:"), F.col("photo_id")))
    first = own.groupBy(*by, content.alias("content")).agg(F.min_by(F.struct("photo_id", "phash", "width", "height", "file_size_bytes", "relative_path", "quality_score"), keep_order()).alias("x"))
    return first.select(*by, "x.*").withColumn("pixels", F.col("width").cast("long") * F.col("height").cast("long"))


def pairs(rows: DataFrame, threshold: int, by: tuple[str, ...] = ("library_id",)) -> DataFrame:
    """(by, hash_a, hash_b, distance): different hashes, a before b as signed numbers, within the threshold.

    Files of the same hash count once here.
    """
    threshold = effective_threshold(threshold)
    hashes = rows.select(*by, "phash").distinct()

    def near(g: int, x: tiles.Columns, y: tiles.Columns | None) -> pa.RecordBatch:
        a, b = x["phash"], x["phash"] if y is None else y["phash"]
        found = [[], [], []]
        for part in tiles.blocks(len(a), len(b)):
            apart = np.bitwise_count((a[part, None] ^ b[None]).view(np.uint64))
            i, j = np.nonzero(apart <= threshold)
            left, right = a[part][i], b[j]
            # A tile with itself gives each pair twice, and each hash with itself.
            once = left < right if y is None else np.ones(len(i), bool)
            for own, values in zip(found, (np.minimum(left, right), np.maximum(left, right), apart[i, j]), strict=True):
                own.append(values[once])
        ends = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in found]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ends[0]), g, np.int64)), pa.array(ends[0]), pa.array(ends[1]), pa.array(ends[2].astype(np.int32))], names=["g", "hash_a", "hash_b", "distance"])

    made = tiles.numbered(hashes, by)
    found = tiles.compared(tiles.units(hashes, made, by, ("phash",)), ("phash",), near, "g long, hash_a long, hash_b long, distance int")
    return found.join(made, "g").select(*by, "hash_a", "hash_b", "distance")


RANKED = ("place", "phash", "quality_score")


def _fights(g: int, x: tiles.Columns, y: tiles.Columns | None) -> pa.RecordBatch:
    """(g, place, losses, widest): how many of the other side are better than each row, and how far the farthest is."""
    other = x if y is None else y
    n, m = len(x["place"]), len(other["place"])
    lost, widest = [np.zeros(n, np.int64), np.zeros(m, np.int64)], [np.zeros(n, np.int32), np.zeros(m, np.int32)]
    for part in tiles.blocks(n, m):
        apart = np.bitwise_count((x["phash"][part, None] ^ other["phash"][None]).view(np.uint64))
        lead = x["quality_score"][part, None] - other["quality_score"][None]  # unmeasured ones are NaN
        wins = np.where(np.abs(lead) > QUALITY_EPSILON, lead > 0, x["place"][part, None] < other["place"][None])
        lost[0][part] = m - wins.sum(1)
        lost[1] += wins.sum(0)
        widest[0][part] = apart.max(1)
        np.maximum(widest[1], apart.max(0), out=widest[1])
    if y is None:
        place, losses, far = x["place"], lost[0] - 1, widest[0]  # a row doesn't win against itself
    else:
        place, losses, far = np.concatenate([x["place"], other["place"]]), np.concatenate(lost), np.concatenate(widest)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), g, np.int64)), pa.array(place.astype(np.int64)), pa.array(losses), pa.array(far)], names=["g", "place", "losses", "widest"])


def groups(rows: DataFrame, threshold: int, by: tuple[str, ...] = ("library_id",)) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of candidates connected by pairs within the threshold, transitively.

    A group is named by its least photo_id.  Members are ranked by the number of members that are better
    (quality if it differs clearly, then pixels, size and path), so the order doesn't depend on a sort of
    a relation that isn't transitive; rank 1 is kept, and distances are to it.
    """
    threshold = effective_threshold(threshold)
    first = rows.groupBy(*by, "phash").agg(F.min("photo_id").alias("node"))
    near = pairs(rows, threshold, by)
    ends = [first.select(*by, F.col("phash").alias(h), F.col("node").alias(n)) for h, n in (("hash_a", "a"), ("hash_b", "b"))]
    arcs = near.join(ends[0], [*by, "hash_a"]).join(ends[1], [*by, "hash_b"]).select("a", "b")
    same = rows.join(first, [*by, "phash"]).where("photo_id <> node").select(F.col("photo_id").alias("a"), F.col("node").alias("b"))
    roots = connected(arcs.union(same))
    own = rows.join(roots, F.col("photo_id") == F.col("node")).drop("node").withColumnRenamed("root", "group_id")
    order = Window.partitionBy("group_id").orderBy(F.desc("pixels"), F.desc("file_size_bytes"), keep_order())
    own = cut(own.withColumn("place", F.row_number().over(order).cast("long")))
    made = tiles.numbered(own, ("group_id",))
    work = tiles.units(own.withColumn("quality_score", F.col("quality_score").cast("double")), made, ("group_id",), RANKED)
    beaten = tiles.compared(work, RANKED, _fights, "g long, place long, losses long, widest int")
    beaten = beaten.groupBy("g", "place").agg(F.sum("losses").alias("losses"), F.max("widest").alias("widest")).join(made.select("g", "group_id"), "g").drop("g")
    ranked = own.join(beaten, ["group_id", "place"])
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy("losses", "place")))
    keep = ranked.where("rank = 1").select("group_id", F.col("photo_id").alias("suggested_keep_photo_id"), F.col("phash").alias("keep_hash"), F.col("file_size_bytes").alias("keep_bytes"))
    ranked = ranked.join(keep, "group_id").withColumn("distance", hamming(F.col("phash"), F.col("keep_hash")))
    found = ranked.groupBy(*by, "group_id", "suggested_keep_photo_id").agg(
        F.count(F.lit(1)).alias("photo_count"), F.lit(threshold).alias("threshold"), F.max("widest").alias("max_distance"), F.greatest(F.sum("file_size_bytes") - F.max("keep_bytes"), F.lit(0)).alias("reclaimable_bytes")
    )
    return found, ranked.select(*by, "group_id", "photo_id", "relative_path", "distance", "rank")


def listing(made: DataFrame, members: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of groups, largest first, each with its members by rank; chained if wider than the threshold."""
    page = made.orderBy(F.desc("photo_count"), F.desc("reclaimable_bytes"), "group_id").offset(max(offset, 0)).limit(clamp_limit(limit, 50, 200))
    nested = members.join(F.broadcast(page.select("group_id")), "group_id").groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("rank", "photo_id", "distance"))).alias("members"))
    return page.join(nested, "group_id").withColumn("chained", F.col("max_distance") > F.col("threshold"))


def summary(photos: DataFrame, made: DataFrame) -> DataFrame:
    counts = photos.agg(F.count_if(F.col("phash").isNotNull()).alias("hashed"), F.count_if(F.col("phash").isNull() & ~F.col("state").isin("missing", "failed")).alias("to_hash"))
    totals = made.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("photo_count"), F.lit(0)).alias("photos"),
        F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"),
        F.count_if(F.col("max_distance") > F.col("threshold")).alias("chained"),
    )
    return counts.crossJoin(F.broadcast(totals))
