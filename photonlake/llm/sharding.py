"""Sharding by weighted rendezvous hashing, in DataFrame expressions only.

Every record key is hashed with every shard number; the shard with the greatest weighted score
``ln(u) / weight`` owns the key (u uniform in (0, 1)).  A new shard only adds a competitor, so the
keys that move are those it wins, and they all move to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonlake.llm.names import unused

SHARDS = 16
#: Rows that one task numbers, about.
ROWS_PER_CHUNK = 50_000
HASH_BITS = 52


def hash52(text: Column) -> Column:
    """52 bits of MD5 as a long, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def text_of(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def owner(key: Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard, 0 to shards - 1, that owns a key; a null key counts as one more key."""
    weights = [1.0] * shards if weights is None else list(weights)
    if len(weights) != shards or shards < 1 or min(weights) <= 0:
        raise ValueError("each shard needs one positive weight")
    scores = [F.struct((F.log((hash52(F.concat(text_of(key), F.lit(f":{s}"))) + 0.5) / 2.0**HASH_BITS) / F.lit(float(w))).alias("score"), F.lit(-s).alias("s")) for s, w in enumerate(weights)]
    return -(F.greatest(*scores) if shards > 1 else scores[0]).getField("s")


def shard(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    The law is ``key``: key and shard count decide.  size is the text's UTF-8 bytes (null: none) plus 1.
    slot numbers a shard's rows without gaps, in the order of a hash of key and checksum; equal rows
    are interchangeable there.  grown_shard is the shard with one shard more of weight 1.
    A null key is a key like another; a null text has size 1 and no checksum; an empty table gives an
    empty result; repeated rows stay together and get a slot each; an input column that has the name
    of a result is replaced, others are kept.
    """
    count, spark = docs.count(), docs.sparkSession
    each = max(-(-count // (shards * ROWS_PER_CHUNK)), -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    own = {
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
        "text_crc32": F.crc32(F.col(text).cast("binary")),
        "law": F.lit("key"),
        "shard": owner(F.col(key), shards, weights).cast("int"),
        "grown_shard": owner(F.col(key), shards + 1, None if weights is None else [*weights, 1.0]).cast("int"),
    }
    at = hash52(F.concat_ws(":", text_of(F.col(key)), text_of(F.col("text_crc32"))))
    placed = docs.withColumns(own).withColumn("slot", F.struct(at.alias("at"), F.floor(at / (2.0**HASH_BITS / each)).cast("long").alias("chunk")))
    counts = placed.groupBy("shard", F.col("slot.chunk").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    to_shard, to_chunk, earlier = (unused(name, placed) for name in ("to_shard", "to_chunk", "before"))
    before = counts.select(F.col("shard").alias(to_shard), F.col("chunk").alias(to_chunk), (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias(earlier))
    inner = F.row_number().over(Window.partitionBy("shard", "slot.chunk").orderBy("slot.at", key, "size"))
    numbered = placed.withColumn("slot", F.struct("slot.chunk", inner.alias("place")))
    joined = numbered.join(before, (F.col("shard") == F.col(to_shard)) & (F.col("slot.chunk") == F.col(to_chunk)))
    return joined.withColumn("slot", F.col(earlier) + F.col("slot.place") - 1).drop(to_shard, to_chunk, earlier)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _winner(shards: int) -> str:
    scores = ", ".join(f"{{'score': ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':{s}'), 1, 13))::bigint + 0.5) / 4503599627370496.0::double), 's': {-s}}}" for s in range(shards))
    return f"-(list_max([{scores}]).s)"


#: The checksum runs bit by bit over the bytes: a table-free CRC-32.
SQL = f"""
with bytes as (
  select doc_id, text, case when text is null then null when text = '' then []::bigint[]
    else list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint) end as b
  from documents),
steps as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)),
    lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v from range(256) r(i))),
summed as (
  select doc_id, strlen(coalesce(text, '')) + 1 as size,
    case when b is null then null else xor(list_reduce(list_prepend(4294967295::bigint, b),
      lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) end as text_crc32
  from bytes, steps),
placed as (
  select *, {_winner(SHARDS)} as shard, {_winner(SHARDS + 1)} as grown_shard,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || coalesce(text_crc32::varchar, 'null')), 1, 13))::bigint as pos
  from summed)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by pos, doc_id, size) - 1 as slot, grown_shard::int as grown_shard
from placed
"""
