"""Fixity of WARC replicas by Merkle trees over offset ranges.

Records are hashed; the hashes of the records that begin in a range of RANGE bytes of a file, in the
order of their offsets, make the hash of the range; FANOUT ranges make one of the next level, a file's
ranges make its root, FANOUT files one of the next level, and so on to one root.  Two replicas with the
same root are the same.  Otherwise only nodes below a mismatching node are compared, level by level,
down to the records.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonlake.llm.graph import cut, measured
from photonlake.llm.sharding import HASH_BITS, hash52, text_of

RANGE = 1 << 16
FANOUT = 16
#: Bytes of a file, about.
FILE_BYTES = 1 << 22


class Tree(NamedTuple):
    """``records`` (file, offset, length, sha256) and nodes (file, place, sha256) level by level, the last with the root."""

    records: DataFrame
    levels: list[DataFrame]


def record_head(url: Column, key: Column, length: Column) -> Column:
    lines = [F.lit("WARC/1.0"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))), F.concat(F.lit("WARC-Record-ID: "), text_of(key)), F.concat(F.lit("Content-Length: "), length)]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def records(pages: DataFrame, file_bytes: int = FILE_BYTES, more: dict[str, Column] | None = None) -> DataFrame:
    """(page_id, file, offset, length, sha256): where each page's WARC record lies, and its hash.

    Pages are read once; only this and the columns ``more``, made of a page's own columns, is put in order.
    Pages are dealt to files by a hash of their record, and lie there in the order of that hash.  A null
    url or html counts as empty, a null page_id as the text null; equal rows are records of their own.  Other
    columns change nothing; an empty table has no records.
    """
    more = more or {}
    body = F.octet_length(F.coalesce("html", F.lit("")))
    whole = F.concat(record_head(F.col("url"), F.col("page_id"), body), F.coalesce("html", F.lit("")), F.lit("\r\n\r\n"))
    made = pages.select("page_id", F.octet_length(whole).cast("long").alias("length"), F.sha2(whole.cast("binary"), 256).alias("sha256"), *(c.alias(name) for name, c in more.items()))
    made = cut(made)
    total = made.agg(F.sum("length")).first()[0] or 0
    files = max(1, -(-int(total) // file_bytes))
    at = hash52(F.concat_ws("|", text_of(F.col("page_id")), F.col("sha256")))
    placed = made.select("*", at.alias("at")).withColumn("file", F.floor(F.col("at") / (2.0**HASH_BITS / files)).cast("long"))
    order = Window.partitionBy("file").orderBy("at", "sha256").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("page_id", "file", (F.sum("length").over(order) - F.col("length")).alias("offset"), "length", "sha256", *more)


def _join(hashes: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(hashes), lambda x: x["h"]), "").cast("binary"), 256)


def _above(nodes: DataFrame, file: Column, place: Column) -> DataFrame:
    """Nodes of the next level; a node has as many children as its range holds."""
    keyed = nodes.select(file.alias("up_file"), place.alias("up_place"), F.struct("file", "place", F.col("sha256").alias("h")).alias("x"))
    return keyed.groupBy(F.col("up_file").alias("file"), F.col("up_place").alias("place")).agg(_join(F.collect_list("x")).alias("sha256"))


def parents(level: int) -> tuple[Column, Column]:
    """(file, place) of the parent of a node of a level: two levels of ranges, then files."""
    none = F.lit(0).cast("long")
    if level == -1:
        return F.col("file"), F.floor(F.col("place") / RANGE)
    if level == 0:
        return F.col("file"), F.floor(F.col("place") / FANOUT)
    if level == 1:
        return F.col("file"), none
    return F.floor(F.col("file") / FANOUT), none


def tree(rows: DataFrame, files: int) -> Tree:
    """The tree of records (file, offset, length, sha256) of at most ``files`` files."""
    own = rows.select("file", "offset", "length", "sha256")
    nodes = own.select("file", F.col("offset").alias("place"), "sha256")
    levels: list[DataFrame] = []
    left, level = files, -1
    while level < 2 or left > 1:
        nodes = cut(_above(nodes, *parents(level)))
        levels.append(nodes)
        level += 1
        left = -(-left // FANOUT) if level > 2 else left
    return Tree(own, levels)


def differing(a: Tree, b: Tree) -> DataFrame:
    """(file, offset, status): the records of ``a`` that ``b`` has not (missing) or has otherwise (changed), and those only in ``b`` (extra).

    Only children of nodes that differ are compared, and only their records are.
    """
    if len(a.levels) != len(b.levels):
        raise ValueError("the trees cover different numbers of files")
    suspect: DataFrame | None = None
    for level in range(len(a.levels) - 1, -2, -1):
        name = ["file", "place"]
        left, right = ((t.levels[level] if level >= 0 else t.records.withColumnRenamed("offset", "place")).select(*name, "sha256") for t in (a, b))
        if suspect is not None:
            above = suspect.select(F.col("file").alias("up_file"), F.col("place").alias("up_place"))
            file, place = parents(level)
            left, right = (x.join(measured(above), (file == F.col("up_file")) & (place == F.col("up_place")), "left_semi") for x in (left, right))
        both = left.withColumnRenamed("sha256", "own").join(right.withColumnRenamed("sha256", "other"), name, "full")
        suspect = both.where(~F.col("own").eqNullSafe(F.col("other")))
        suspect = cut(suspect) if level >= 0 else suspect
    status = F.when(F.col("other").isNull(), "missing").when(F.col("own").isNull(), "extra").otherwise("changed")
    return suspect.select("file", F.col("place").alias("offset"), status.alias("status"))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, offset, length, sha256, file_root, status) of every record of either replica; status ok, changed, missing or extra.

    ``a`` and ``b`` have (file, offset, length, sha256), with at most one record at an offset of a file.
    The root is that of a's file, null where it has none.  Records that the descent doesn't reach are ok without
    being compared.  Empty replicas give an empty result.
    """
    files = max([int(x.agg(F.max("file")).first()[0] or 0) for x in (a, b)]) + 1
    left, right = tree(a, files), tree(b, files)
    found = measured(cut(differing(left, right)))
    roots = measured(left.levels[2]).select(F.col("file"), F.col("sha256").alias("file_root"))
    own = a.select("file", "offset", "length", "sha256").join(found, ["file", "offset"], "left")
    extra = b.select("file", "offset", "length", "sha256").join(found.where("status = 'extra'"), ["file", "offset"])
    return own.union(extra).join(roots, "file", "left").select("file", "offset", "length", "sha256", "file_root", F.coalesce("status", F.lit("ok")).alias("status"))


#: In the query, the replica lost or altered the records of these pages.
DAMAGED, LOST = (50, 7), (500, 123)


def damaged(rows: DataFrame) -> DataFrame:
    """A replica of ``rows`` (with ``altered``) in which some records have another byte and some are gone; null ids and empty tables stay as they are."""
    lost = F.coalesce(F.pmod(F.col("page_id"), F.lit(LOST[0])) == LOST[1], F.lit(False))
    return rows.where(~lost).withColumn("sha256", F.coalesce("altered", "sha256"))


def altered() -> Column:
    """The hash of another record in place of a page that the replica has altered; null for others."""
    hit = F.pmod(F.col("page_id"), F.lit(DAMAGED[0])) == DAMAGED[1]
    return F.when(hit, F.sha2(F.concat(F.lit("#"), F.coalesce("html", F.lit(""))).cast("binary"), 256))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(records(spark.read.parquet(f"{sf_dir}/pages.parquet"), more={"altered": altered()}))
    found = audit(rows, damaged(rows))
    return found.join(rows.select("file", "offset", "page_id"), ["file", "offset"]).select("page_id", "file", "offset", "length", "sha256", "file_root", "status")


SQL = f"""
with r as (select page_id, html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Record-ID: ' || coalesce(page_id::varchar, 'null') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as rec from pages),
h as (select page_id, strlen(rec)::bigint as length, sha256(rec) as sha256 from r),
p as (select *, ('0x' || substr(md5(coalesce(page_id::varchar, 'null') || '|' || sha256), 1, 13))::bigint as pos from h),
f as (select *, floor(pos / (4503599627370496.0::double / greatest(1, (select ceil(sum(length) / {FILE_BYTES}.0) from h))))::bigint as file from p),
o as (select *, (sum(length) over (partition by file order by pos, sha256 rows unbounded preceding) - length)::bigint as "offset" from f),
l0 as (select file, "offset" // {RANGE} as place, sha256(string_agg(sha256, '' order by "offset")) as n from o group by all),
l1 as (select file, place // {FANOUT} as place, sha256(string_agg(n, '' order by place)) as n from l0 group by file, place // {FANOUT}),
l2 as (select file, sha256(string_agg(n, '' order by place)) as n from l1 group by file)
select page_id, file, "offset", length, sha256, n as file_root,
  case when page_id % {LOST[0]} = {LOST[1]} then 'missing' when page_id % {DAMAGED[0]} = {DAMAGED[1]} then 'changed' else 'ok' end as status
from o join l2 using (file)
"""
