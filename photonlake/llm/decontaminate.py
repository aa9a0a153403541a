"""Benchmark decontamination by spaced seeds, in DataFrame expressions only.

A mask names the positions of SPAN consecutive tokens that are hashed; the others may differ.  The two
MASKS together hit every stretch of WINDOW tokens in which at most ALLOWED are substituted, whichever
they are (a test tries all of them).  Items of fewer than WINDOW tokens have masks of their own, one set
for each length, which hit every copy of the whole item with at most ``allowed`` substitutions.  Hits of test items in documents are verified on their diagonal.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm.graph import cut, sent
from photonlake.llm.names import unused

SPAN = 8
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
WINDOW = 13
ALLOWED = 2
#: An item allows a substitution for so many tokens that it has, and ALLOWED at most.
TOKENS_EACH = 4
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; none for a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def _seeds(hashes: Column) -> Column:
    """For each mask, the hash at each position; the masks' arrays lie one after another and are equally long."""
    places = F.when(F.size(hashes) >= SPAN, F.sequence(F.lit(0), F.size(hashes) - SPAN)).otherwise(F.array().cast("array<int>"))

    def masked(m: int, mask: tuple[int, ...]) -> Column:
        return F.transform(places, lambda i: F.xxhash64(F.lit(m), *(F.get(hashes, i + p) for p in mask)))

    return F.concat(*(masked(m, mask) for m, mask in enumerate(MASKS)))


def allowed(n: int) -> int:
    """The substitutions that an item of n tokens may have: 2 from 8 tokens on, 1 from 4, none below."""
    return min(ALLOWED, n // TOKENS_EACH)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of n tokens: of twice as many blocks as are allowed to differ, each half of them.

    Substitutions touch half of the blocks at most, so one mask at least has none of them.
    """
    differ = allowed(n)
    if not differ:
        return [tuple(range(n))]
    edges = [n * b // (2 * differ) for b in range(2 * differ + 1)]
    halves = itertools.combinations(range(2 * differ), differ)
    return [tuple(p for b in half for p in range(edges[b], edges[b + 1])) for half in halves]


def _short_seeds(hashes: Column, lengths: list[int], whole: bool) -> Column:
    """(seed, place) for each mask of the lengths, at each position, or only of the length that the row has."""
    size, found = F.size(hashes), []
    for n in lengths:
        fits = size == n if whole else size >= n
        places = F.when(fits, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))
        for m, mask in enumerate(short_masks(n)):
            found.append(_placed(hashes, places, f"{n}:{m}", mask))
    return F.concat(*found)


def _placed(hashes: Column, places: Column, name: str, mask: tuple[int, ...]) -> Column:
    return F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(name), *(F.get(hashes, i + p) for p in mask)).alias("seed"), i.alias("place")))


def short_seeds(rows: DataFrame, key: str, text: str, place: str, lengths: list[int], whole: bool) -> DataFrame:
    """(key, seed, place) for items of the lengths: of ``whole`` rows that are such items, or of texts that may hold them."""
    hashed = rows.select(key, F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t)).alias("__h"))
    spread = hashed.select(key, F.explode(_short_seeds(F.col("__h"), lengths, whole)).alias("__s"))
    return spread.select(key, "__s.seed", F.col("__s.place").alias(place))


def seeds(rows: DataFrame, key: str, text: str, place: str) -> DataFrame:
    """(key, seed, place): every seed of every row, with the position of its first token."""
    hashed = rows.select(key, F.transform(tokens(F.col(text)), lambda t: F.xxhash64(t)).alias("__h"))
    spread = hashed.select(key, F.size("__h").alias("__n"), F.posexplode(_seeds(F.col("__h"))).alias("__p", "seed"))
    return spread.select(key, "seed", F.pmod(F.col("__p"), F.col("__n") - (SPAN - 1)).alias(place))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, compared, best, start): the documents that hold a part of a test item.

    A pair is found if, along some alignment, a stretch of WINDOW tokens of the item differs from the document
    in at most ALLOWED; of an item that has fewer, all tokens count and ``allowed`` of them may differ.  ``best`` is the greatest number of equal
    tokens of such a stretch, ``matched`` and ``compared`` those of the whole alignment, ``start`` the
    item's first token in the document (negative where the document begins within the item).  Of several
    alignments the one with most equal tokens counts, then the first.

    Items of one to three tokens are found where they stand exactly; null and empty texts have no
    tokens; a null id is an id; repeated rows give one result; other columns change nothing.
    """
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", F.col("text").alias("item")).distinct()
    size = F.size(tokens(F.col("item")))
    test = seeds(items.where(size >= WINDOW), "item_id", "item", "j").distinct()
    hits = seeds(docs, "doc_id", "text", "i").join(sent(test), "seed").select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("start"))
    lengths = sorted(r["n"] for r in items.select(size.alias("n")).where((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().collect())  # WINDOW - 1 rows at most
    if lengths:
        test = short_seeds(items, "item_id", "item", "j", lengths, True).distinct()
        hits = hits.union(short_seeds(docs, "doc_id", "text", "i", lengths, False).join(sent(test), "seed").select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("start")))
    hits = cut(hits.distinct())
    words = items.select(F.col("item_id").alias("of"), tokens(F.col("item")).alias("t"))
    sizes = words.groupBy("of").agg(F.max(F.size("t")).alias("n"))
    # Of a document with hits, only the tokens along each alignment go on.
    places = hits.join(sent(sizes), hits["item_id"].eqNullSafe(F.col("of"))).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("item_id", "start", "n")).alias("at"))
    own = docs.join(sent(places), docs["doc_id"].eqNullSafe(F.col("id"))).select("doc_id", tokens(F.col("text")).alias("w"), "at")
    begin = lambda h: F.greatest(F.lit(0), -h["start"])
    part = lambda h: F.slice("w", F.greatest(F.lit(0), h["start"]) + 1, F.greatest(F.lit(0), h["n"] - begin(h)))
    parts = own.select("doc_id", F.explode(F.transform("at", lambda h: F.struct(h["item_id"].alias("item_id"), h["start"].alias("start"), begin(h).alias("first"), part(h).alias("part")))).alias("x"))
    pairs = parts.select("doc_id", "x.*").join(words, F.col("item_id").eqNullSafe(F.col("of")))
    first = F.col("first")
    last = F.least(F.size("t"), first + F.size("part"))
    along = pairs.where(last > first).select("doc_id", "item_id", "start", F.transform(F.sequence(first, last - 1), lambda j: F.when(F.get("t", j) == F.get("part", j - first), 1).otherwise(0)).alias("same"), F.least(F.lit(WINDOW), F.size("t")).alias("width"))
    run = F.when(F.size("same") >= F.col("width"), F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - F.col("width") + 1), lambda s: _total(F.slice("same", s, F.col("width")))))).otherwise(0)
    scored = along.select("doc_id", "item_id", "start", _total(F.col("same")).cast("long").alias("matched"), F.size("same").cast("long").alias("compared"), run.cast("long").alias("best"), "width")
    good = scored.where(F.col("best") >= F.col("width") - F.least(F.lit(ALLOWED), F.floor(F.col("width") / TOKENS_EACH)))
    top = F.max(F.struct("matched", (-F.col("start")).cast("long").alias("early"), "compared", "best")).alias("top")
    return good.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "top.matched", "top.compared", "top.best", (-F.col("top.early")).alias("start"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id no row with a part of a test item has; null ids count as one id.  All columns pass."""
    id_ = unused("id", docs)
    found = sent(overlaps(docs, benchmark).select(F.col("doc_id").alias(id_)).distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(id_)), "left_anti")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mask_sql(mask: tuple[int, ...], m: int) -> str:
    return f"list_transform(range(1, greatest(len(w) - {SPAN - 2}, 1)), lambda i: {{'p': i, 's': '{m}' || " + " || ' ' || ".join(f"w[i + {p}]" for p in mask) + "})"


_SEEDS_SQL = " || ".join(_mask_sql(mask, m) for m, mask in enumerate(MASKS))
SQL = f"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from documents where text is not null),
b as (select item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from benchmark where text is not null),
ds as (select doc_id, unnest({_SEEDS_SQL}) as x from d),
bs as (select item_id, unnest({_SEEDS_SQL}) as x from b),
hits as (select distinct doc_id, item_id, ds.x.p - bs.x.p as start from ds join bs on ds.x.s = bs.x.s),
along as (select h.*, least({WINDOW}, len(b.w)) as width,
    list_transform(range(greatest(0, -h.start), least(len(b.w), len(d.w) - h.start)), lambda j: (b.w[j + 1] = d.w[j + 1 + h.start])::int) as same
  from hits h join d using (doc_id) join b using (item_id)),
scored as (select *, list_sum(same)::bigint as matched, len(same) as compared,
    coalesce(list_max(list_transform(range(1, len(same) - width + 2), lambda s: list_sum(same[s:s + width - 1]))), 0)::bigint as best from along)
select doc_id, item_id, matched, compared, best, start from scored where best >= width - {ALLOWED}
qualify row_number() over (partition by doc_id, item_id order by matched desc, start) = 1
"""
