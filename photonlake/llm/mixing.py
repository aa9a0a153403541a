"""Mixing sources to target weights by weighted fair queueing, in DataFrame expressions only.

The documents of a source queue in a shuffled order; the e-th round of a document has the virtual
finish time (words of the source so far, repeats counted) / (target of the source).  The mix takes
rounds in the order of finish times until the total budget is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photonlake.llm.graph import cut, sent
from photonlake.llm.names import unused
from photonlake.llm.sharding import HASH_BITS, hash52, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: A document is taken so often at most.
ROUNDS = 3
WEIGHTS = (1, 2, 3)
#: Rows that one task orders, about.
ROWS_PER_CHUNK = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """(source, source_size) with rank, and target: its share of all words by weight, at most rounds times its size.

    Sources in code point order, null last, weigh ``weights`` in turn.  The level x at which the sum of
    min(cap, weight * x) is the total is the greatest (total - caps before) / (weights from here on),
    with sources ordered by cap / weight.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")), "cap": F.col("source_size") * rounds})
    all_rows = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.sum("source_size").over(all_rows) - (F.sum("cap").over(by_ratio) - F.col("cap"))) / (F.sum("weight").over(all_rows) - F.sum("weight").over(by_ratio) + F.col("weight"))
    found = ranked.withColumn("level", level).withColumn("level", F.max("level").over(all_rows))
    return found.select("source", "source_size", "rank", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, source, size, copies, source_size, target, repeats): how often the mix takes each document.

    Rows with the same doc_id, source and size are one entry with their number as ``copies``; the mix
    takes all of them or none in a round.  A null source is a source, the last; a null id is an id;
    a null or empty text has size 0 and is never taken, as is one whose source has no words.  Other
    columns are ignored; an empty table gives an empty result.  The words taken never exceed the total.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = cut(own.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    sources = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, rounds)
    each = max(-(-rows.count() // ROWS_PER_CHUNK), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = hash52(F.concat_ws("|", text_of(F.col("doc_id")), F.col("size")))
    rows = rows.withColumn("at", at).withColumn("chunk", F.floor(F.col("at") / (2.0**HASH_BITS / each)).cast("long")).withColumn("words", F.col("size") * F.col("copies"))
    # Running sums within a source: within a chunk of its hash range, plus those of the chunks before.
    sums = rows.groupBy("source", "chunk").agg(F.sum("words").alias("n"))
    before = sums.select(F.col("source").alias("of"), F.col("chunk").alias("to"), (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    within = F.sum("words").over(Window.partitionBy("source", "chunk").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queued = rows.withColumn("within", within).join(before, F.col("source").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("to")))
    queued = queued.select("doc_id", "source", "size", "copies", "words", "at", (F.col("before") + F.col("within")).alias("upto"))
    known = sources.select(F.col("source").alias("of"), "source_size", "rank", "target")
    queued = cut(queued.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    last = _last(queued, each, rounds)
    taken = [F.when(_key_at_most(e, last, rounds), 1).otherwise(0) for e in range(rounds)]
    repeats = sum(taken[1:], taken[0]) if last else F.lit(0)
    return queued.select("doc_id", "source", "size", "copies", "source_size", "target", F.when(F.col("size") > 0, repeats).otherwise(0).alias("repeats"))


def _finish(e: int | Column) -> Column:
    return (e * F.col("source_size") + F.col("upto")) / F.col("target")


def _key_at_most(e: int, last: tuple | None, rounds: int) -> Column:
    """Whether round e comes no later than the last round taken."""
    if last is None:
        return F.lit(False)
    finish, tie, at = last
    own, same = _finish(e), F.col("rank") * rounds + e
    return (F.col("size") > 0) & ((own < finish) | (own == finish) & ((same < tie) | (same == tie) & (F.col("at") <= at)))


def _last(queued: DataFrame, each: int, rounds: int) -> tuple | None:
    """The order key of the last round within the budget; None if nothing can be taken.

    Finish times are dealt into ranges; sums of the ranges show in which one the budget ends, and only
    its rounds are put in order.
    """
    turns = queued.where("size > 0 and target > 0").select("*", F.explode(F.array(*map(F.lit, range(rounds)))).alias("e"))
    turns = turns.select(_finish(F.col("e")).alias("finish"), (F.col("rank") * rounds + F.col("e")).alias("tie"), "at", "words").withColumn("range", F.floor(F.least(F.col("finish"), F.lit(4.0)) * each).cast("long"))
    sums = turns.groupBy("range").agg(F.sum("words").alias("n"), F.max(F.struct("finish", "tie", "at")).alias("top"))
    total = queued.agg(F.sum("words")).first()[0]
    upto = sums.withColumn("upto", F.sum("n").over(Window.orderBy("range")))
    full = upto.where(F.col("upto") <= F.lit(total)).agg(F.max("range"), F.max("upto"), F.max_by("top", "range")).first()
    over = upto.where(F.col("upto") > F.lit(total)).agg(F.min("range")).first()[0]
    best = None if full[0] is None else tuple(full[2])
    if over is not None:
        order = Window.orderBy("finish", "tie", "at")
        fits = turns.where(F.col("range") == over).withColumn("sum", F.sum("words").over(order) + F.lit(full[1] or 0)).where(F.col("sum") <= F.lit(total))
        more = fits.agg(F.max(F.struct("finish", "tie", "at"))).first()[0]
        best = tuple(more) if more else best
    return best


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as many times as it is repeated, some not at all."""
    name = unused("mix", docs)
    found = mix(docs, weights, rounds).where("repeats > 0").select(F.struct(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("n"), F.col("repeats").alias("r")).alias(name))
    found = sent(found)
    same = docs["doc_id"].eqNullSafe(F.col(f"{name}.d")) & docs["source"].eqNullSafe(F.col(f"{name}.s")) & (n_words(docs["text"]) == F.col(f"{name}.n"))
    return docs.join(found, same).withColumn(name, F.explode(F.sequence(F.lit(1), F.col(f"{name}.r")))).drop(name)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


SQL = """
with docs as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
sizes as (select source, sum(size)::bigint as source_size from docs group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as rank from sizes),
weighed as (select *, rank % 3 + 1 as weight, 3 * source_size as cap from ranked),
levels as (select *, ((select sum(source_size)::bigint from sizes) - (sum(cap) over f - cap)) / ((select sum(weight) from weighed) - sum(weight) over f + weight) as level
  from weighed window f as (order by cap / weight, rank rows unbounded preceding)),
targets as (select source, source_size, rank, least(cap::double, weight * (select max(level) from levels)) as target from levels),
queued as (
  select d.*, t.* exclude (source), sum(d.size) over (partition by d.source order by d.pos, d.doc_id, d.size rows unbounded preceding) as upto
  from (select *, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '|' || size), 1, 13))::bigint as pos from docs) d
  join targets t on d.source is not distinct from t.source),
turns as (select doc_id, source, size, (e * source_size + upto)::bigint / target as finish, rank * 3 + e as tie, pos, size as words
  from queued, (values (0), (1), (2)) v(e) where size > 0 and target > 0),
run as (select *, sum(words) over (order by finish, tie, pos) as total from turns),
hits as (select doc_id, source, size, count(*) as n from run where total <= (select sum(source_size) from sizes) group by all)
select q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(h.n, 0))::bigint as taken
from queued q left join hits h on q.doc_id is not distinct from h.doc_id and q.source is not distinct from h.source and q.size = h.size
"""
