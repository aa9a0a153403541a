"""A training corpus from ``documents``: five stages, each written as Parquet before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from photonlake.graph import scratch, shared_folder
from photonlake.llm import decontaminate, jaccard, mixing, sharding, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of these documents, doesn't reject.

    A null or empty text is kept; equal texts fare alike; all columns pass; of an empty table nothing is left.
    Without labels of both kinds there is no model, and all are kept.
    """
    return toxicity.without_toxic(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, over word shingles of five at a similarity of 0.8, the document with the least id.

    Rows without an id take part and stay only if no row that they are linked with has one; rows with the same id
    and text stay once.  Texts without words are linked with nothing and kept; all columns pass.
    """
    return jaccard.first_of_each(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    All rows that share the id of a leaking one go, null being an id; null and empty texts hold nothing and are kept
    unless their id goes; all columns pass; an empty benchmark leaves all.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: some several times, some not at all.

    A null source is a source; null and empty texts have no words and are never taken; ties and repeated rows fare
    as the operator says, reruns agree; all columns pass; an empty table gives an empty one.
    """
    return mixing.mixed(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with size, text_crc32, law, shard, slot and grown_shard.

    A null id is a key like another; repeated rows get a slot each; columns with the name of a result are replaced,
    others pass; an empty table gives an empty one.
    """
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", to_weights),
    ("sharding", to_shards),
]

#: SQL can't express a learned stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the folder of spark.checkpoint.dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
