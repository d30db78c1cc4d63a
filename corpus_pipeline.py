"""The corpus pipeline: toxicity, near duplicates, benchmark passages, source mix, shards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm import decontaminate, minhash, mixing, sharding, toxicity
from incidentlens.llm.common import materialize, maybe_broadcast, scratch_root, table
from incidentlens.llm.queries import map_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.accepted(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at similarity 0.8 the one with the smallest id stays.

    Rows that repeat an id are one document, of which one row stays.  Rows without an id and with equal shingle sets
    are one document too: one of them stays, or none if a named document has that set.  Without an id and words, a row stays.
    """
    found = minhash.near_duplicates(docs, percent=80, with_node=True)
    unnamed = F.when(F.col("doc_id").isNull(), F.col("node")).alias("node")
    ids = found.groupBy("doc_id", unnamed).agg(F.min("kept").alias("kept"), F.count("*").alias("n"), F.max("component_id").alias("component_id"))
    marks, _ = materialize(
        ids.where("if(doc_id is null, component_id is not null, not kept or n > 1)").select("doc_id", "node", "kept"), "marks"
    )
    named = marks.where("doc_id is not null")
    single = docs.where("doc_id is not null").join(maybe_broadcast(named.select("doc_id"), 16), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.join(maybe_broadcast(named.where("kept").select("doc_id"), 16), "doc_id", "left_semi").select(*docs.columns)
    nameless = minhash.keyed(docs.where("doc_id is null"))
    carried = marks.where("doc_id is null").select(F.col("node").alias("_node"))
    fresh = nameless.where("_node is not null").join(maybe_broadcast(carried, 64), "_node", "left_anti")
    blank = nameless.where("_node is null").select(*docs.columns)
    return single.union(_one_each(repeated, "doc_id", docs.columns)).union(_one_each(fresh, "_node", docs.columns)).union(blank)


def _one_each(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The row with the smallest hash for each key; every task reduces its own rows first, so a frequent key stays small."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")).select("_row.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights."""
    return mixing.mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and place in it: the columns of ``sharding.shard_rows``, then those of ``docs`` that have other names.

    Rows that are equal in every column are copies that the mix made, so one of them carries the columns for all; rows that
    differ in any (nulls count) keep their own.
    """
    whole = F.xxhash64(*[x for c in docs.columns for x in (F.col(c), F.col(c).isNull())])
    keyed = docs.withColumn("_whole", whole)
    placed = sharding.shard_rows(keyed, map_path(spark, sf_dir, "pipeline"), shards=8, carry="_whole")
    text = F.coalesce("text", F.lit(""))
    key = F.struct("_whole", F.col("doc_id").cast("long"), F.crc32(text.cast("binary")), F.octet_length(text))
    once = keyed.select(key.alias("_own"), F.struct(*docs.columns).alias("_row")).groupBy("_own").agg(F.first("_row").alias("_row"))
    same = F.struct("_whole", "doc_id", "text_crc32", (F.col("size") - 1).cast("int"))
    joined = placed.withColumn("_of", same).drop("_whole").join(once, F.col("_of") == F.col("_own"))
    return joined.select(*[c for c in placed.columns if c != "_whole"], *[F.col("_row")[c].alias(c) for c in docs.columns if c not in placed.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("source_mix", mix_sources),
    ("sharding", deal_shards),
]

#: Learned scores, signatures and keyed permutations are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written and read again."""
    docs, root = table(spark, sf_dir, "documents"), f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
