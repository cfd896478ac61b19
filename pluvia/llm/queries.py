"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm import (
    bond_negatives, collinear_dedup, extendible_sharding, id_store, merkle_manifest, minhash_dedup, order_sampling, prefix_bpe,
    robust_quality, segment_topk, syncmers, toxicity, url_reputation,
)
from pluvia.llm.url_reputation import Rule

RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
         Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]
SOURCE_WEIGHTS = [5, 2, 1]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
SHARD_BYTES = 4 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return collinear_dedup.repeated_passages(table(spark, folder, "documents"))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes are the quality labels of the same number as the page."""
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_reputation.judge(table(spark, folder, "pages"), outcomes, RULES)


def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    got = order_sampling.mix(table(spark, folder, "documents"), SOURCE_WEIGHTS)
    return got.select("doc_id", "size", "source_size", "target", "taken")


def op5(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_bpe.digests(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return extendible_sharding.shard(table(spark, folder, "documents"), SHARD_BYTES)


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"), k=4, percent=80)


def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return id_store.write(docs, VOCABULARY, END_ID).read(docs)


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return segment_topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return robust_quality.judge(table(spark, folder, "documents"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.compare(table(spark, folder, "documents"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.verified(merkle_manifest.build(table(spark, folder, "documents")))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh label is wrong, as the query's contract has it."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond_negatives.mine(table(spark, folder, "embeddings").withColumn("label", wrong), F.col("vec_id") % 50 == 0)


Q = {
    "op1_collinear_dedup": op1,
    "op2_url_reputation": op2,
    "op3_toxicity": op3,
    "op4_order_sampling": op4,
    "op5_prefix_bpe": op5,
    "op6_extendible_sharding": op6,
    "op7_minhash_dedup": op7,
    "op8_id_store": op8,
    "op9_segment_topk": op9,
    "op10_robust_quality": op10,
    "op11_closed_syncmers": op11,
    "op12_merkle_manifest": op12,
    "op13_bond_negatives": op13,
}
