"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm import (
    html_extraction, line_dedup, merkle, minhash, mixing, packing, quality, sharding, token_counts, toxicity, turn_repair,
    url_filter, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train_chain(docs, _table(spark, sf_dir, "labels"), toxicity.label_categories())
    return toxicity.classify(docs, chain, reject=["toxic"])


def op3_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), max_len=1024, end=2
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, part=85, whole=100)


def op6_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One lasting store for each corpus: what a run has counted, no later run encodes again.
    return token_counts.count_tokens(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
        cache=token_counts.store_of(spark, sf_dir), normalise=token_counts.collapsed, limit=2048,
    )


def op9_merkle_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_repair.damaged(_table(spark, sf_dir, "conversations"))
    return turn_repair.repair(turns, live=F.col("live"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_html_main_text, op2_toxicity_chain, op3_bin_completion, op4_line_dedup, op5_minhash_near_dedup, op6_risk_rules,
    op7_source_mix, op8_token_counts, op9_merkle_prints, op10_feistel_shards, op11_turn_repair, op12_whitening,
    op13_host_reputation,
)}

ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE, "op5_minhash_near_dedup": minhash.oracle(3, 85, 100), "op6_risk_rules": quality.ORACLE, "op7_source_mix": mixing.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE, "op13_host_reputation": url_filter.ORACLE,
}
