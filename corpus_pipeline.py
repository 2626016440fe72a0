"""A corpus pipeline over ``documents``: each stage's result is the next one's input.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``.  :func:`run` applies them one after the other, each result written as
Parquet to the session's shared folder and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm import line_dedup, minhash, mixing, packing, toxicity
from formloom.session import shared_dir, stage, staging


def _carried(docs: DataFrame) -> DataFrame:
    """The rows as one column beside their id and text, so that no column's name can
    clash with those that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train_chain(docs, labels, toxicity.label_categories())
    judged = toxicity.classify(_carried(docs), chain, reject=["toxic"], keep=True)
    return judged.where("not rejected").select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go; so do documents of which no word is left.

    ``n_chars``, where there is one, follows the text.  Documents that had no word
    before stay.
    """
    has_word = r"[^\x20\x09-\x0D]"
    left = line_dedup.dedup_lines(_carried(docs), report=True)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(has_word), F.lit(False))
    row = F.col("_row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.where(~emptied).select(row.alias("_row")).select("_row.*")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of the least id.

    Rows are told apart by a number of their own, so repeated ids and null ones are
    rows like any other.
    """
    rows = stage(_carried(docs).withColumn("_n", F.monotonically_increasing_id()), "numbered-documents")
    found = minhash.near_duplicates(rows.select("_n", "text"), key="_n", shingle=5, part=80, whole=100)
    grouped = found.where("_n <> component_id").select(F.col("component_id").alias("_group")).distinct()
    members = found.join(grouped, F.col("component_id") == F.col("_group"), "left_semi").select("_n", "component_id")
    members = stage(members.join(rows.select("_n", "doc_id"), "_n"), "group-members")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_n").alias("n"))
    stays = members.groupBy("component_id").agg(F.min(rank).alias("r")).select(F.col("r.n").alias("_n"))
    gone = members.select("_n").join(stays, "_n", "left_anti")
    return rows.join(gone, "_n", "left_anti").select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mix(docs, weights=(5, 2, 1), cap=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_len=1024, end=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The trained chain and the tokenizer can't be written in SQL; tests/llm holds the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        with staging(spark):  # what a stage sets aside goes when its result is written
            path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
            step(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
