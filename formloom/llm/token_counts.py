"""Token counts through a digest cache.

Each text's normalised content has a digest, the tokenizer file has another; the
two together are the key of a stored count.  A run joins its texts to the store,
encodes every distinct text that the store lacks once, appends those counts, and
reads all counts from the store.  A text met again, in this table or in a later
run, is never encoded again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import join_hot, text_of
from formloom.llm.tokenization import encoder
from formloom.session import shared_dir, stage

SCHEMA = "version string, digest binary, n_tokens bigint"


def version_of(path: str) -> str:
    """The digest of a tokenizer file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def store_of(spark: SparkSession, corpus: str) -> str:
    """The folder of a corpus' lasting store, in shared storage."""
    return f"{shared_dir(spark)}/token-counts/{hashlib.sha256(corpus.rstrip('/').encode()).hexdigest()[:16]}"


def collapsed(text: Column) -> Column:
    """Runs of plain white space as one blank: the same count under tokenizers that
    drop white space."""
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")


def unchanged(text: Column) -> Column:
    return text


def _encode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            yield pd.DataFrame({
                "version": batch["version"], "digest": batch["digest"],
                "n_tokens": pd.Series([len(encode(t)) for t in batch["content"]], dtype="int64"),
            })

    return run


def _store(spark, cache: str) -> DataFrame:
    """The stored counts; an empty table where nothing is stored yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(cache)


def count_tokens(
    docs: DataFrame, tokenizer: str, *, cache: str | None = None, normalise=unchanged, limit: int = 2048,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Token counts of whole texts: key, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is a .json file of the tokenizers library or a sentencepiece
    .model; no special tokens are added, nothing is truncated or padded.
    ``normalise`` may only unify contents that the tokenizer counts alike
    (:func:`collapsed` where it drops white space).  ``cache`` is a Parquet folder
    in shared storage that outlives the run; by default one of this run's own.

    A null text is empty; equal texts are encoded once, however many rows hold
    them; repeated rows each give a row; an empty table gives an empty result;
    further columns are ignored.  The store may hold a key twice if two runs append
    it at once; both counts are equal and the least is read.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-counts/{uuid.uuid4().hex}"
    version = version_of(tokenizer)
    content = normalise(text_of(text))
    texts = docs.select(text_of(text).alias("_text"), F.unhex(F.sha2(content, 256)).alias("digest"))
    rows = stage(docs.select(
        F.col(key).alias("_id"), F.octet_length(text_of(text)).cast("bigint").alias("n_bytes"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
    ), "digests")
    known = _store(spark, cache).where(F.col("version") == version).select("digest")
    # Copies go before the shuffle, task by task, so a hot text travels once for each task.
    misses = texts.select("digest", normalise(F.col("_text")).alias("content")).dropDuplicates(["digest"])
    misses = misses.join(known, "digest", "left_anti").withColumn("version", F.lit(version))
    misses.mapInPandas(_encode(tokenizer), SCHEMA).write.mode("append").parquet(cache)
    stored = (
        spark.read.schema(SCHEMA).parquet(cache).where(F.col("version") == version)
        .groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    )
    held = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_rows"))
    return join_hot(rows, stored.join(held, "digest"), "digest", "_rows").select(
        F.col("_id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
