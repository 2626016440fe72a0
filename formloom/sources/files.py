"""Listing and receiving uploaded files, before anything opens them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom import vocabulary as V


def stat_files(spark: SparkSession, path: str) -> DataFrame:
    """``key, size, mtime`` of everything under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def upload_problem() -> Column:
    """Why a file (``filename, size``) is turned away unopened; null when it is not."""
    return (
        F.when(~F.lower("filename").endswith(".docx"), "Only .docx files are supported")
        .when(F.col("size") <= 0, "Uploaded file is empty")
        .when(F.col("size") > V.MAX_UPLOAD_BYTES, f"File exceeds the {V.MAX_UPLOAD_BYTES // (1024 * 1024)} MB upload limit")
    )


def reject_report(spark: SparkSession, path: str) -> DataFrame:
    """``key, reason`` of every file under a folder that is turned away."""
    named = stat_files(spark, path).withColumn("filename", F.element_at(F.split("key", "/"), -1))
    return named.select("key", upload_problem().alias("reason")).where(F.col("reason").isNotNull())


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """Accepted files with their bytes: ``path, filename, size, sha256, content``.

    Names and sizes are filtered by the scan itself, so no other file's contents are read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(path)
        .where((F.col("length") > 0) & (F.col("length") <= V.MAX_UPLOAD_BYTES))
    )
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"), "content")


def claim_incoming(files: DataFrame, owner_id: str, root: str) -> DataFrame:
    """Only files under the owner's own incoming folder below ``root``."""
    own = f"{root.rstrip('/')}/uploads/incoming/{owner_id}/"
    return files.where(F.regexp_replace("path", "^file:/+", "/").startswith(own) | F.col("path").startswith(own))
