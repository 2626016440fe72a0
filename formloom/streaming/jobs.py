"""Streams: arriving documents, running usage, scoring on arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formloom.operators import accounting as A
from formloom.operators.compliance import check_compliance
from formloom.operators.elements import hash_of
from formloom.schemas import DOCUMENT_DDL
from formloom.session import staging


def usage_stream(calls: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling-window tokens and cost per owner and model.  ``calls(ts,
    owner_id, model, in_tokens, out_tokens)``; prices are the fixed list."""
    priced = _priced(calls)
    return priced.withWatermark("ts", delay).groupBy(F.window("ts", window), "owner_id", "model").agg(
        F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.count(F.lit(1)).alias("calls"),
        F.first("in_rate").alias("in_rate"), F.first("out_rate").alias("out_rate"),
    ).select(F.col("window.start").alias("window_start"), "owner_id", "model", "in_tokens", "out_tokens", "calls",
             A.call_cost(*(F.col(c) for c in ("in_tokens", "out_tokens", "in_rate", "out_rate"))).alias("cost_usd"))


def _priced(calls: DataFrame) -> DataFrame:
    """Rates by longest known prefix as an expression, so the stream keeps its
    shape (the price list is fixed and short)."""
    from formloom import vocabulary as V

    model = F.lower(F.trim("model"))
    rate_in, rate_out = F.lit(None).cast("double"), F.lit(None).cast("double")
    for known, (i, o) in sorted(V.MODEL_PRICES.items(), key=lambda kv: len(kv[0])):
        hit = model.startswith(known)
        rate_in, rate_out = F.when(hit, i).otherwise(rate_in), F.when(hit, o).otherwise(rate_out)
    return calls.withColumn("in_rate", rate_in).withColumn("out_rate", rate_out)


def arriving(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files under ``path`` as a stream, with the time each file ``arrived``."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern, so that a single file may stand for a folder.
    rows = source.parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("arrived", F.col("_metadata.file_modification_time"))


def ingest_stream(documents: DataFrame, arrived: str = "arrived", within: str = "1 day") -> DataFrame:
    """Arriving documents with their ``content_hash``, each content once.

    ``documents`` are a stream of documents with the time they ``arrived``.  The state is
    one hash for each content seen, forgotten when the watermark has passed it by
    ``within``: a file sent again in that time adds nothing.  Of equal contents that come
    in one batch any one stays."""
    hashed = documents.withColumn("content_hash", F.coalesce(hash_of(F.col("elements")), F.sha2(F.lit(""), 256)))
    return hashed.withWatermark(arrived, within).dropDuplicatesWithinWatermark(["content_hash"])


def compliance_batches(templates: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function scoring each micro-batch of documents against
    static templates and handing the reports to ``sink``."""
    def score(batch: DataFrame, epoch: int) -> None:
        with staging(batch.sparkSession):
            sink(check_compliance(batch, templates), epoch)

    return score


def epoch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch to the folder of its number.  A batch that is run again after a
    failure has the same number and replaces what it wrote before, so every report is
    there exactly once.  One stream (one checkpoint) owns a folder."""
    def write(reports: DataFrame, epoch: int) -> None:
        reports.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def compliance_stream(documents: DataFrame, templates: DataFrame, path: str, checkpoint: str,
                      sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Scores what has arrived since ``checkpoint`` against ``templates`` and stops."""
    return documents.writeStream.foreachBatch(compliance_batches(templates, sink or epoch_sink(path))).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_reports(spark: SparkSession, templates: DataFrame, path: str) -> DataFrame:
    """All reports of a compliance stream; none where no document came."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.read.parquet(path).drop("epoch")
    return check_compliance(spark.createDataFrame([], DOCUMENT_DDL), templates)
