"""Session settings the engine relies on, and the staging helper.

Nothing here is required on a cluster that already sets these; ``tuned`` only
fills in what is missing for a locally built session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: AQE re-plans joins from measured sizes and splits hot shuffle partitions, so
#: no operator hints a broadcast on data whose size grows with the corpus.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Element work is heavy per byte: do not merge shuffle partitions too eagerly.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply :data:`ENGINE_CONF` to a session builder."""
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only where the session leaves it unset (a local test) is one made up.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="formloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Paths staged inside the open :func:`staging` scopes, innermost last.
_scopes: list[list[str]] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """What :func:`stage` writes inside is removed at the end.

    Results are lazy and read their stages, so write or collect them inside::

        with staging(spark):
            check_compliance(docs, specs).write.parquet(target)
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a derived document table feeds several passes: the passes then
    read pruned Parquet columns instead of redoing the joins that built it, and
    a lost executor costs a re-read, not a recomputation.  Files of at most
    ``rows_per_file`` rows (0: any) let later passes deal heavy rows out evenly.
    The shuffle files that writing took are removed with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    with _shuffles_dropped(spark):
        df.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.parquet(path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not when the
    driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a source that arrives in fewer splits than there are
    cores (one large row group, say); leave any other source as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
