"""Retention against a plain loop over the sorted files."""

import random

import pytest
from pyspark.sql import functions as F

from formloom.operators.accounting import prune_plan

NOW = 1_706_745_600.0


def plainly(files, days, cap):
    told, rest = {}, []
    for key, size, t in files:
        known = t or 0.0
        if days and known > 0 and NOW - known > days * 86400:
            told[key] = "age"
        else:
            rest.append((known, key, size))
    left = sum(size for _, _, size in rest)
    for _, key, size in sorted(rest):
        if cap and left > cap:
            told[key] = "size"
        left -= size
    return told


@pytest.mark.parametrize(("days", "cap"), [(14, 4000), (0, 9000), (14, 1), (14, 10**9), (14, 0), (0, 2500)])
def test_prune_plan(spark, days, cap):
    dice = random.Random(days + cap)
    # Half of the times are unknown, some files are empty, many share a time.
    files = [(i, dice.choice([0, 1, 30, 100]), dice.choice([None, None, NOW - 86400 * dice.randint(1, 30)])) for i in range(400)]
    df = spark.createDataFrame(files, "key bigint, size bigint, mtime double")
    got = {r.key: r.reason for r in prune_plan(df, F.lit(NOW), days, cap).collect()}
    assert got == plainly(files, days, cap)


def test_no_task_holds_the_unknown_times(spark):
    df = spark.range(4000).select(F.col("id").alias("key"), F.lit(1).cast("bigint").alias("size"), F.lit(None).cast("double").alias("mtime"))
    got = prune_plan(df, F.lit(NOW), 14, 1500)
    assert got.count() == 2500 and got.agg(F.max("key")).first()[0] == 2499
    empty = prune_plan(df.limit(0), F.lit(NOW), 14, 1500)
    assert empty.collect() == [] and empty.columns == ["key", "size", "mtime", "reason"]
