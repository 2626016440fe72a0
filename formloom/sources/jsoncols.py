"""Open JSON columns to typed structs and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def open_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text column as a struct (null where it does not parse)."""
    return df.withColumn(column, F.from_json(column, schema))


def close_json(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_json(column))


def json_member(df: DataFrame, column: str, path: str, kind: str, out: str) -> DataFrame:
    """One member of an open-shaped JSON column, typed; null when absent or odd."""
    return df.withColumn(out, F.try_variant_get(F.try_parse_json(column), path, kind))
