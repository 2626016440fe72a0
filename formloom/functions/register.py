"""Text functions for SQL: ``CREATE TEMPORARY FUNCTION`` bodies come from the
Column helpers; only similarity is a Python UDF."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom import vocabulary as V


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _sql_literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _slug_body() -> str:
    """The rule of ``functions.text.slug`` over the argument ``t``: filler words go unless
    nothing else is left, five words stay."""
    stop = ", ".join(f"'{w}'" for w in V.SLUG_STOPWORDS)
    head = "split_part(lower(rtrim(':', regexp_replace(t, '(?U)^\\\\s+|\\\\s+$', ''))), ':', 1)"
    words = f"filter(split({head}, '[^a-z0-9]+'), w -> w <> '')"
    kept = f"filter({words}, w -> w NOT IN ({stop}))"
    named = f"array_join(slice(if(size({kept}) > 0, {kept}, {words}), 1, 5), '_')"
    return f"coalesce(nullif(regexp_replace({named}, '^(?=[0-9])', 'f_'), ''), 'field')"


def register_functions(spark: SparkSession) -> list[str]:
    """Make the detectors, the kind, the number reader and ``similarity`` callable
    from SQL; returns the names."""
    found = lambda p: f"coalesce(t rlike {_sql_literal(p)}, false)"
    date = f"({found(V.DATE_DIGITS)} OR {found(V.DATE_WORDS)})"
    number = f"coalesce(trim(t) rlike {_sql_literal(V.NUMBER)}, false)"
    person = f"(coalesce(trim(t) rlike {_sql_literal(V.PERSON)}, false) AND NOT (upper(t) = t AND lower(t) <> t))"
    bodies = {
        "detect_date": ("BOOLEAN", date), "detect_currency": ("BOOLEAN", found(V.CURRENCY)), "detect_percent": ("BOOLEAN", found(V.PERCENT)),
        "detect_email": ("BOOLEAN", found(V.EMAIL)), "is_pure_number": ("BOOLEAN", number), "looks_like_person": ("BOOLEAN", person),
        "value_kind": ("STRING", f"CASE WHEN {date} THEN 'date' WHEN {found(V.CURRENCY)} OR {found(V.PERCENT)} OR {number} THEN 'number' WHEN {person} THEN 'person' ELSE 'text' END"),
        "parse_number": ("DOUBLE", "try_cast(regexp_replace(t, '[^0-9.\\\\-]', '') AS DOUBLE)"),
        "slugify_field": ("STRING", _slug_body()),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
    spark.udf.register("similarity", _similarity)
    return [*bodies, "similarity"]
