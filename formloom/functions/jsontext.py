"""JSON out of model answers: thoughts and fences dropped, cut-off tails closed.

The common cases - clean JSON, fenced JSON, JSON between other words - are
settled in the JVM with ``try_parse_json``; only what is left goes to an Arrow
UDF that closes a truncated document.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.functions.text import as_col, stripped


def without_thinking(text: Column | str) -> Column:
    """Closed ``<think>`` blocks removed; an unclosed one drops what follows."""
    closed = F.regexp_replace(as_col(text), r"(?s)<think>.*?</think>", "")
    cut_at = F.when(
        ~closed.contains("</think>"), F.substring_index(closed, "<think>", 1)
    ).otherwise(closed)
    return stripped(cut_at)


def unfenced(text: Column) -> Column:
    inner = F.regexp_extract(text, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.coalesce(F.nullif(stripped(inner), F.lit("")), text)


def _valid(text: Column) -> Column:
    """The text itself when it is JSON, else null."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def _between(text: Column, opener: str, closer: str) -> Column:
    """From the first opening to the last closing bracket."""
    span = F.regexp_extract(text, rf"(?s)(\{opener}.*\{closer})", 1)
    return F.nullif(span, F.lit(""))


def close_truncated(text: str) -> str | None:
    """Keep the complete members of a cut-off JSON document and close it.

    A member counts once something follows it (a comma, a bracket, a blank), so a
    number at the very end is dropped: it may have been cut in the middle.
    """
    stack: list[str] = []
    # Where the text could stop, with the brackets open there.
    stop: tuple[int, tuple[str, ...]] | None = None
    i, n = 0, len(text)
    while i < n:
        ch = text[i]
        if ch == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            if j >= n:
                break  # inside a cut string
            i = j + 1
            # Inside an object a string may still be a key waiting for its value.
            if not stack or stack[-1] == "[":
                stop = (i, tuple(stack))
            continue
        if ch in "{[":
            stack.append(ch)
        elif ch in "}]":
            if stack:
                stack.pop()
            stop = (i + 1, tuple(stack))
        elif ch == ",":
            stop = (i, tuple(stack))
        elif ch not in ": \t\r\n":
            j = i
            while j < n and text[j] not in ',:{}[]" \t\r\n':
                j += 1
            if j >= n:
                break  # a bare value at the very end
            stop = (j, tuple(stack))
            i = j
            continue
        i += 1
    if stop is None or stop[0] == 0:
        return None
    end, still_open = stop
    tail = "".join("}" if b == "{" else "]" for b in reversed(still_open))
    return text[:end].rstrip().rstrip(",").rstrip() + tail


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    def fix(text):
        if text is None:
            return None
        closed = close_truncated(text)
        if closed is None:
            return None
        try:
            json.loads(closed)
        except ValueError:
            return None
        return closed

    return texts.map(fix, na_action="ignore")


def extract_json(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: the JSON document in an answer text, null when there is none.

    Written as a few column steps so that each part is computed once; only
    answers the JVM cannot settle reach the UDF.
    """
    steps = df.withColumn("_clean", unfenced(without_thinking(column)))
    steps = steps.withColumn("_lead", F.substring("_clean", 1, 1))
    steps = steps.withColumn(
        "_obj", _valid(_between(F.col("_clean"), "{", "}"))
    ).withColumn("_arr", _valid(_between(F.col("_clean"), "[", "]")))
    own = F.when(F.col("_lead") == "{", F.col("_obj")).when(F.col("_lead") == "[", F.col("_arr"))
    steps = steps.withColumn("_own", F.coalesce(_valid(F.nullif("_clean", F.lit(""))), own))
    cut_off = F.col("_own").isNull() & F.col("_lead").isin("{", "[")
    steps = steps.withColumn("_closed", _repair(F.when(cut_off, F.col("_clean"))))
    return steps.withColumn(out, F.coalesce("_own", "_closed", "_obj", "_arr")).drop(
        "_clean", "_lead", "_obj", "_arr", "_own", "_closed"
    )


def lenient(df: DataFrame, column: str, schema: str, required: str) -> tuple[DataFrame, DataFrame]:
    """Parse a JSON text column leniently: ``(rows, rejects)``.

    A null list reads as empty and a null text as ``""``; a row without its
    required member is a reject, never a failed job.
    """
    parsed = df.withColumn("_parsed", F.from_json(column, schema))
    fields = parsed.schema["_parsed"].dataType.fields

    def filled(f: T.StructField) -> Column:
        value = F.col(f"_parsed.{f.name}")
        if f.name == required:
            return value.alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.coalesce(value, F.array().cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(value, F.lit("")).alias(f.name)
        return value.alias(f.name)

    ok = F.col(f"_parsed.{required}").isNotNull()
    rest = [F.col(c) for c in df.columns if c != column]
    return (
        parsed.where(ok).select(*rest, *[filled(f) for f in fields]),
        parsed.where(~F.coalesce(ok, F.lit(False))).select(*rest, F.col(column)),
    )
