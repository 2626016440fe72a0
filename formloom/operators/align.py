"""Sequence alignment of documents against a representative.

Alignment looks only at value-independent *signatures*.  Documents with the same
signature sequence share a *layout*; the alignment is computed once per distinct
(group, layout) and joined back, so Python work grows with the number of
layouts, not of documents.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.functions import text as X
from formloom.operators.elements import top_elements
from formloom.session import stage

SEPARATOR = "\x1f"

#: What :func:`with_layout` tells of a document's elements.  A step that changes the
#: elements has to drop these columns.
LAYOUT = ("sigs", "layout")


def signature_parts(e: Column) -> Column:
    """What a signature looks at, each part computed once per element."""
    return F.struct(
        F.when((e["type"] == "image") | e["image_ref"].isNotNull(), "image").otherwise(e["type"]).alias("kind"),
        e["type"].alias("type"),
        X.stripped(e["text"]).alias("t"),
        F.lower(F.coalesce(e["style_name"], F.lit(""))).alias("style"),
        F.when(e["type"] == "table", F.array_join(e["table_structure"]["headers"], "|")).alias("headers"),
    )


def signature_of(s: Column) -> Column:
    """Signature from :func:`signature_parts`, stable across value changes."""
    colon = F.instr(s["t"], ":")
    sig = (
        F.when(s["type"] == "heading", F.concat(F.lit("h:"), F.lower(s["t"])))
        .when(s["type"] == "table", F.concat(F.lit("t:"), F.lower(F.coalesce(s["headers"], F.lit("")))))
        .when(s["kind"] == "image", F.lit("img"))
        .when(
            (colon > 0) & (colon <= 41),
            F.concat(F.lit("p:"), X.strip(F.lower(F.substr(s["t"], F.lit(1), colon - 1)))),
        )
        .otherwise(
            F.concat(F.lit("p:"), s["style"], F.lit(":"), X.len_bucket(F.length(s["t"])).cast("string"))
        )
    )
    return F.replace(sig, F.lit(SEPARATOR), F.lit(" "))


def align_signature(e: Column) -> Column:
    """Signature of an element struct (or of the row's own element columns)."""
    return signature_of(signature_parts(e))


def with_layout(documents: DataFrame) -> DataFrame:
    """Keep the top-level elements as ``tops`` and add ``sigs``, ``layout``; documents
    that already carry these two (see :data:`LAYOUT`) keep them."""
    tops = documents.withColumn("tops", top_elements(F.col("elements"))).drop("elements")
    if set(LAYOUT) <= set(documents.columns):
        return tops
    sigs = F.transform(F.transform("tops", signature_parts), signature_of)
    # Never null: otherwise a join on the layout pushes "layout is not null", with
    # the whole signature expression in it, down as a second evaluation.
    key = F.coalesce(F.sha2(F.array_join("sigs", SEPARATOR), 256), F.lit(""))
    return tops.withColumn("sigs", sigs).withColumn("layout", key)


def _match(rep: list[str], other: list[str]) -> list[int]:
    """For each representative position, the aligned position in the other
    document or -1.  Unequal stretches pair up from their start."""
    out = [-1] * len(rep)
    matcher = SequenceMatcher(a=rep, b=other, autojunk=False)
    for tag, i1, i2, j1, j2 in matcher.get_opcodes():
        if tag in ("equal", "replace"):
            for k in range(min(i2 - i1, j2 - j1)):
                out[i1 + k] = j1 + k
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _match_layouts(rep: pd.Series, other: pd.Series) -> pd.Series:
    """Signatures come joined and are split pair by pair: a batch of long layouts as
    lists of strings would take many times its size."""
    def parts(joined):
        return joined.split(SEPARATOR) if joined else []

    return pd.Series(
        [None if r is None or o is None else _match(parts(r), parts(o)) for r, o in zip(rep, other)]
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _anchors(pairs: pd.Series, tables: pd.Series) -> pd.Series:
    """For each representative position, the last aligned position before it that is
    not a table, or -1: one pass over a layout.  ``tables`` are the tables' positions."""
    def one(pair, at):
        skip = set(at)
        out, last = [], -1
        for j in pair:
            out.append(last)
            if j >= 0 and j not in skip:
                last = int(j)
        return out

    return pd.Series([one(p, s) for p, s in zip(pairs, tables)])


def pick_representative(documents: DataFrame) -> DataFrame:
    """``(group_id, rep_seq, n_documents)``: the document with the most top-level
    elements, ties to the earliest.  Two hash aggregations, both combined
    map-side: first per (group, length), then per group."""
    lengths = documents.select(
        "group_id", "doc_seq", F.size(top_elements(F.col("elements"))).alias("n_top")
    )
    return _pick(lengths)


def _pick(lengths: DataFrame) -> DataFrame:
    per_length = lengths.groupBy("group_id", "n_top").agg(
        F.min("doc_seq").alias("first_seq"), F.count(F.lit(1)).alias("n")
    )
    return per_length.groupBy("group_id").agg(
        F.max_by("first_seq", "n_top").alias("rep_seq"), F.sum("n").alias("n_documents")
    )


def layouts_of(laid_out: DataFrame) -> DataFrame:
    """Distinct layouts: ``(group_id, layout, sigs, n_docs, first_seq)``."""
    return laid_out.groupBy("group_id", "layout", F.array_join("sigs", SEPARATOR).alias("joined")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc_seq").alias("first_seq")
    ).withColumn("sigs", F.when(F.col("joined") == "", F.array().cast("array<string>"))
                 .otherwise(F.split("joined", SEPARATOR))).drop("joined")


def representatives(layouts: DataFrame) -> DataFrame:
    """Per group, from its layouts: the longest one (earliest document on ties)."""
    longest = layouts.groupBy("group_id", F.size("sigs").alias("n_top")).agg(
        F.min_by("sigs", "first_seq").alias("rep_sigs"),
        F.min("first_seq").alias("rep_seq"),
        F.sum("n_docs").alias("n"),
    )
    return longest.groupBy("group_id").agg(
        F.max_by("rep_sigs", "n_top").alias("rep_sigs"),
        F.max_by("rep_seq", "n_top").alias("rep_seq"),
        F.sum("n").alias("n_documents"),
    )


def layout_pairs(layouts: DataFrame, reps: DataFrame) -> DataFrame:
    """``pairs ARRAY<INT>`` per (group, layout): position in the document for
    each representative position, and ``anchors``, the last lined-up position before
    it that is no table.  Equal layouts are aligned without Python.  ``reps`` needs
    ``group_id, rep_sigs``; its other columns are carried along."""
    joined = layouts.join(reps, "group_id")
    same = F.col("sigs") == F.col("rep_sigs")
    identity = F.when(
        F.size("rep_sigs") > 0, F.sequence(F.lit(0), F.size("rep_sigs") - 1)
    ).otherwise(F.array().cast("array<int>"))
    text = lambda sigs: F.when(~same, F.array_join(sigs, SEPARATOR))
    matched = _match_layouts.asNondeterministic()(text("rep_sigs"), text("sigs"))
    tables = F.array_compact(F.transform("sigs", lambda s, i: F.when(s.startswith("t:"), i)))
    return joined.withColumn("_matched", matched).withColumn(
        "pairs", F.when(same, identity).otherwise(F.col("_matched"))
    ).withColumn("anchors", _anchors(F.col("pairs"), tables)).drop("sigs", "_matched", "n_docs", "first_seq")


def align_to(laid_out: DataFrame, reps: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """Each document row beside its alignment ``pairs`` and the ``reps`` columns.

    The mapping (one row per distinct layout) is written out first, so the join
    sees its measured size: Spark broadcasts it below its own threshold and the
    documents never move; beyond that it is a shuffled join whose hot layouts AQE
    splits (nothing downstream groups on the join key).
    """
    return laid_out.join(staged_pairs(laid_out, reps, layouts).drop("pairs_row"), ["group_id", "layout"])


def staged_pairs(laid_out: DataFrame, reps: DataFrame, layouts: DataFrame | None = None) -> DataFrame:
    """The mapping of :func:`align_to`, its rows numbered (``pairs_row``)."""
    found = layouts_of(laid_out) if layouts is None else layouts
    return stage(layout_pairs(found, reps).withColumn("pairs_row", F.monotonically_increasing_id()), "layouts")


def aligned_elements(aligned: DataFrame, *carry: str) -> DataFrame:
    """One row per (document, representative position) that has a counterpart:
    ``ri`` and the document's element ``e``."""
    return (
        aligned.select("group_id", "doc_id", "doc_seq", *carry, "tops", F.posexplode("pairs").alias("ri", "oj"))
        .where(F.col("oj") >= 0)
        .select("group_id", "doc_id", "doc_seq", *carry, "ri", "oj", F.get("tops", F.col("oj")).alias("e"))
    )
