"""Multi-document structural diff.

``diff_corpus`` compares every document of every group with the group's
representative in one job.  All decisions come from aggregates that combine
map-side, so a group that holds a third of the corpus costs no more per task
than a small one; nothing collects a group's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.functions import text as X
from formloom.operators.align import (
    align_to, aligned_elements, layouts_of, representatives, with_layout,
)
from formloom.operators.elements import cap_per_group, top_elements
from formloom.session import stage

NODE = ["group_id", "ri"]
KINDS = ("date", "number", "person", "text")


def diff_confidence(n_documents: Column) -> Column:
    """0.75 for two documents, growing by 0.2 each, at most 0.95."""
    return F.least(F.round(F.lit(0.55) + F.lit(0.2) * (n_documents - 1), 2), F.lit(0.95))


# -- distinct values per node ------------------------------------------------
def node_values(aligned: DataFrame) -> DataFrame:
    """Distinct contents per (group, representative node) with how many
    documents have each and the first of them (the representative comes first).

    This is the complete list: ``diff_corpus`` only previews it (:func:`corpus_values`).  Pictures and
    tables are told apart by hash, so grids never travel.
    """
    e, ts = F.col("e"), F.col("e.table_structure")
    flat = aligned_elements(aligned, "rep_seq").select(
        *NODE,
        F.coalesce(e["text"], F.lit("")).alias("text"),
        F.when(ts.isNotNull(), F.array_join(ts["headers"], "\x1f")).alias("header_key"),
        F.when(
            ts.isNotNull(),
            F.xxhash64(F.transform(ts["rows"], lambda r: F.array_join(r, "\x1f"))),
        ).alias("grid_key"),
        ts["n_rows"].alias("n_rows"),
        e["image_ref"]["hash"].alias("image_hash"),
        F.when(F.col("doc_seq") == F.col("rep_seq"), F.lit(None).cast("bigint"))
        .otherwise(F.col("doc_seq")).alias("seq"),
        (F.col("doc_seq") == F.col("rep_seq")).cast("int").alias("is_rep"),
    )
    return flat.groupBy(
        *NODE, "text", "header_key", "grid_key", "n_rows", "image_hash"
    ).agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("seq").alias("first_seq"), F.max("is_rep").alias("in_rep"),
    ).withColumn(
        "rank", F.when(F.col("in_rep") == 1, F.lit(-1).cast("bigint")).otherwise(F.col("first_seq"))
    )


def _kind_counts(kind: Column, weight: Column, prefix: str) -> list[Column]:
    out = []
    for k in KINDS:
        out.append(F.sum(F.when(kind == k, weight)).alias(f"{prefix}_{k}"))
        out.append(F.min(F.when(kind == k, F.col("rank"))).alias(f"{prefix}_{k}_first"))
    return out


def _majority(prefix: str) -> Column:
    """Most frequent kind; the one seen first wins a tie; none seen is text."""
    seen = F.array(
        *[
            F.struct(
                (-F.coalesce(F.col(f"{prefix}_{k}"), F.lit(0))).alias("n"),
                F.col(f"{prefix}_{k}_first").alias("first"),
                F.lit(k).alias("kind"),
            )
            for k in KINDS
        ]
    )
    best = F.array_min(F.filter(seen, lambda s: s["n"] < 0))
    return F.coalesce(best["kind"], F.lit("text"))


def label_prefix(text: Column) -> Column:
    """Through the first colon; null without one."""
    at = F.instr(text, ":")
    return F.when(at > 0, F.substring(text, 1, at))


def _lcp(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts (bisection over prefix lengths
    would need a loop; comparing characters in place is linear)."""
    n = F.least(F.length(a), F.length(b))
    both = F.sequence(F.lit(1), n)
    first_off = F.array_min(
        F.filter(both, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    )
    return F.when(n == 0, 0).otherwise(F.coalesce(first_off - 1, n))


def _alnum_run(text: Column, at_end: bool) -> Column:
    pattern = r"(?U)([\p{L}\p{N}]+)$" if at_end else r"(?U)^([\p{L}\p{N}]+)"
    return F.length(F.regexp_extract(text, pattern, 1))


def common_skeleton(values: DataFrame, keys: list[str]) -> DataFrame:
    """Shared prefix and suffix of all ``text`` values per key, cut back to token
    boundaries, without collecting the values.

    Common prefix of a set = common prefix of its least and greatest member;
    suffixes are the same on reversed texts.  A second aggregate asks whether
    any value continues the token at the cut; if so the whole token goes.
    Returns ``keys, prefix, suffix, n_parts, min_len``.
    """
    ends = values.groupBy(*keys).agg(
        F.min("text").alias("lo"), F.max("text").alias("hi"),
        F.min(F.reverse("text")).alias("rlo"), F.max(F.reverse("text")).alias("rhi"),
        F.min(F.length("text")).alias("min_len"),
    )
    cut = ends.withColumn("plen", _lcp(F.col("lo"), F.col("hi"))).withColumn(
        "slen", _lcp(F.col("rlo"), F.col("rhi"))
    ).select(
        *keys, "min_len",
        F.substr("lo", F.lit(1), F.col("plen")).alias("prefix"),
        # On overlap the last characters are kept, so the parts always re-join.
        F.reverse(
            F.substr("rlo", F.lit(1), F.greatest(F.least(F.col("slen"), F.col("min_len") - F.col("plen")), F.lit(0)))
        ).alias("suffix"),
    )
    plen, slen, n = F.length("prefix"), F.length("suffix"), F.length("text")
    alnum = r"(?U)^[\p{L}\p{N}]$"
    probed = values.join(cut, keys).groupBy(*keys, "prefix", "suffix", "min_len").agg(
        F.max((n > plen) & F.substr("text", plen + 1, F.lit(1)).rlike(alnum)).alias("goes_on"),
        F.max((n > slen) & F.substr("text", n - slen, F.lit(1)).rlike(alnum)).alias("comes_on"),
        F.count(F.lit(1)).alias("n_texts"),
    )
    kept_prefix = F.when(
        F.col("goes_on"),
        F.substr("prefix", F.lit(1), F.length("prefix") - _alnum_run(F.col("prefix"), True)),
    ).otherwise(F.col("prefix"))
    kept_suffix = F.when(
        F.col("comes_on"), F.substr("suffix", _alnum_run(F.col("suffix"), False) + 1)
    ).otherwise(F.col("suffix"))
    trimmed = probed.select(
        *keys, "n_texts", "min_len", kept_prefix.alias("prefix"), kept_suffix.alias("suffix")
    )
    # Texts are distinct and share both ends, so their middles are distinct too.
    good = (F.length("prefix") + F.length("suffix") >= 2) & (F.col("n_texts") > 1)
    return trimmed.where(good).select(*keys, "prefix", "suffix")


def middle(text: Column, prefix: Column, suffix: Column) -> Column:
    return F.substr(
        text, F.length(prefix) + 1, F.length(text) - F.length(prefix) - F.length(suffix)
    )


# -- the diff -----------------------------------------------------------------
def diff_corpus(documents: DataFrame, max_samples: int = 20) -> DataFrame:
    """Evidence per (group, representative node), for groups of two or more.

    Columns: ``group_id, ri, node_id, type, status, n_documents, n_present,
    is_optional, is_constant, confidence, static_prefix, static_suffix,
    detected_kind, n_distinct, sample_texts, variable_parts, header_identical,
    row_count_variable, min_rows, max_rows, image_hashes, notes``.
    ``sample_texts``, ``variable_parts`` and ``image_hashes`` are previews, made from
    the first ``max_samples`` rows of :func:`node_values`; :func:`corpus_values` has
    all texts, variable parts and picture hashes, :func:`corpus_row_counts` all row counts.
    """
    reps, aligned = _compared(documents)
    return _decide(staged_values(aligned), stage(rep_nodes(documents, reps), "representatives"), max_samples)


def _compared(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives of groups of two or more, documents aligned to them."""
    laid_out = with_layout(documents)
    layouts = stage(layouts_of(laid_out), "signatures")
    reps = stage(representatives(layouts).where(F.col("n_documents") >= 2), "chosen")
    return reps, align_to(laid_out, reps, layouts)


def staged_values(aligned: DataFrame) -> DataFrame:
    """:func:`node_values`, written once: the several passes over them would each
    build and align all documents again."""
    return stage(node_values(aligned), "values")


def corpus_values(documents: DataFrame) -> DataFrame:
    """What the diff row previews, complete: one row per (group, representative node)
    and distinct text and picture hash of its counterparts.

    Columns: ``group_id, ri, node_id, type, status, text, variable_part, image_hash,
    n_docs, in_representative, first_seq``; ``variable_part`` is the text without the
    static ends, of nodes that have these; ``first_seq`` the first other document with it.
    """
    reps, aligned = _compared(documents)
    values = staged_values(aligned)
    shapes = stage(
        _decide(values, stage(rep_nodes(documents, reps), "representatives"), 1).select(*NODE, "node_id", "type", "status", "static_prefix", "static_suffix"), "shapes"
    )
    told = values.groupBy(*NODE, "text", "image_hash").agg(
        F.sum("n_docs").alias("n_docs"), (F.max("in_rep") == 1).alias("in_representative"), F.min("first_seq").alias("first_seq"),
    )
    return told.join(shapes, NODE).select(
        *NODE, "node_id", "type", "status", "text",
        middle(F.col("text"), F.col("static_prefix"), F.col("static_suffix")).alias("variable_part"),
        "image_hash", "n_docs", "in_representative", "first_seq",
    )


def corpus_row_counts(documents: DataFrame) -> DataFrame:
    """How many documents of each group have each row count, per table node (complete list)."""
    return row_counts(_compared(documents)[1])


def rep_nodes(documents: DataFrame, reps: DataFrame) -> DataFrame:
    """One row per top-level node of each representative (``ri`` = position), chosen
    before any signature is made."""
    # Spark leaves the semi join above the projection that builds documents, so all are built, without signatures.
    keys = reps.select("group_id", F.col("rep_seq").alias("doc_seq"), "n_documents")
    chosen = documents.join(keys, ["group_id", "doc_seq"], "left_semi").join(keys, ["group_id", "doc_seq"])
    return chosen.select(
        "group_id", "doc_id", "doc_seq", "n_documents", F.posexplode(top_elements(F.col("elements"))).alias("ri", "e")
    ).select("group_id", "doc_id", "doc_seq", "n_documents", "ri", "e.*")


def _decide(values: DataFrame, nodes: DataFrame, max_samples: int) -> DataFrame:
    text = F.col("text")
    after = F.substr(text, F.instr(text, ":") + 1)
    stats = values.groupBy(*NODE).agg(
        F.sum("n_docs").alias("n_present"),
        F.count(F.lit(1)).alias("n_values"),
        F.min("text").alias("lo"), F.max("text").alias("hi"),
        F.min(F.instr(text, ":")).alias("colon"),
        F.min(label_prefix(text)).alias("label_lo"), F.max(label_prefix(text)).alias("label_hi"),
        F.min(after).alias("after_lo"), F.max(after).alias("after_hi"),
        F.min(after.startswith(" ").cast("int")).alias("spaced"),
        F.min("header_key").alias("head_lo"), F.max("header_key").alias("head_hi"),
        F.min("grid_key").alias("grid_lo"), F.max("grid_key").alias("grid_hi"),
        F.min("n_rows").alias("min_rows"), F.max("n_rows").alias("max_rows"),
        F.min("image_hash").alias("img_lo"), F.max("image_hash").alias("img_hi"),
    )
    labelled = (
        (F.col("colon") > 0)
        & (F.col("label_lo") == F.col("label_hi"))
        & (F.col("after_lo") != F.col("after_hi"))
    )
    stats = stage(stats.withColumn("labelled", labelled).withColumn(
        "label", F.concat("label_lo", F.when(F.col("spaced") == 1, " ").otherwise(""))
    ), "node-stats")

    # Only nodes that vary have a kind: of what follows their label, else of the whole text.
    varying = stats.where(F.col("lo") != F.col("hi")).select(*NODE, "labelled")
    part = F.when(F.col("labelled"), after).otherwise(text)
    parts = values.join(varying, NODE).select(
        *NODE, "rank", part.alias("part"), F.when(F.col("labelled"), F.col("n_docs")).otherwise(1).alias("weight"))
    kinds = parts.withColumn("kind", F.when(~X.is_blank("part"), X.value_kind("part"))).groupBy(*NODE).agg(
        *_kind_counts(F.col("kind"), F.col("weight"), "part")
    ).select(*NODE, _majority("part").alias("part_kind"))

    # Nodes that vary without a shared label: look for a shared skeleton.
    varied = varying.where(~F.col("labelled")).select(*NODE)
    loose = values.join(varied, NODE, "left_semi").groupBy(*NODE, "text").agg(
        F.sum("n_docs").alias("n_docs"), F.min("rank").alias("rank")
    )
    shape = common_skeleton(loose, NODE)
    mid = middle(text, F.col("prefix"), F.col("suffix"))
    mids = loose.join(shape, NODE).withColumn("mid", mid).withColumn(
        "mid_kind", F.when(~X.is_blank("mid"), X.value_kind("mid"))
    )
    skeleton = mids.groupBy(*NODE, "prefix", "suffix").agg(
        *_kind_counts(F.col("mid_kind"), F.col("n_docs"), "mid")
    ).select(*NODE, "prefix", "suffix", _majority("mid").alias("mid_kind"))

    firsts = cap_per_group(values, NODE, ["rank", "n_docs"], max_samples)
    samples = firsts.groupBy(*NODE).agg(
        F.array_sort(F.collect_list(F.struct("rank", "text", "image_hash", "n_docs"))).alias("firsts")
    )

    joined = (
        nodes.select(
            "group_id", "ri", "node_id", F.col("type").alias("type"), "n_documents", "image_ref",
            F.col("table_structure.headers").alias("rep_headers"),
        )
        .join(stats, NODE)
        .join(samples, NODE)
        .join(skeleton, NODE, "left")
        .join(kinds, NODE, "left")
    )
    is_table = F.col("type") == "table"
    is_image = ~is_table & ((F.col("type") == "image") | F.col("image_ref").isNotNull())
    same_text = F.col("lo") == F.col("hi")
    same_grid = F.coalesce(F.col("grid_lo") == F.col("grid_hi"), F.lit(True))
    same_image = F.coalesce(F.col("img_lo") == F.col("img_hi"), F.lit(True))
    rows_vary = F.coalesce(F.col("min_rows") != F.col("max_rows"), F.lit(False))
    missing = F.col("n_documents") - F.col("n_present")
    skeletal = F.col("prefix").isNotNull()
    status = (
        F.when(is_table & same_grid, "identical")
        .when(is_table & rows_vary, "row_count_changed")
        .when(is_table, "changed")
        .when(is_image, F.when(same_image, "identical").otherwise("image_changed"))
        .when(same_text, "identical")
        .when(F.col("labelled") | skeletal, "partial_change")
        .otherwise("changed")
    )
    is_text = ~is_table & ~is_image
    partial = is_text & ~same_text & (F.col("labelled") | skeletal)
    constant = F.when(is_table, same_grid).when(is_image, same_image).otherwise(same_text & (missing == 0))
    pre = F.when(F.col("labelled"), F.col("label")).otherwise(F.col("prefix"))
    suf = F.when(F.col("labelled"), F.lit("")).otherwise(F.col("suffix"))
    texts = F.array_distinct(F.transform("firsts", lambda s: s["text"]))
    return joined.select(
        "group_id", "ri", "node_id", "type",
        status.alias("status"),
        "n_documents", "n_present",
        (missing > 0).alias("is_optional"),
        constant.alias("is_constant"),
        diff_confidence(F.col("n_documents")).alias("confidence"),
        F.when(partial, pre).alias("static_prefix"),
        F.when(partial, suf).alias("static_suffix"),
        F.when(partial & ~F.col("labelled"), F.col("mid_kind"))
        .when(is_text & ~same_text, F.col("part_kind")).alias("detected_kind"),
        F.col("n_values").alias("n_distinct"),
        F.when(is_table, F.array(F.array_join("rep_headers", " | "))).when(is_text, texts)
        .otherwise(F.array().cast("array<string>")).alias("sample_texts"),
        F.when(partial, F.transform(texts, lambda t: middle(t, pre, suf)))
        .otherwise(F.array().cast("array<string>")).alias("variable_parts"),
        F.when(is_table, F.coalesce(F.col("head_lo") == F.col("head_hi"), F.lit(True))).alias("header_identical"),
        F.when(is_table, rows_vary).alias("row_count_variable"),
        F.when(is_table, F.col("min_rows")).alias("min_rows"),
        F.when(is_table, F.col("max_rows")).alias("max_rows"),
        F.when(
            is_image,
            F.array_compact(F.array_distinct(F.transform("firsts", lambda s: s["image_hash"]))),
        ).otherwise(F.array().cast("array<string>")).alias("image_hashes"),
        F.when((missing > 0) & ~is_image, "absent in some samples").otherwise("").alias("notes"),
    )


def row_counts(aligned: DataFrame) -> DataFrame:
    """How many documents have each row count, per table node (complete list)."""
    return aligned_elements(aligned).where(F.col("e.table_structure").isNotNull()).groupBy(
        *NODE, F.col("e.table_structure.n_rows").alias("n_rows")
    ).agg(F.count(F.lit(1)).alias("n_docs"))


def distinct_texts(values: DataFrame, keys: list[str], order: str, max_samples: int | None = None) -> DataFrame:
    """Order-preserving distinct texts per key with the exact distinct count: all of
    them (meant for keys whose texts fit a row), or a preview of ``max_samples``."""
    firsts = values.groupBy(*keys, "text").agg(F.min(order).alias("_o"))
    total = firsts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))
    some = firsts if max_samples is None else cap_per_group(firsts, keys, ["_o"], max_samples)
    kept = some.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", "text"))), lambda s: s["text"]).alias("texts")
    )
    return total.join(kept, keys)


def diff_summary(diffs: DataFrame) -> DataFrame:
    """Per group: status -> number of nodes."""
    per = diffs.groupBy("group_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("group_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("summary")
    )
