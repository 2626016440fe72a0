"""Full-template mode: every text that is not exempt becomes a field.

Each document is walked in order with windows: a *segment* is a stretch of body
text between headings, tables, labels and exempt nodes; nodes of a segment that
have no field yet share one.  Only the final naming depends on all earlier
names, so that alone runs as an ordered fold per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom import vocabulary as V
from formloom.functions import text as X
from formloom.operators.elements import (
    is_exempt, is_generated_listing, is_structural_label, looks_like_data_table, with_hints,
)
from formloom.operators.naming import with_unique_names

_KEYS = ["group_id", "doc_id"]


def _mark(rationale: Column, mark: str) -> Column:
    have = F.coalesce(rationale, F.lit(""))
    return F.when(have.contains(mark), have).otherwise(X.strip(F.concat(X.rstrip(have), F.lit(f" {mark}"))))


def enforce_tags_only(elements: DataFrame, classified: DataFrame) -> DataFrame:
    """``classified`` with every non-exempt text fielded, plus ``forced`` (this
    pass made it a field)."""
    el = with_hints(elements).select(
        *_KEYS, "doc_order", "node_id", "parent_node_id", F.col("type").alias("el_type"), "subtype", "style_name",
        "text", "image_ref", "table_structure", "semantic_hints",
    )
    attrs = classified.drop("doc_order", "type", "section_key", "section_title")
    rows = el.join(attrs, [*_KEYS, "node_id"], "left").withColumn("type", F.col("el_type")).withColumn(
        "classification", F.coalesce("classification", F.lit("UNKNOWN"))
    )
    top = rows.where(F.col("parent_node_id").isNull())
    order = Window.partitionBy(*_KEYS).orderBy("doc_order")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    named = F.col("field_name").isNotNull() & F.col("classification").isin(*V.DYNAMIC)
    kept_run = named | (F.col("field_name").isNotNull() & (F.col("classification") == "REPEATABLE_SECTION"))
    top = (
        top.withColumn("exempt", is_exempt())
        .withColumn("label_node", ~F.col("exempt") & is_structural_label())
        .withColumn("generated", is_generated_listing())
        .withColumn("heading_node", ~F.col("exempt") & ~F.col("label_node") & (F.col("type") == "heading"))
        .withColumn("table_node", ~F.col("exempt") & ~F.col("label_node") & (F.col("type") == "table"))
    )
    opener = F.when(F.col("label_node") | F.col("heading_node"), F.nullif(X.strip("text"), F.lit("")))
    top = top.withColumn("section", F.coalesce(F.last(opener, ignorenulls=True).over(upto), F.lit("")))
    plain = ~F.col("exempt") & ~F.col("label_node") & ~F.col("heading_node") & ~F.col("table_node")
    groupable = plain & F.col("type").isin("paragraph", "list_item")
    loose = groupable & ~kept_run
    # A new run starts wherever the previous node was not a loose body node of
    # the same kind (generated listing or prose).
    before = F.lag(F.struct(loose.alias("loose"), F.col("generated").alias("generated"))).over(order)
    starts = ~loose | before.isNull() | ~before["loose"] | (before["generated"] != F.col("generated"))
    top = top.withColumn("_loose", loose).withColumn("_run", F.sum(starts.cast("int")).over(upto))
    run = Window.partitionBy(*_KEYS, "_run")
    top = top.withColumn("_run_n", F.count(F.lit(1)).over(run)).withColumn(
        "_run_at", F.row_number().over(run.orderBy("doc_order"))
    ).withColumn(
        "_run_text",
        # Only the run's first three texts are gathered, however long the run is.
        F.array_join(F.collect_list(F.when(F.col("_run_at") <= 3, X.stripped("text"))).over(
            run.orderBy("doc_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), " "),
    )
    looped = (F.col("classification") == "REPEATABLE_TABLE") & F.col("field_name").isNotNull()
    data = F.col("table_node") & (looped | looks_like_data_table(F.col("table_structure")))
    t = X.stripped("text")
    sect = F.col("section")
    grouped = F.col("_loose") & (F.col("_run_n") >= 2)
    any_named = named | kept_run

    def after(text: Column, fallback: str, tail: str) -> Column:
        return F.concat(X.slug(text, fallback), F.lit(tail))

    base = (
        F.when(F.col("exempt"), None)
        .when(F.col("label_node") & ~named, after(t, "label", "_label"))
        .when(F.col("heading_node") & ~named, after(sect, "section", "_title"))
        .when(data & ~looped, after(F.coalesce(F.nullif(sect, F.lit("")), F.lit("rows")), "rows", "_rows"))
        .when(grouped & (F.col("_run_at") == 1), after(F.coalesce(F.nullif(sect, F.lit("")), F.lit("body")), "body", "_body"))
        .when(grouped, None)
        .when(plain & ~kept_run, after(F.coalesce(F.nullif(sect, F.lit("")), t), "body", "_body"))
    )
    headers = F.array_join("table_structure.headers", ", ")
    top = (
        top.withColumn("base", base).withColumn("data_table", data).withColumn("_grouped", grouped)
        .withColumn("forced", ~F.col("exempt") & (
            ((F.col("label_node") | F.col("heading_node")) & ~named) | (data & ~looped) | (plain & ~kept_run)))
        .withColumn("_example", F.when(grouped, F.col("_run_text")).when(data, F.coalesce(F.nullif(headers, F.lit("")), F.lit("table"))).otherwise(t))
        .withColumn("_touched", ~F.col("exempt") & ~F.col("table_node") & any_named & ~(F.col("label_node")))
    )
    cells = _cells(rows, top)
    shared = [
        *_KEYS, "doc_order", "node_id", "type", "text", "classification", "field_name", "field_type", "description",
        "required", "confidence", "optional", "static_prefix", "static_suffix", "validation_hints", "enum_values",
        "rationale", "source", "section", "base", "forced", "_example", "_touched", "_grouped", "_run",
        "label_node", "data_table", "generated", "header_cell",
    ]
    walk = top.withColumn("header_cell", F.lit(False)).select(*shared).unionByName(cells.select(*shared))
    taken = classified.where(F.col("field_name").isNotNull()).groupBy(*_KEYS).agg(F.collect_set("field_name").alias("taken"))
    walk = with_unique_names(walk, _KEYS, "doc_order", "base", "new_name", taken)
    run_name = F.first("new_name", ignorenulls=True).over(
        Window.partitionBy(*_KEYS, "_run", "_grouped").orderBy("doc_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    walk = walk.withColumn("new_name", F.when(F.col("_grouped"), run_name).otherwise(F.col("new_name")))
    long_text = F.length(X.stripped("text")) > V.MULTILINE_CHARS
    cls = F.when(F.col("_grouped"), "REPEATABLE_SECTION").when(F.col("data_table"), "REPEATABLE_TABLE").otherwise("DYNAMIC_TEXT")
    kind = (
        F.when(F.col("_grouped"), "multiline_text").when(F.col("data_table"), "table")
        .when(F.col("label_node") | (F.col("type") == "heading"), "text").when(long_text, "multiline_text").otherwise("text")
    )
    forced, touched = F.col("forced"), F.col("forced") | F.col("_touched")
    structural = F.col("label_node") | F.col("header_cell")
    name = F.when(forced, F.col("new_name")).otherwise(F.col("field_name"))
    rationale = F.when(touched, _mark(F.col("rationale"), V.TAGS_ONLY_MARK)).otherwise(F.col("rationale"))
    rationale = F.when(structural, _mark(rationale, V.STRUCTURAL_MARK)).otherwise(rationale)
    rationale = F.when(F.col("generated") & name.isNotNull(), _mark(rationale, V.GENERATED_MARK)).otherwise(rationale)
    described = F.when(
        touched & X.is_blank("description"), X.synth_description(F.col("section"), F.col("_example"))
    ).otherwise(F.col("description"))
    sections = classified.select(*_KEYS, "node_id", "section_key", "section_title")
    out = walk.select(
        *_KEYS, "doc_order", "node_id", "type",
        F.when(forced, cls).otherwise(F.col("classification")).alias("classification"), name.alias("field_name"),
        F.when(forced, kind).otherwise(F.col("field_type")).alias("field_type"), described.alias("description"),
        F.when(structural, False).when(touched, True).otherwise(F.coalesce("required", F.lit(False))).alias("required"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        F.when(touched, False).otherwise(F.coalesce("optional", F.lit(False))).alias("optional"),
        F.when(~touched, F.col("static_prefix")).alias("static_prefix"),
        F.when(~touched, F.col("static_suffix")).alias("static_suffix"),
        "validation_hints", "enum_values", rationale.alias("rationale"), F.coalesce("source", F.lit("heuristic")).alias("source"), "forced",
    )
    untouched = classified.join(out.select(*_KEYS, "node_id"), [*_KEYS, "node_id"], "left_anti").withColumn("forced", F.lit(False))
    return out.join(sections, [*_KEYS, "node_id"], "left").unionByName(untouched, allowMissingColumns=True)


def _cells(rows: DataFrame, top: DataFrame) -> DataFrame:
    """Cells that get a field: the header row of a data table, all of a layout table."""
    tables = top.where(F.col("table_node")).select(
        *_KEYS, F.col("node_id").alias("parent_node_id"), F.col("section").alias("t_section"), F.col("data_table").alias("in_data"),
        F.col("text").alias("t_text"),
    )
    named = F.col("field_name").isNotNull() & F.col("classification").isin(*V.DYNAMIC)
    cells = rows.where(F.col("parent_node_id").isNotNull()).join(tables, [*_KEYS, "parent_node_id"]).where(
        ~X.is_blank("text") & ~named & (~F.col("in_data") | (X.cell_row("subtype") == 0))
    )
    lead = X.slug(F.coalesce(F.nullif("t_section", F.lit("")), F.nullif(F.col("t_text"), F.lit("")), F.lit("cell")), "cell")
    return (
        cells.withColumn("section", F.col("t_section"))
        .withColumn("base", F.concat(lead, F.lit("_"), X.cell_name(X.stripped("text"))))
        .withColumn("forced", F.lit(True)).withColumn("_example", X.stripped("text")).withColumn("_touched", F.lit(False))
        .withColumn("_grouped", F.lit(False)).withColumn("_run", F.lit(-1).cast("bigint"))
        .withColumn("label_node", F.lit(False)).withColumn("data_table", F.lit(False))
        .withColumn("generated", F.lit(False)).withColumn("header_cell", F.col("in_data"))
    )
