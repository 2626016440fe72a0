"""A template described as a document: its sections, their fields and where each stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formloom.operators.elements import nearest_heading, top_level
from formloom.operators.naming import resolve_section_keys

#: Purposes and contents of sections are prose; longer ones are cut.
PURPOSE_CHARS = 300
#: The order of a field whose place is unknown.
NOWHERE = 10_000


def field_places(fields: DataFrame, classified: DataFrame, elements: DataFrame) -> DataFrame:
    """One row per field: where it first appears (``order``), the heading above its first
    node, and the wording around its value.  All tables are keyed by ``template_id``."""
    tops = nearest_heading(top_level(elements.withColumn("group_id", F.col("template_id"))))
    place = F.row_number().over(Window.partitionBy("template_id").orderBy("doc_order")) - 1
    at = tops.withColumn("at", place).select("template_id", "node_id", "at", "under_heading")
    nodes = fields.select("template_id", "field_name", F.posexplode("node_ids").alias("i", "node_id")).join(
        at, ["template_id", "node_id"], "left")
    where = nodes.groupBy("template_id", "field_name").agg(
        F.min("at").alias("at"), F.min_by("under_heading", "i").alias("under_heading"))
    wording = classified.where(F.col("field_name").isNotNull()).groupBy("template_id", "field_name").agg(
        F.min_by(F.struct("static_prefix", "static_suffix"), "doc_order").alias("w"))  # the first class of the name
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return fields.join(where, ["template_id", "field_name"], "left").join(wording, ["template_id", "field_name"], "left").select(
        "template_id", "field_order", "field_name", F.col("section_key").alias("section"),
        F.coalesce("at", F.lit(NOWHERE)).cast("bigint").alias("order"), blank("under_heading").alias("under_heading"),
        blank("w.static_prefix").alias("label_before"), blank("w.static_suffix").alias("label_after"),
    )


def template_context(fields: DataFrame, sections: DataFrame, classified: DataFrame, elements: DataFrame,
                     document_types: DataFrame | None = None) -> DataFrame:
    """One row per template with fields: ``template_id, document_type, sections, places``.

    ``sections`` is an array of (section_key, title, purpose, fields), ``places`` one of
    (field_name, section, order, under_heading, label_before, label_after) in field
    order; fields without a section first get one (:func:`resolve_section_keys`).
    Nested by two aggregates over a template's own rows, which are few."""
    placed = field_places(resolve_section_keys(fields, sections), classified, elements)
    members = placed.where(F.col("section").isNotNull()).groupBy("template_id", F.col("section").alias("section_key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("field_order", "field_name"))), lambda x: x["field_name"]).alias("fields"))
    told = sections.join(members, ["template_id", "section_key"], "left").groupBy("template_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "section_order", "section_key", "title", F.substring(F.coalesce("purpose", F.lit("")), 1, PURPOSE_CHARS).alias("purpose"),
            F.coalesce("fields", F.array().cast("array<string>")).alias("fields")))).alias("s"))
    places = placed.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct(
        "field_order", "field_name", "section", "order", "under_heading", "label_before", "label_after"))).alias("p"))
    out = places.join(told, "template_id", "left")
    if document_types is not None:
        out = out.join(document_types.select("template_id", "document_type"), "template_id", "left")
    else:
        out = out.withColumn("document_type", F.lit(""))
    none = F.array().cast("array<struct<section_key:string,title:string,purpose:string,fields:array<string>>>")
    return out.select(
        "template_id", F.coalesce("document_type", F.lit("")).alias("document_type"),
        F.coalesce(F.transform("s", lambda x: F.struct(x["section_key"], x["title"], x["purpose"], x["fields"])), none).cast(
            "array<struct<section_key:string,title:string,purpose:string,fields:array<string>>>").alias("sections"),
        F.transform("p", lambda x: F.struct(
            x["field_name"].alias("field_name"), x["section"].alias("section"), x["order"].alias("order"), x["under_heading"].alias("under_heading"),
            x["label_before"].alias("label_before"), x["label_after"].alias("label_after"))).alias("places"),
    )
