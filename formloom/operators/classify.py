"""Rule-based classification of a representative's elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom import vocabulary as V
from formloom.functions import text as X
from formloom.operators.elements import (
    assign_sections, looks_like_data_table, top_level, with_hints,
)
from formloom.operators.naming import with_unique_names

BODY_RATIONALE = "single-doc body content"


def kind_class(kind: Column, label: Column) -> Column:
    """Classification of a value kind; a name counts as a person only under a
    person-like label (or none)."""
    person = (kind == "person") & (X.label_is_personish(label) | (F.coalesce(label, F.lit("")) == ""))
    return (
        F.when(kind == "date", "DYNAMIC_DATE").when(kind == "number", "DYNAMIC_NUMBER")
        .when(person, "DYNAMIC_PERSON").otherwise("DYNAMIC_TEXT")
    )


def _field_type(classification: Column) -> Column:
    return (
        F.when(classification == "DYNAMIC_DATE", "date").when(classification == "DYNAMIC_NUMBER", "number")
        .when(classification == "DYNAMIC_PERSON", "person").otherwise("text")
    )


def _hints(kind: Column) -> Column:
    return (
        F.when(kind == "date", F.array(F.lit("Expected a date (e.g. YYYY-MM-DD)")))
        .when(kind == "number", F.array(F.lit("Expected a numeric value")))
        .when(kind == "person", F.array(F.lit("Expected a person name")))
        .otherwise(F.array().cast("array<string>"))
    )


def _decision(**given: Column) -> Column:
    """One classification struct; what a branch leaves out takes the default."""
    shape = {
        "classification": ("string", F.lit("FIXED")),
        "base": ("string", F.lit(None)),
        "field_type": ("string", F.lit(None)),
        "description": ("string", F.lit("")),
        "required": ("boolean", F.lit(False)),
        "confidence": ("double", F.lit(0.5)),
        "static_prefix": ("string", F.lit(None)),
        "static_suffix": ("string", F.lit(None)),
        "validation_hints": ("array<string>", F.array()),
        "rationale": ("string", F.lit("")),
    }
    return F.struct(*[given.get(k, d).cast(t).alias(k) for k, (t, d) in shape.items()])


def _fixed(confidence: Column | float, rationale: str) -> Column:
    conf = F.lit(confidence) if isinstance(confidence, float) else confidence
    return _decision(confidence=conf, rationale=F.lit(rationale))


def classify_table() -> Column:
    ts = F.col("table_structure")
    compared = F.col("status").isNotNull()
    repeats = F.when(
        compared, F.coalesce(F.col("row_count_variable"), F.lit(False)) | F.col("status").isin("row_count_changed", "changed")
    ).otherwise(looks_like_data_table(ts))
    conf = F.when(compared, F.col("diff_confidence")).when(ts["n_rows"] - 1 >= 2, 0.6).otherwise(0.45)
    base = X.slug(F.col("section_title"), "rows")
    return (
        F.when(F.col("status") == "identical", _fixed(F.col("diff_confidence"), "table identical across samples"))
        .when(~repeats, _fixed(conf, "static table"))
        .otherwise(
            _decision(
                classification=F.lit("REPEATABLE_TABLE"), base=base, field_type=F.lit("table"),
                description=F.concat(F.lit("Repeatable table rows for '"), F.col("section_title"), F.lit("'")),
                required=F.lit(True), confidence=conf,
                validation_hints=F.when(
                    F.size(ts["headers"]) > 0,
                    F.array(F.concat(F.lit("columns: "), F.array_join(ts["headers"], ", "))),
                ).otherwise(F.array().cast("array<string>")),
                rationale=F.when(compared, "table rows vary across samples").otherwise("multi-row data table"),
            )
        )
    )


def dynamic_from_diff() -> Column:
    """A field named after its label, else its section, typed by what varied."""
    label = X.strip(F.rtrim(X.stripped("static_prefix"), F.lit(":")))
    kind = F.coalesce("detected_kind", X.value_kind("text"))
    cls = kind_class(kind, label)
    base = F.when(label != "", X.slug(label)).otherwise(
        X.slug(F.coalesce(F.nullif("section_title", F.lit("")), F.col("text")))
    )
    return _decision(
        classification=cls, base=base, field_type=_field_type(cls),
        description=F.concat(
            F.lit("Dynamic "), kind, F.lit(" value"),
            F.when(label != "", F.concat(F.lit(" for '"), label, F.lit("'"))).otherwise(""),
        ),
        required=~F.coalesce(F.col("notes"), F.lit("")).contains("absent"),
        confidence=F.col("diff_confidence"), static_prefix=F.col("static_prefix"),
        static_suffix=F.col("static_suffix"), validation_hints=_hints(kind),
        rationale=F.concat(F.lit("diff:"), F.col("status")),
    )


def classify_single() -> Column:
    """With one document only: labelled values, titles, typed tokens, prose."""
    t = F.col("t")
    label = F.col("label")
    value = F.col("label_value")
    vkind = F.col("label_kind")
    vcls = kind_class(vkind, label)
    kind = F.col("text_kind")
    title = F.col("section_title")
    typed = kind_class(kind, title)
    caps = F.array_contains(F.col("semantic_hints"), "all_caps")
    prose = F.col("type").isin("paragraph", "list_item") & (t != "")
    return (
        F.when(
            value != "",
            _decision(
                classification=vcls, base=X.slug(label), field_type=_field_type(vcls),
                description=F.concat(F.lit("Value for '"), X.strip(label), F.lit("'")),
                required=F.lit(True), confidence=F.lit(0.55),
                static_prefix=F.concat(label, F.lit(": ")), static_suffix=F.lit(""),
                validation_hints=_hints(vkind), rationale=F.lit("single-doc labeled value"),
            ),
        )
        .when(caps & (F.length(t) < 80), _fixed(0.6, "all-caps title"))
        .when(
            (kind != "text") & (F.length(t) < 60),
            _decision(
                classification=typed, base=X.slug(title, kind), field_type=_field_type(typed),
                description=F.concat(F.lit("Standalone "), kind, F.lit(" value")),
                required=F.lit(True), validation_hints=_hints(kind),
                rationale=F.lit("single-doc typed token"),
            ),
        )
        .when(
            prose,
            _decision(
                classification=F.lit("DYNAMIC_TEXT"), base=X.slug(title, "body"),
                field_type=F.when(F.length(t) > V.MULTILINE_CHARS, "multiline_text").otherwise("text"),
                description=F.concat(F.lit("Content for '"), title, F.lit("'")),
                required=F.lit(True), rationale=F.lit(BODY_RATIONALE),
            ),
        )
        .otherwise(_fixed(0.5, "single-doc default fixed"))
    )


def _element_decision() -> Column:
    hints = F.col("semantic_hints")
    varies = F.col("status").isin("changed", "partial_change")
    heading_conf = F.coalesce(F.col("diff_confidence"), F.lit(0.7))
    return (
        F.when(
            F.array_contains(hints, "auto_field") | F.array_contains(hints, "toc"),
            _decision(classification=F.lit("AUTO_FIELD"), confidence=F.lit(0.9), rationale=F.lit("Word field / auto content")),
        )
        .when(
            F.col("status") == "image_changed",
            _decision(
                classification=F.lit("UNKNOWN"), confidence=F.lit(0.4), rationale=F.lit("varying image"),
                description=F.lit("Image differs across samples (image templating is out of scope in v1)"),
            ),
        )
        .when(F.col("type") == "table", classify_table())
        .when(varies, dynamic_from_diff())
        .when(F.col("type") == "heading", _fixed(heading_conf, "heading / structural label"))
        .when(F.col("status") == "identical", _fixed(F.col("diff_confidence"), "identical across samples"))
        .otherwise(classify_single())
    )


_DIFF_COLUMNS = (
    "status", "row_count_variable", "detected_kind", "static_prefix", "static_suffix", "notes", "is_optional",
)
_KEYS = ["group_id", "doc_id"]


def classify(elements: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """Class of every element of every given document.

    With ``diffs`` the elements are the groups' representatives and the evidence
    decides; without, each document is read on its own (and body runs merge).
    Columns: ``group_id, doc_id, doc_order, node_id, classification, field_name,
    field_type, description, required, confidence, optional, static_prefix,
    static_suffix, validation_hints, enum_values, rationale, section_key,
    section_title, source``.
    """
    tops = assign_sections(with_hints(top_level(elements)))
    if diffs is not None:
        evidence = diffs.select("group_id", "node_id", F.col("confidence").alias("diff_confidence"), *_DIFF_COLUMNS)
        tops = tops.join(evidence, ["group_id", "node_id"], "left")
    else:
        nothing = {
            "diff_confidence": "double", "status": "string", "row_count_variable": "boolean",
            "detected_kind": "string", "static_prefix": "string", "static_suffix": "string",
            "notes": "string", "is_optional": "boolean",
        }
        tops = tops.select("*", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    colon = F.instr("t", ":")
    tops = (
        tops.withColumn("t", X.stripped("text"))
        .withColumn("label", F.when((colon > 0) & (F.col("type") != "list_item"), F.substr("t", F.lit(1), colon - 1)))
        .withColumn("label_value", F.when(F.col("label").isNotNull(), X.strip(F.substr("t", colon + 1))))
        .withColumn("label_kind", X.value_kind("label_value"))
        .withColumn("text_kind", X.value_kind("t"))
    )
    decided = tops.withColumn("d", _element_decision()).select(
        *_KEYS, "doc_order", "node_id", "type", "section_key", "section_title", "d.*",
        F.coalesce((F.col("d.classification") != "AUTO_FIELD") & F.col("is_optional"), F.lit(False)).alias("optional"),
    )
    named = with_unique_names(decided, _KEYS, "doc_order", "base", "field_name").drop("base")
    if diffs is None:
        named = group_body_runs(named)
    nested = elements.where(F.col("parent_node_id").isNotNull()).select(
        *_KEYS, "doc_order", "node_id", "type",
        F.lit(None).cast("string").alias("section_key"), F.lit(None).cast("string").alias("section_title"),
        F.lit(False).alias("optional"), _fixed(0.5, "inside table cell").alias("d"),
    ).select(*_KEYS, "doc_order", "node_id", "type", "section_key", "section_title", "d.*", "optional").withColumn(
        "field_name", F.lit(None).cast("string")
    ).drop("base")
    return named.unionByName(nested).withColumn(
        "enum_values", F.array().cast("array<string>")
    ).withColumn("source", F.lit("heuristic"))


def group_body_runs(classified: DataFrame) -> DataFrame:
    """Two or more body nodes in a row share the first one's field name and
    become one repeatable section."""
    order = Window.partitionBy(*_KEYS).orderBy("doc_order")
    is_body = (F.col("rationale") == BODY_RATIONALE) & F.col("type").isin("paragraph", "list_item")
    marked = classified.withColumn("_body", is_body).withColumn(
        "_run", F.sum((~F.col("_body")).cast("int")).over(order)
    )
    run = Window.partitionBy(*_KEYS, "_run", "_body")
    first = F.first("field_name").over(run.orderBy("doc_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = marked.withColumn("_n", F.count(F.lit(1)).over(run)).withColumn("_first", first)
    merged = F.col("_body") & (F.col("_n") >= 2)
    return (
        marked.withColumn("classification", F.when(merged, "REPEATABLE_SECTION").otherwise(F.col("classification")))
        .withColumn("field_type", F.when(merged, "multiline_text").otherwise(F.col("field_type")))
        .withColumn("field_name", F.when(merged, F.col("_first")).otherwise(F.col("field_name")))
        .withColumn("rationale", F.when(merged, "single-doc body run").otherwise(F.col("rationale")))
        .drop("_body", "_run", "_n", "_first")
    )


def sections_of(elements: DataFrame, classified: DataFrame) -> DataFrame:
    """One row per section of a document: title, purpose, its field names in order."""
    heads = assign_sections(top_level(elements)).where(
        (F.col("type") == "heading") & (F.col("section_key") == F.col("node_id"))
    ).select(*_KEYS, F.col("doc_order").alias("section_order"), "section_key", F.col("section_title").alias("title"))
    top = elements.select(*_KEYS).distinct().select(
        *_KEYS, F.lit(-1).alias("section_order"), F.lit("preamble").alias("section_key"), F.lit("Preamble").alias("title")
    )
    names = classified.where(F.col("field_name").isNotNull()).groupBy(*_KEYS, "section_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("doc_order", "field_name"))), lambda s: s["field_name"]).alias("field_names")
    )
    purpose = F.when(F.col("section_key") == "preamble", "Top-of-document content.").otherwise(
        F.concat(F.lit("Content belonging to the '"), F.col("title"), F.lit("' section."))
    )
    return heads.unionByName(top).join(names, [*_KEYS, "section_key"], "left").select(
        *_KEYS, "section_order", "section_key", "title", purpose.alias("purpose"),
        F.coalesce("field_names", F.array().cast("array<string>")).alias("field_names"),
    )


def guess_doc_type(elements: DataFrame) -> DataFrame:
    """First all-caps title of a document, else its first heading, as a title."""
    t = F.col("t")
    tops = top_level(elements).withColumn("t", X.stripped("text"))
    # Of the hints only this one counts, so the patterns of the others are not searched.
    hinted = F.when(F.col("semantic_hints").isNotNull(), F.array_contains("semantic_hints", "all_caps")).when(
        F.col("type") == "table", F.lit(False)).otherwise(X.is_all_caps("text"))
    caps = hinted & (F.length(t) > 3) & (F.length(t) < 80)
    head = (F.col("type") == "heading") & (t != "")
    best = tops.groupBy(*_KEYS).agg(
        F.min_by(F.when(caps, t), F.when(caps, F.col("doc_order"))).alias("caps"),
        F.min_by(F.when(head, t), F.when(head, F.col("doc_order"))).alias("head"),
    )
    return best.select(*_KEYS, F.coalesce(X.title_case(F.coalesce("caps", "head")), F.lit("Document")).alias("document_type"))


def classification_breakdown(classified: DataFrame) -> DataFrame:
    return classified.groupBy("group_id", "classification").agg(F.count(F.lit(1)).alias("n_nodes"))


def questionable(classified: DataFrame) -> DataFrame:
    """Nodes worth a second look, the first 24 of each document."""
    from formloom.operators.elements import cap_per_group

    doubt = (
        (F.col("confidence") < 0.6)
        | (F.col("classification") == "UNKNOWN")
        | (F.col("field_name").isNotNull() & X.is_blank("description"))
    )
    return cap_per_group(classified.where(doubt), _KEYS, ["doc_order"], V.CRITIQUE_LIMIT)
