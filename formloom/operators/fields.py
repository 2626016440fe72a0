"""From classifications to fillable fields and validation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom import vocabulary as V
from formloom.functions import text as X
from formloom.operators.naming import unique_names
from formloom.schemas import TABLE_COLUMN_TYPE

_KEYS = ["group_id", "doc_id"]


def block_columns() -> Column:
    return F.array(
        F.struct(F.lit("title").alias("field_name"), F.lit("Heading").alias("label"),
                 F.lit("text").alias("field_type"), F.lit(False).alias("required")),
        F.struct(F.lit("body").alias("field_name"), F.lit("Content").alias("label"),
                 F.lit("multiline_text").alias("field_type"), F.lit(False).alias("required")),
    ).cast(f"array<{TABLE_COLUMN_TYPE}>")


def with_table_columns(df: DataFrame, headers: str, out: str) -> DataFrame:
    """Add ``out``: named and typed columns of a table's header row."""
    bases = F.transform(headers, lambda h, i: X.slug(h, F.concat(F.lit("col"), (i + 1).cast("string"))))
    def column(h: Column, i: Column) -> Column:
        return F.struct(
            F.get("_names", i).alias("field_name"),
            F.coalesce(F.nullif(h, F.lit("")), F.concat(F.lit("Column "), (i + 1).cast("string"))).alias("label"),
            X.column_type(h).alias("field_type"),
            F.lit(False).alias("required"),
        )
    return df.withColumn("_names", unique_names(bases)).withColumn(
        out, F.transform(headers, column).cast(f"array<{TABLE_COLUMN_TYPE}>")
    ).drop("_names")


def group_by_field(rows: DataFrame) -> DataFrame:
    """Rows sharing a field name become one field: node ids in order, the first
    row's other values."""
    rest = [c for c in rows.columns if c not in (*_KEYS, "field_name", "node_id", "doc_order")]
    return rows.groupBy(*_KEYS, "field_name").agg(
        F.min("doc_order").alias("doc_order"),
        F.transform(F.array_sort(F.collect_list(F.struct("doc_order", "node_id"))), lambda s: s["node_id"]).alias("node_ids"),
        F.min_by(F.struct(*rest), "doc_order").alias("first"),
    ).select(*_KEYS, "doc_order", "field_name", "node_ids", "first.*")


def derive_fields(elements: DataFrame, classified: DataFrame) -> DataFrame:
    """Ordered field list per document: value fields, then pictures, then the
    include-toggles of optional content.

    Columns: ``group_id, doc_id, field_order, field_name, label, field_type,
    classification, description, required, enum_values, default, node_ids,
    section_key, columns, confidence``.
    """
    el = elements.select(
        *_KEYS, "node_id", "text", F.col("type").alias("el_type"), "image_ref", "header_footer_scope",
        F.col("table_structure.headers").alias("headers"),
    )
    joined = classified.join(el, [*_KEYS, "node_id"], "left")
    layout_blank = X.is_blank("text") & (F.col("el_type") != "table") & (F.col("el_type") != "image") & F.col("image_ref").isNull()
    values = group_by_field(
        joined.where(
            F.col("field_name").isNotNull() & F.col("classification").isin(*V.NEEDS_FIELD) & ~layout_blank
        ).select(
            *_KEYS, "doc_order", "node_id", "field_name", "classification", "field_type", "description", "required",
            "optional", "enum_values", "static_prefix", "rationale", "section_key", "confidence", "text",
            F.coalesce("headers", F.array().cast("array<string>")).alias("headers"),
        )
    )
    values = with_table_columns(values, "headers", "_cols")
    label = X.label_from("field_name", "static_prefix")
    described = F.coalesce(
        F.nullif(X.stripped("description"), F.lit("")),
        X.fallback_description(label, F.col("classification"), F.col("static_prefix"), F.col("enum_values"), F.col("text")),
    )
    no_columns = F.array().cast(f"array<{TABLE_COLUMN_TYPE}>")
    value_fields = values.select(
        *_KEYS, F.lit(0).alias("part"), "doc_order", "field_name", label.alias("label"),
        F.coalesce("field_type", F.lit("text")).alias("field_type"), "classification",
        described.alias("description"), (F.col("required") & ~F.col("optional")).alias("required"), "enum_values",
        F.when(F.col("rationale").contains(V.STRUCTURAL_MARK), X.strip("text")).alias("default"),
        "node_ids", "section_key",
        F.when(F.col("classification") == "REPEATABLE_TABLE", F.col("_cols"))
        .when(F.col("classification") == "REPEATABLE_BLOCK", block_columns()).otherwise(no_columns).alias("columns"),
        "confidence",
    )
    pictures = image_fields(elements, value_fields)
    # A picture without words is only its picture field.
    wordless = elements.where(
        F.col("image_ref.content_type").startswith("image/") & X.is_blank("text")
    ).groupBy(*_KEYS).agg(F.collect_set("node_id").alias("wordless"))
    value_fields = value_fields.join(wordless, _KEYS, "left").where(
        ~F.coalesce(F.arrays_overlap("node_ids", "wordless"), F.lit(False))
    ).drop("wordless")
    toggles = include_toggles(joined)
    all_fields = value_fields.unionByName(pictures).unionByName(toggles)
    rank = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("part", "doc_order")) - 1
    return all_fields.withColumn("field_order", rank).drop("part", "doc_order")


def image_fields(elements: DataFrame, value_fields: DataFrame) -> DataFrame:
    """One optional field per raster picture, numbered in walk order."""
    pics = elements.where(F.col("image_ref.content_type").startswith("image/")).withColumn(
        "n_img", F.row_number().over(Window.partitionBy(*_KEYS).orderBy("doc_order"))
    )
    scope = F.coalesce(F.regexp_extract("header_footer_scope", "^(header|footer)", 1), F.lit(""))
    base = F.concat(F.when(scope != "", F.concat(scope, F.lit("_"))).otherwise(""), F.lit("image_"), F.col("n_img").cast("string"))
    taken = value_fields.groupBy(*_KEYS).agg(F.collect_set("field_name").alias("taken"))
    packed = pics.groupBy(*_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("doc_order", "node_id", "n_img", base.alias("base")))).alias("rows")
    ).join(taken, _KEYS, "left")
    named = packed.withColumn(
        "names", unique_names(F.transform("rows", lambda r: r["base"]), F.coalesce("taken", F.array().cast("array<string>")))
    )
    flat = named.select(*_KEYS, F.inline(F.arrays_zip(F.col("rows").alias("r"), F.col("names").alias("n"))))
    return flat.select(
        *_KEYS, F.lit(1).alias("part"), F.col("r.doc_order").alias("doc_order"), F.col("n").alias("field_name"),
        F.concat(F.lit("Image "), F.col("r.n_img").cast("string")).alias("label"),
        F.lit("image").alias("field_type"), F.lit("DYNAMIC_IMAGE").alias("classification"),
        F.lit("Replace this picture per document, or keep the original.").alias("description"),
        F.lit(False).alias("required"), F.array().cast("array<string>").alias("enum_values"),
        F.lit(None).cast("string").alias("default"), F.array(F.col("r.node_id")).alias("node_ids"),
        F.lit(None).cast("string").alias("section_key"),
        F.array().cast(f"array<{TABLE_COLUMN_TYPE}>").alias("columns"), F.lit(0.5).alias("confidence"),
    )


def include_toggles(joined: DataFrame) -> DataFrame:
    """A boolean per optional node, on by default; the first of a name counts."""
    optional = joined.where(F.col("optional") & (F.col("classification") != "AUTO_FIELD")).withColumn(
        "toggle", X.include_field_name("field_name", "text")
    )
    preview = F.coalesce(F.nullif(F.substring("text", 1, 40), F.lit("")), F.col("field_name"), F.lit("section"))
    firsts = optional.groupBy(*_KEYS, "toggle").agg(
        F.min("doc_order").alias("doc_order"),
        F.min_by(F.struct(preview.alias("preview"), "node_id", "section_key", "field_name", "confidence"), "doc_order").alias("f"),
    )
    return firsts.select(
        *_KEYS, F.lit(2).alias("part"), "doc_order", F.col("toggle").alias("field_name"),
        F.concat(F.lit("Include: "), F.col("f.preview")).alias("label"), F.lit("boolean").alias("field_type"),
        F.lit("FIXED").alias("classification"), F.lit("Whether to include this optional content.").alias("description"),
        F.lit(False).alias("required"), F.array().cast("array<string>").alias("enum_values"),
        F.lit("true").alias("default"), F.array(F.col("f.node_id")).alias("node_ids"),
        F.when(F.col("f.field_name").isNotNull(), F.col("f.section_key")).alias("section_key"),
        F.array().cast(f"array<{TABLE_COLUMN_TYPE}>").alias("columns"), F.col("f.confidence").alias("confidence"),
    )


RULE_PARAMS = (
    "struct<formats:array<string>,allowed:array<string>,min:int,max:int,pattern:string,"
    "columns:array<string>,required_columns:array<string>>"
)


RULE = f"struct<rule_id:string,rule_type:string,params:{RULE_PARAMS},message:string,severity:string>"


def rule_params(**given: Column) -> Column:
    kinds = {"formats": "array<string>", "allowed": "array<string>", "min": "int", "max": "int",
             "pattern": "string", "columns": "array<string>", "required_columns": "array<string>"}
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def rules_of_field(f: str = "") -> Column:
    """``ARRAY<STRUCT>`` of the baseline rules of one field row."""
    name, label, kind = F.col(f + "field_name"), F.col(f + "label"), F.col(f + "field_type")
    quoted = F.concat(F.lit("'"), label, F.lit("'"))

    def rule(rule_type: str, message: Column, severity: str, params: Column) -> Column:
        return F.struct(
            F.concat(name, F.lit(f":{rule_type}")).alias("rule_id"), F.lit(rule_type).alias("rule_type"),
            params.alias("params"), message.alias("message"), F.lit(severity).alias("severity"),
        ).cast(RULE)

    cols = F.col(f + "columns")
    return F.array_compact(F.array(
        F.when(F.col(f + "required"), rule("required", F.concat(quoted, F.lit(" is required")), "error", rule_params())),
        F.when(kind == "date", rule(
            "date_format", F.concat(quoted, F.lit(" should be a valid date")), "warning",
            rule_params(formats=F.array(*[F.lit(x) for x in V.RULE_DATE_FORMATS])))),
        F.when(kind == "number", rule(
            "numeric_format", F.concat(quoted, F.lit(" should be numeric")), "warning", rule_params())),
        F.when((kind == "enum") & (F.size(f + "enum_values") > 0), rule(
            "enum", F.concat(quoted, F.lit(" must be one of: "), F.array_join(f + "enum_values", ", ")), "error",
            rule_params(allowed=F.col(f + "enum_values")))),
        F.when(kind == "table", rule(
            "table_schema", F.concat(F.lit("Rows of "), quoted, F.lit(" must match the column schema")), "warning",
            rule_params(columns=F.transform(cols, lambda c: c["field_name"]),
                        required_columns=F.transform(F.filter(cols, lambda c: c["required"]), lambda c: c["field_name"])))),
    ))


def derive_rules(fields: DataFrame) -> DataFrame:
    """Baseline validation rules, one row each, in field order."""
    return fields.select(
        *_KEYS, "field_order", "field_name", F.posexplode(rules_of_field()).alias("rule_order", "r")
    ).select(*_KEYS, "field_order", "rule_order", "field_name", "r.*")


def _folded(overrides: DataFrame) -> DataFrame:
    """One edit per node: any ``exclude`` wins; else the last ``include`` or ``promote``
    by ``ord`` (by values where the edits carry none)."""
    names = ("field_name", "field_type", "classification", "required")
    ord_ = F.col("ord").cast("bigint") if "ord" in overrides.columns else F.lit(0).cast("bigint")
    edit = F.struct(ord_.alias("ord"), "action", *names)
    return overrides.groupBy("group_id", "node_id").agg(
        F.bool_or(F.col("action") == "exclude").alias("out"),
        F.max(F.when(F.col("action").isin("include", "promote"), edit)).alias("e"),
    ).select("group_id", "node_id", "out", F.when(~F.col("out"), F.col("e")).alias("e"))


def apply_overrides(classified: DataFrame, overrides: DataFrame) -> DataFrame:
    """Publish-time edits of classes.  ``overrides(group_id, node_id, action, field_name,
    field_type, classification, required[, ord])``: ``exclude`` -> FIXED, ``include`` ->
    the edited field's values, ``promote`` -> a text field."""
    j = classified.join(_folded(overrides), ["group_id", "node_id"], "left")
    out, e = F.coalesce("out", F.lit(False)), F.col("e")
    inn = e.isNotNull()
    promoted = F.when(e["action"] == "promote", F.coalesce(e["classification"], F.lit("DYNAMIC_TEXT"))).otherwise(
        F.coalesce(e["classification"], "classification"))
    return j.withColumns({
        "classification": F.when(out, "FIXED").when(inn, promoted).otherwise(F.col("classification")),
        "field_name": F.when(out, None).when(inn, F.coalesce(e["field_name"], "field_name")).otherwise(F.col("field_name")),
        "field_type": F.when(inn, F.coalesce(e["field_type"], "field_type", F.lit("text"))).otherwise(F.col("field_type")),
        "required": F.when(inn, F.coalesce(e["required"], "required")).otherwise(F.col("required")),
    }).select(*classified.columns)


def edit_fields(fields: DataFrame, overrides: DataFrame, classified: DataFrame) -> DataFrame:
    """The field list after the same edits: fields of excluded nodes go, included ones
    take the edited name, type and required flag, promoted nodes become text fields of
    their own behind the others, in document order.  A toggle or picture goes with its
    node only where that node is excluded."""
    edits = _folded(overrides)
    owned = fields.select("group_id", "field_name", F.explode("node_ids").alias("node_id")).join(edits, ["group_id", "node_id"])
    per = owned.groupBy("group_id", "field_name").agg(
        F.bool_or("out").alias("out"), F.max_by("e", F.struct(F.col("e.ord"), "node_id")).alias("e"))
    value = ~F.col("field_type").isin("boolean", "image")
    kept = fields.join(per, ["group_id", "field_name"], "left").where(~F.coalesce("out", F.lit(False)))
    e = F.when(value, F.col("e"))
    name = F.coalesce(e["field_name"], "field_name")
    kept = kept.withColumns({
        "label": F.when(name != F.col("field_name"), X.label_from(name, F.lit(None).cast("string"))).otherwise(F.col("label")),
        "field_type": F.coalesce(e["field_type"], "field_type"), "classification": F.coalesce(e["classification"], "classification"),
        "required": F.coalesce(e["required"], "required"),
    }).withColumn("field_name", name).select(*fields.columns)
    new = edits.where("e.action = 'promote'").join(
        fields.select("group_id", F.explode("node_ids").alias("node_id")), ["group_id", "node_id"], "left_anti"
    ).join(classified.select("group_id", "doc_id", "node_id", "doc_order", "section_key"), ["group_id", "node_id"])
    named = F.coalesce("e.field_name", "node_id")
    given = {
        "field_name": named, "label": X.label_from(named, F.lit(None).cast("string")), "field_type": F.coalesce("e.field_type", F.lit("text")),
        "classification": F.coalesce("e.classification", F.lit("DYNAMIC_TEXT")), "description": F.lit(""),
        "required": F.coalesce("e.required", F.lit(False)), "node_ids": F.array("node_id"), "confidence": F.lit(1.0),
        "enum_values": F.array(), "columns": F.array(), "default": F.lit(None),
    }
    last = fields.groupBy("group_id").agg(F.max("field_order").alias("_last"))
    at = F.row_number().over(Window.partitionBy("group_id").orderBy("doc_order"))
    added = new.join(last, "group_id", "left").withColumn("field_order", F.coalesce("_last", F.lit(-1)) + at)
    kinds = {f.name: f.dataType for f in fields.schema}
    return kept.unionByName(added.select(*[given.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in fields.columns]))


def merge_field_edits(classified: DataFrame, fields: DataFrame) -> DataFrame:
    """Republish: a field class without its field falls back to FIXED; kept ones
    take the edited name, type and required flag (toggles and pictures aside)."""
    owner = fields.where(~F.col("field_type").isin("boolean", "image")).select(
        "group_id", F.explode("node_ids").alias("node_id"), F.col("field_name").alias("f_name"),
        F.col("field_type").alias("f_type"), F.col("required").alias("f_required"),
    )
    j = classified.join(owner, ["group_id", "node_id"], "left")
    fielded = F.col("classification").isin(*V.NEEDS_FIELD)
    dropped = fielded & F.col("f_name").isNull()
    return j.select(*[
        {
            "classification": F.when(dropped, "FIXED").otherwise(F.col("classification")),
            "field_name": F.when(fielded, F.col("f_name")).otherwise(F.col("field_name")),
            "field_type": F.when(fielded & ~dropped, F.col("f_type")).otherwise(F.col("field_type")),
            "required": F.when(fielded & ~dropped, F.col("f_required")).otherwise(F.col("required")),
        }.get(c, F.col(c)).alias(c) for c in classified.columns
    ])
