"""Templates as block rows, and documents rendered from them.

A template block is ``prefix + field + suffix`` with an optional loop and
condition; rendering joins blocks with the requests' values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom import vocabulary as V
from formloom.functions import richtext as R
from formloom.functions import text as X
from formloom.functions import values as N
from formloom.operators.records import nested_in_looped_table

ROWS = "array<map<string,string>>"
PROSE_TYPES = ("text", "multiline_text")


# -- template side -----------------------------------------------------------------
def block_pairs(classified: DataFrame, elements: DataFrame) -> DataFrame:
    """Repeated heading+body groups: first paragraph the title, second the body,
    the rest dropped; a group of one is no group."""
    rows = classified.where(F.col("classification") == "REPEATABLE_BLOCK").join(
        elements.where((F.col("type") != "table") & F.col("header_footer_scope").isNull()).select("group_id", "doc_id", "node_id"),
        ["group_id", "doc_id", "node_id"]).where(X.safe_ident("field_name").isNotNull())
    w = Window.partitionBy("group_id", "doc_id", "field_name")
    out = rows.withColumn("at", F.row_number().over(w.orderBy("doc_order"))).withColumn("n", F.count(F.lit(1)).over(w))
    return out.where(F.col("n") >= 2).select(
        "group_id", "doc_id", "node_id", "field_name",
        F.when(F.col("at") == 1, "title").when(F.col("at") == 2, "body").otherwise("dropped").alias("role"))


def section_spans(elements: DataFrame, fields: DataFrame, sections: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """``(section_key, toggle, first_order, last_order)``: from a section's
    earliest body field (or the heading right above) to just before the next
    section.  Spans that do not start and end on plain paragraphs are left out;
    a span cutting a looped group is too (``loops``: first and last order of
    each group)."""
    keys = ["group_id", "doc_id"]
    bodies = elements.where(F.col("parent_node_id").isNull() & F.col("header_footer_scope").isNull()).select(
        *keys, "node_id", "doc_order", "type", F.lower(F.coalesce("style_name", F.lit(""))).alias("style"))
    order = Window.partitionBy(*keys).orderBy("doc_order")
    above = F.lag(F.struct("doc_order", (X.starts_with_any(F.col("style"), ("heading", "title")) & (F.col("type") != "table")).alias("head"))).over(order)
    bodies = bodies.withColumn("above", above)
    members = fields.where(F.col("section_key").isNotNull()).select(*keys, "section_key", F.explode("node_ids").alias("node_id")).join(
        sections.select(*keys, "section_key"), [*keys, "section_key"], "left_semi")
    starts = members.join(bodies, [*keys, "node_id"]).groupBy(*keys, "section_key").agg(
        F.min_by(F.struct("doc_order", "above"), "doc_order").alias("f"))
    first = F.when(F.coalesce(F.col("f.above.head"), F.lit(False)), F.col("f.above.doc_order")).otherwise(F.col("f.doc_order"))
    starts = starts.select(*keys, "section_key", first.alias("first_order"), X.section_toggle_name("section_key").alias("toggle"))
    ends = bodies.groupBy(*keys).agg(F.max("doc_order").alias("doc_end"))
    nxt = F.lead("first_order").over(Window.partitionBy(*keys).orderBy("first_order", "section_key"))
    spans = starts.withColumn("next_first", nxt).join(ends, keys)
    inside = spans.join(bodies.select(*keys, "doc_order", "type"), keys).where(
        (F.col("doc_order") >= F.col("first_order")) & (F.col("doc_order") < F.coalesce("next_first", F.col("doc_end") + 1)))
    bounded = inside.groupBy(*keys, "section_key", "toggle").agg(
        F.min("doc_order").alias("first_order"), F.max("doc_order").alias("last_order"),
        F.min_by("type", "doc_order").alias("t0"), F.max_by("type", "doc_order").alias("t1")
    ).where(F.col("toggle").isNotNull() & (F.col("t0") != "table") & (F.col("t1") != "table")).drop("t0", "t1")
    if loops is None:
        return bounded
    cut = bounded.join(loops, keys).where(
        ((F.col("loop_first") < F.col("first_order")) & (F.col("loop_last") >= F.col("first_order"))))
    return bounded.join(cut.select(*keys, "section_key").distinct(), [*keys, "section_key"], "left_anti")


def template_blocks(elements: DataFrame, classified: DataFrame, fields: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows of a template in order: ``group_id, block_order, node_id, type, text,
    field_name, prefix, suffix, loop, columns, headers, condition, hide_empty,
    toggle``.  ``loop`` is null, ``row``, ``paragraph`` or ``block``."""
    keys = ["group_id", "doc_id"]
    owner = fields.where(~F.col("field_type").isin("boolean", "image")).select(
        *keys, F.explode("node_ids").alias("node_id"), F.col("field_name").alias("f_name"), "columns")
    cls = classified.select(*keys, "node_id", "classification", F.col("field_name").alias("c_name"), "static_prefix", "static_suffix", "optional", "rationale")
    el = elements.select(*keys, "node_id", "parent_node_id", "doc_order", "type", "text", "image_ref", "header_footer_scope",
                         F.col("table_structure.headers").alias("headers"), F.col("table_structure.n_rows").alias("n_rows"))
    j = el.join(cls, [*keys, "node_id"], "left").join(owner, [*keys, "node_id"], "left").join(
        nested_in_looped_table(elements, classified), [*keys, "node_id"], "left_anti").where(
        F.col("parent_node_id").isNull() | F.col("c_name").isNotNull())
    pairs = block_pairs(classified, elements).select(*keys, "node_id", "role")
    j = j.join(pairs, [*keys, "node_id"], "left").where(F.coalesce("role", F.lit("")) != "dropped")
    name = X.safe_ident(F.coalesce("f_name", "c_name"))
    c = F.col("classification")
    is_table = F.col("type") == "table"
    wordless = F.col("image_ref").isNotNull() & X.is_blank("text")
    loop = (
        F.when(F.col("role").isNotNull(), "block").when((c == "REPEATABLE_TABLE") & is_table & name.isNotNull(), "row")
        .when((c == "REPEATABLE_SECTION") & ~is_table & name.isNotNull(), "paragraph"))
    single = c.isin(*V.DYNAMIC) & ~is_table & ~wordless & name.isNotNull()
    j = j.withColumn("loop", loop).withColumn("single", single).withColumn("name", F.when(loop.isNotNull() | single, name))
    # Later nodes of a grouped section are example prose of the same list.
    nth = F.row_number().over(Window.partitionBy(*keys, "name", "loop").orderBy("doc_order"))
    j = j.withColumn("nth", F.when(F.col("loop") == "paragraph", nth).otherwise(1)).where(F.col("nth") == 1)
    loops = j.where(F.col("loop") == "block").groupBy(*keys, "name").agg(F.min("doc_order").alias("loop_first"), F.max("doc_order").alias("loop_last")).drop("name")
    spans = section_spans(elements, fields, sections, loops).select(*keys, "toggle", "first_order", "last_order")
    out = j.join(spans, (j.group_id == spans.group_id) & (j.doc_id == spans.doc_id) & (j.doc_order >= spans.first_order) & (j.doc_order <= spans.last_order), "left")
    keep_text = F.when(F.col("name").isNull(), X.neutralize_markers(F.coalesce("text", F.lit(""))))
    tagged = F.coalesce("rationale", F.lit("")).contains(V.TAGS_ONLY_MARK) & F.col("image_ref").isNull()
    return out.select(
        j.group_id, j.doc_order.alias("block_order"), "node_id", "type", keep_text.alias("text"), F.col("name").alias("field_name"),
        F.when(F.col("single"), F.coalesce("static_prefix", F.lit(""))).otherwise("").alias("prefix"),
        F.when(F.col("single"), F.coalesce("static_suffix", F.lit(""))).otherwise("").alias("suffix"),
        "loop", F.transform("columns", lambda x: x["field_name"]).alias("columns"), "headers", "n_rows", "role",
        F.when(F.coalesce("optional", F.lit(False)), X.safe_ident(X.include_field_name("c_name", "text"))).alias("condition"),
        (F.col("single") & tagged).alias("hide_empty"), "toggle")


# -- request side ------------------------------------------------------------------
def sample_context(fields: DataFrame) -> DataFrame:
    """«Label» placeholders for every field of every template."""
    mark = F.concat(F.lit("«"), F.col("label"), F.lit("»"))
    cells = F.map_from_entries(F.transform("columns", lambda c: F.struct(c["field_name"], F.concat(F.lit("«"), c["label"], F.lit("»")))))
    return fields.select(
        "template_id", "field_name",
        F.when(F.col("field_type") == "boolean", "true").when(F.col("field_type").isin("table", "image"), None).otherwise(mark).alias("value"),
        F.when(F.col("field_type") == "table", F.array(cells)).alias("rows"))


def section_toggles(requests: DataFrame, fields: DataFrame, skipped: DataFrame) -> DataFrame:
    """``(request_id, toggle, shown)``: every section is on unless explicitly
    skipped; an empty field never hides one."""
    keys = fields.where(F.coalesce("section_key", F.lit("")) != "").select("template_id", "section_key").distinct()
    due = requests.select("request_id", "template_id").distinct().join(keys, "template_id")
    off = skipped.select("request_id", "section_key", F.lit(True).alias("off")).distinct()
    return due.join(off, ["request_id", "section_key"], "left").select(
        "request_id", X.section_toggle_name("section_key").alias("toggle"), F.col("off").isNull().alias("shown")
    ).where(F.col("toggle").isNotNull())


def skipped_sections(writer: DataFrame, context: DataFrame) -> DataFrame:
    """Sections the writer or the caller skipped."""
    return writer.select("request_id", "section_key").union(context.select("request_id", "section_key")).where(
        F.coalesce("section_key", F.lit("")) != "").distinct()


def build_render_context(requests: DataFrame, fields: DataFrame, context: DataFrame) -> DataFrame:
    """Every field of every request with a render-safe value (``value``, ``rows``
    or ``items``); extra keys pass through."""
    due = requests.select("request_id", "template_id").distinct().join(
        fields.select("template_id", "field_name", "field_type", "classification", "default", "columns"), "template_id")
    j = due.join(context.select("request_id", "field_name", "value", "rows"), ["request_id", "field_name"], "full_outer")
    kind, given = F.col("field_type"), F.col("value")
    filled = F.coalesce(F.nullif(given, F.lit("")), F.nullif("default", F.lit("")), F.lit(""))
    section = F.col("classification") == "REPEATABLE_SECTION"
    value = (
        F.when(kind.isNull(), given).when(kind == "image", given).when(kind == "table", None)
        .when(kind == "boolean", N.coerce_bool(F.coalesce(given, F.col("default"))).cast("string")).when(section, None).otherwise(filled))
    names = F.transform("columns", lambda c: c["field_name"])
    return j.select(
        "request_id", "field_name", "field_type", "classification", value.alias("value"),
        F.when(kind == "table", N.coerce_rows(F.col("rows"), names)).when(kind.isNull(), F.col("rows")).alias("rows"),
        F.when(section, N.coerce_str_list(given)).alias("items"))


def expand_rich(context: DataFrame) -> DataFrame:
    """``blocks`` for prose values that carry structure; one plain paragraph
    collapses to its text.  Sections and other types stay as they are."""
    prose = F.col("field_type").isin(*PROSE_TYPES) & (F.coalesce("classification", F.lit("")) != "REPEATABLE_SECTION") & R.is_rich("value")
    step = context.withColumn("_blocks", F.when(prose, R.blocks("value")))
    only = F.get("_blocks", F.lit(0))
    plain = (F.size("_blocks") == 1) & (only["kind"] == "paragraph") & ~only["text"].rlike(R.EMPHASIS)
    empty = F.size("_blocks") == 0
    return step.withColumn(
        "value", F.when(F.col("_blocks").isNotNull() & empty, "").when(F.col("_blocks").isNotNull() & plain, only["text"]).otherwise(F.col("value"))
    ).withColumn("blocks", F.when(F.col("_blocks").isNotNull() & ~empty & ~plain, F.col("_blocks"))).drop("_blocks")


def render_documents(blocks: DataFrame, context: DataFrame, requests: DataFrame, toggles: DataFrame | None = None) -> DataFrame:
    """One row per rendered block: ``request_id, block_order, part, type, text,
    cells``.  A false condition drops its block; a missing value renders empty;
    a missing toggle shows its section."""
    repeats = blocks.where("loop = 'block'").groupBy("group_id", "field_name").agg(
        F.min("block_order").alias("group_first"), (F.max("block_order") - F.min("block_order") + 1).cast("bigint").alias("group_width"))
    placed = blocks.join(repeats, ["group_id", "field_name"], "left")  # a few rows for each template
    per_request = requests.select("request_id", "template_id").distinct().join(
        placed.withColumnRenamed("group_id", "template_id"), "template_id")
    values = context.select("request_id", "field_name", "value", "rows", "items", "blocks")
    flags = context.where(F.col("field_type") == "boolean").select("request_id", F.col("field_name").alias("condition"), F.col("value").alias("on"))
    j = per_request.join(values, ["request_id", "field_name"], "left").join(flags, ["request_id", "condition"], "left")
    if toggles is not None:
        j = j.join(toggles, ["request_id", "toggle"], "left").where(F.coalesce("shown", F.lit(True)))
    j = j.where(F.col("condition").isNull() | (F.col("on") == "true")).where(
        ~F.col("hide_empty") | (F.coalesce("value", F.lit("")) != ""))
    cell = lambda r: F.transform("columns", lambda c: F.coalesce(F.try_element_at(r, c), F.lit("")))
    header = F.when(F.coalesce("n_rows", F.lit(2)) > 1, F.array(F.col("headers"))).otherwise(F.array().cast("array<array<string>>"))
    grid = F.concat(header, F.coalesce(F.transform("rows", cell), F.array().cast("array<array<string>>")))
    def part(kind, text, cells=None, item=None):
        return F.struct(kind.alias("type"), text.cast("string").alias("text"), (cells if cells is not None else F.lit(None)).cast("array<array<string>>").alias("cells"),
                        (item if item is not None else F.lit(0)).cast("int").alias("item"))
    kind = F.col("type")
    rich = F.transform("blocks", lambda b: part(F.concat(F.lit("rich_"), b["kind"]), R.without_emphasis(b["text"])))
    role = F.col("role")

    def repeated(row: Column, item: Column) -> Column:
        """One role of one item; a rich body gives several parts."""
        value = F.coalesce(F.try_element_at(row, role), F.lit(""))
        rich_parts = F.transform(R.blocks(value), lambda b: part(F.concat(F.lit("rich_"), b["kind"]), R.without_emphasis(b["text"]), item=item))
        return F.when((role == "body") & R.is_rich(value), rich_parts).otherwise(F.array(part(kind, value, item=item)))

    parts = (
        F.when(F.col("loop") == "row", F.array(part(F.lit("table"), F.lit(""), grid)))
        .when(F.col("loop") == "paragraph", F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda t: part(kind, t)))
        .when(F.col("loop") == "block", F.flatten(F.transform(F.coalesce("rows", F.array().cast(ROWS)), repeated)))
        .when(F.col("field_name").isNotNull() & F.col("blocks").isNotNull(), rich)
        .when(F.col("field_name").isNotNull(), F.array(part(kind, F.concat("prefix", F.coalesce("value", F.lit("")), "suffix"))))
        .otherwise(F.array(part(kind, F.coalesce("text", F.lit("")))))
    )
    # The blocks of a repeated group stand at its first block and alternate item by
    # item, so their parts are numbered by (item, block, position): in order, with gaps.
    alternate = F.col("loop").eqNullSafe("block")
    group_first = F.when(alternate, F.col("group_first"))
    number = F.when(alternate, (F.col("p.item") * F.col("group_width") + F.col("block_order") - F.col("group_first")) * F.lit(1 << 20) + F.col("nth"))
    return j.select("request_id", "block_order", "loop", "group_first", "group_width", F.posexplode(parts).alias("nth", "p")).select(
        "request_id", F.coalesce(group_first, "block_order").alias("block_order"),
        F.coalesce(number, "nth").cast("bigint").alias("part"), "p.type", "p.text", "p.cells")


def rendered_text(rendered: DataFrame) -> DataFrame:
    """A rendered document as one text (tables row by row)."""
    grid = F.array_join(F.transform("cells", lambda r: F.array_join(r, " | ")), "\n")
    line = F.struct("block_order", "part", F.coalesce(grid, "text").alias("t"))
    return rendered.groupBy("request_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"))
