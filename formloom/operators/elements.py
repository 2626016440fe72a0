"""Documents and their elements: building, reshaping, views.

Two shapes of the same data:

* *documents* - one row per document, ``elements ARRAY<STRUCT>`` in walk order.
  A document is bounded (uploads are limited to 25 MB), so everything that stays
  inside one document is a narrow expression with no shuffle.
* *elements*  - the exploded form, one row per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom import vocabulary as V
from formloom.functions import text as X
from formloom.schemas import ELEMENT_COLUMNS, ELEMENT_TYPE

DOC_KEYS = ("group_id", "doc_id", "doc_seq")


# -- building ----------------------------------------------------------------
def element(**given: Column) -> Column:
    """One element struct in canonical column order; what is not given is null."""
    unknown = set(given) - set(ELEMENT_COLUMNS)
    if unknown:
        raise ValueError(f"not element columns: {sorted(unknown)}")
    return F.struct(
        *[
            given.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in ELEMENT_COLUMNS.items()
        ]
    )


def table_structure(headers: Column, data_rows: Column) -> Column:
    """Table grid from a header row and the data rows under it."""
    rows = F.concat(F.array(headers), F.coalesce(data_rows, F.array().cast("array<array<string>>")))
    return F.struct(
        F.size(rows).alias("n_rows"),
        F.size(headers).alias("n_cols"),
        headers.alias("headers"),
        rows.alias("rows"),
        F.array().cast("array<struct<row:int,col:int,rowspan:int,colspan:int>>").alias("merged_cells"),
        F.array_repeat(F.lit(None).cast("int"), F.size(headers)).alias("col_widths"),
    )


def numbered(parts: Column) -> Column:
    """Give the elements of an array their walk order, position and node id."""
    def place(e: Column, i: Column) -> Column:
        nid = F.coalesce(
            e["node_id"], F.concat(F.lit("n"), F.lpad((i + 1).cast("string"), 4, "0"))
        )
        return (
            e.withField("doc_order", i.cast("int"))
            .withField("position_index", F.coalesce(e["position_index"], i.cast("int")))
            .withField("node_id", nid)
        )

    return F.transform(parts, place)


# -- reshaping ---------------------------------------------------------------
def explode_documents(documents: DataFrame) -> DataFrame:
    """documents -> elements."""
    return documents.select(*DOC_KEYS, F.inline("elements"))


def nest_elements(elements: DataFrame) -> DataFrame:
    """elements -> documents (one shuffle, keyed by document)."""
    have = set(elements.columns)
    packed = element(**{c: F.col(c) for c in ELEMENT_COLUMNS if c in have})
    keyed = elements.withColumn("doc_seq", F.col("doc_seq") if "doc_seq" in have else F.lit(0).cast("bigint"))
    return keyed.groupBy(*DOC_KEYS).agg(F.array_sort(F.collect_list(packed)).alias("elements"))


# -- predicates and filters ---------------------------------------------------
def top_level(elements: DataFrame) -> DataFrame:
    """Nodes no table owns (headers and footers included)."""
    return elements.where(F.col("parent_node_id").isNull())


def top_elements(elements: Column) -> Column:
    """The same on an element array."""
    return F.filter(elements, lambda e: e["parent_node_id"].isNull())


def body(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("header_footer_scope").isNull())


def owned_by(df: DataFrame, owner_id: str) -> DataFrame:
    """Rows of one owner; a foreign row is treated as missing."""
    return df.where(F.col("owner_id") == owner_id)


def owned_children(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is visible (parents already owner-filtered)."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def is_picture() -> Column:
    return (F.col("type") == "image") | F.col("image_ref").isNotNull()


def drop_empty_layout(elements: DataFrame) -> DataFrame:
    """Without the spacing: nodes that hold neither text, table nor picture."""
    return elements.where(~(X.is_blank("text") & (F.col("type") != "table") & ~is_picture()))


def is_exempt() -> Column:
    """Keeps its class in full-template mode: a wordless picture or a blank."""
    return X.is_blank("text") & (is_picture() | (F.col("type") != "table"))


def is_structural_label() -> Column:
    """A short label that is furniture ("TABLE OF CONTENTS"), not content."""
    t = F.coalesce(X.one_line("text"), F.lit(""))
    style = F.lower(F.coalesce(F.col("style_name"), F.lit("")))
    known = F.lower(F.btrim(t, F.lit(":"))).isin(*V.STRUCTURAL_LABELS)
    styled = X.contains_any(style, V.STRUCTURAL_STYLE_HINTS) & (F.size(F.split(t, " ")) <= 3)
    return (t != "") & (F.length(t) <= 24) & (known | styled)


def is_generated_listing() -> Column:
    """A paragraph the word processor writes itself (contents entry, index)."""
    style = F.lower(F.coalesce(F.col("style_name"), F.lit("")))
    hints = F.coalesce(F.col("semantic_hints"), F.array().cast("array<string>"))
    return (
        F.when(X.starts_with_any(style, V.GENERATED_STYLES), True)
        .when(style.startswith("caption"), False)
        .otherwise(F.array_contains(hints, "toc") | F.array_contains(hints, "auto_field"))
    )


def looks_like_data_table(ts: Column) -> Column:
    """Rows of one kind (several headers, or enough rows), not page layout."""
    headers = F.array_distinct(F.filter(F.transform(ts["headers"], X.strip), lambda h: h != ""))
    return F.coalesce(
        (ts["n_rows"] >= 2)
        & (ts["n_cols"] >= 2)
        & ((F.size(headers) >= 2) | (ts["n_rows"] - 1 >= 2)),
        F.lit(False),
    )


def with_hints(elements: DataFrame) -> DataFrame:
    """Fill ``semantic_hints`` where the source left it null."""
    derived = F.when(F.col("type") == "table", F.array(F.lit("table"))).otherwise(
        F.concat(
            X.semantic_hints("text"),
            F.when(F.col("image_ref").isNotNull(), F.array(F.lit("image"))).otherwise(
                F.array().cast("array<string>")
            ),
        )
    )
    return elements.withColumn("semantic_hints", F.coalesce(F.col("semantic_hints"), derived))


# -- windows inside one document ----------------------------------------------
def _in_order() -> Window:
    return Window.partitionBy("group_id", "doc_id").orderBy("doc_order")


def assign_sections(elements: DataFrame) -> DataFrame:
    """``section_key``/``section_title``: the last heading at or before a node."""
    heading = F.when(
        F.col("type") == "heading",
        F.struct(
            F.col("node_id").alias("key"),
            F.coalesce(F.nullif(X.strip("text"), F.lit("")), F.lit("Section")).alias("title"),
        ),
    )
    open_section = F.last(heading, ignorenulls=True).over(
        _in_order().rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        elements.withColumn("_open", open_section)
        .withColumn("section_key", F.coalesce(F.col("_open.key"), F.lit("preamble")))
        .withColumn("section_title", F.coalesce(F.col("_open.title"), F.lit("Preamble")))
        .drop("_open")
    )


def nearest_heading(elements: DataFrame) -> DataFrame:
    """``under_heading``: last non-blank heading strictly before a node."""
    heading = F.when((F.col("type") == "heading") & ~X.is_blank("text"), X.strip("text"))
    above = F.last(heading, ignorenulls=True).over(
        _in_order().rowsBetween(Window.unboundedPreceding, -1)
    )
    return elements.withColumn("under_heading", F.coalesce(above, F.lit("")))


def neighbors(elements: DataFrame, radius: int = 2) -> DataFrame:
    """``neighbors``: node ids within ``radius`` (1..6) around each node, itself included."""
    r = max(1, min(6, radius))
    around = F.collect_list("node_id").over(_in_order().rowsBetween(-r, r))
    return elements.withColumn("neighbors", around)


def batch_ids(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """``batch_id``: fixed-size batches in order, per key."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("batch_id", F.floor((rn - 1) / size).cast("int"))


def cap_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per key.  The limit is applied map-side before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


# -- views -------------------------------------------------------------------
def element_review_view(elements: DataFrame, classifications: DataFrame) -> DataFrame:
    """Body top-level elements beside their class, text cut for display."""
    cls = classifications.select(
        "group_id", "node_id", "classification", "field_name", "field_type", "confidence"
    )
    return (
        top_level(body(elements))
        .join(cls, ["group_id", "node_id"], "left")
        .select(
            "group_id", "doc_id", "doc_order", "node_id", "type",
            F.substring("text", 1, 400).alias("text"),
            F.coalesce("classification", F.lit("FIXED")).alias("classification"),
            "field_name", "field_type", "confidence",
            F.col("table_structure.headers").alias("headers"),
        )
    )


def preview_blocks(documents: DataFrame) -> DataFrame:
    """``blocks``: tables, headings and paragraphs in order, blanks dropped."""
    def keep(e: Column) -> Column:
        return (e["type"] == "table") | ~X.is_blank(e["text"])

    def block(e: Column) -> Column:
        ts = e["table_structure"]
        table = (e["type"] == "table") & ts.isNotNull()
        return F.struct(
            F.when(table, "table").when(e["type"] == "heading", "heading").otherwise("paragraph").alias("type"),
            F.when(~table, e["text"]).alias("text"),
            F.when(table, ts["headers"]).alias("headers"),
            F.when(table, F.slice(ts["rows"], 2, F.greatest(F.size(ts["rows"]), F.lit(1)))).alias("rows"),
        )

    return documents.select(
        *DOC_KEYS, F.transform(F.filter(top_elements(F.col("elements")), keep), block).alias("blocks")
    )


def document_content(documents: DataFrame) -> DataFrame:
    """``paragraphs`` (texts) and ``tables`` (headers + data rows) of a document."""
    tops = top_elements(F.col("elements"))

    def is_table(e: Column) -> Column:
        return (e["type"] == "table") & e["table_structure"].isNotNull()

    def table(e: Column) -> Column:
        ts = e["table_structure"]
        return F.struct(
            ts["headers"].alias("headers"),
            F.slice(ts["rows"], 2, F.greatest(F.size(ts["rows"]), F.lit(1))).alias("rows"),
        )

    return documents.select(
        *DOC_KEYS,
        F.transform(
            F.filter(tops, lambda e: ~is_table(e) & ~X.is_blank(e["text"])), lambda e: X.strip(e["text"])
        ).alias("paragraphs"),
        F.transform(F.filter(tops, is_table), table).alias("tables"),
    )


def content_outline(documents: DataFrame, max_chars: int = 600) -> DataFrame:
    """``outline``: the document as indented lines that keep its shape."""
    def line(e: Column, i: Column) -> Column:
        ts = e["table_structure"]
        t = X.stripped(e["text"])
        shown = F.when(
            F.length(t) > max_chars,
            F.concat(
                X.rstrip(F.substring(t, 1, max_chars)),
                F.lit("… [truncated — get_source_block b"), i.cast("string"), F.lit("]"),
            ),
        ).otherwise(t)
        level = F.when(e["subtype"].rlike("^[0-9]+$"), e["subtype"]).otherwise("1").cast("int")
        table = F.concat(
            F.lit("TABLE: "), F.array_join(ts["headers"], " | "),
            F.array_join(
                F.transform(
                    F.slice(ts["rows"], 2, F.greatest(F.size(ts["rows"]), F.lit(1))),
                    lambda r: F.concat(F.lit("\n  "), F.array_join(r, " | ")),
                ), "",
            ),
        )
        depth = F.coalesce(e["numbering_info"]["level"], F.lit(0))
        marker = F.when(e["subtype"] == "ordered", "1.").otherwise("-")
        return (
            F.when((e["type"] == "table") & ts.isNotNull(), table)
            .when(t == "", None)
            .when(
                e["type"] == "heading",
                F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.least(level, F.lit(6))), F.lit(" "), shown),
            )
            .when(
                e["type"] == "list_item",
                F.concat(F.repeat(F.lit("  "), depth), marker, F.lit(" "), shown),
            )
            .otherwise(shown)
        )

    rendered = F.transform(top_elements(F.col("elements")), line)
    return documents.select(
        *DOC_KEYS, X.strip(F.array_join(F.array_compact(rendered), "\n")).alias("outline")
    )


def source_blocks(documents: DataFrame) -> DataFrame:
    """Untruncated text behind each outline entry, keyed by its block id."""
    tops = documents.select(*DOC_KEYS, F.posexplode(top_elements(F.col("elements"))).alias("i", "e"))
    ts = F.col("e.table_structure")
    grid = F.array_join(
        F.concat(
            F.array(F.array_join(ts["headers"], " | ")),
            F.transform(ts["rows"], lambda r: F.array_join(r, " | ")),
        ), "\n",
    )
    body_text = F.when((F.col("e.type") == "table") & ts.isNotNull(), grid).otherwise(
        F.nullif(X.strip("e.text"), F.lit(""))
    )
    return tops.select(
        *DOC_KEYS, F.concat(F.lit("b"), F.col("i").cast("string")).alias("block_id"), body_text.alias("text")
    ).where(F.col("text").isNotNull())


def hash_of(elements: Column) -> Column:
    """SHA-256 over the ``type:text`` lines of an element array in walk order."""
    joined = F.array_join(
        F.transform(
            elements,
            lambda e: F.concat(e["type"], F.lit(":"), F.coalesce(e["text"], F.lit("")), F.lit("\n")),
        ), "",
    )
    return F.sha2(joined, 256)


def content_hash(documents: DataFrame) -> DataFrame:
    """``content_hash`` of each document; equal hashes are duplicate uploads."""
    return documents.select(*DOC_KEYS, hash_of(F.col("elements")).alias("content_hash"))
