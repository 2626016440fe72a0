"""Building documents and looking at their elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common as C
from formloom.operators import align as A
from formloom.operators import elements as E
from formloom.sources import text as S

BIG = "bigint"


def _els(spark, d):
    return E.explode_documents(C.forms(spark, d))


def _pages(spark, d):
    return E.explode_documents(C.page_documents(spark, d))


def form_elements(spark, d):
    return _els(spark, d).select(
        "group_id", "doc_id", F.col("doc_order").cast(BIG).alias("doc_order"), "node_id", "type", "text",
        F.coalesce(F.col("table_structure.n_rows"), F.lit(0)).cast(BIG).alias("n_rows"),
        F.md5(F.to_json("table_structure.rows")).alias("grid_md5"),
    )


def text_documents(spark, d):
    docs = S.documents_from_text(C.wide(spark, d, "documents"), group="lang", key="doc_id")
    return E.explode_documents(docs).groupBy("group_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )


def page_elements(spark, d):
    return _pages(spark, d).groupBy("doc_id").agg(
        F.count_if(F.col("type") == "heading").alias("headings"),
        F.count_if(F.col("type") == "list_item").alias("items"),
        F.max(F.when(F.col("type") == "heading", F.col("text"))).alias("title"),
    )


def duplicate_documents(spark, d):
    docs = S.documents_from_text(C.wide(spark, d, "documents"), group="lang", key="doc_id")
    return E.content_hash(docs).groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_seq").alias("first_doc")
    ).where("copies > 1")


def sectioned_forms(spark, d):
    out = E.nearest_heading(E.assign_sections(_els(spark, d)))
    return out.groupBy("section_key", "section_title", "under_heading").agg(F.count(F.lit(1)).alias("n_nodes"))


def form_neighbors(spark, d):
    out = E.neighbors(_els(spark, d).select("group_id", "doc_id", "doc_order", "node_id", "type"), 2)
    return out.where("type = 'table'").select("doc_id", F.array_join("neighbors", ",").alias("around"))


def line_batches(spark, d):
    li = C.table(spark, d, "lineitem")
    b = E.batch_ids(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 3)
    return b.groupBy("l_orderkey", F.col("batch_id").cast(BIG).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast(BIG)).alias("quantity")
    )


def largest_orders(spark, d):
    o = C.table(spark, d, "orders")
    return E.cap_per_group(o, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 24).select(
        "o_orderpriority", "o_orderkey", "o_totalprice"
    )


def form_preview(spark, d):
    blocks = E.preview_blocks(C.forms(spark, d)).select("doc_id", F.inline("blocks"))
    return blocks.groupBy("type").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum(F.coalesce(F.size("rows"), F.lit(0))).cast(BIG).alias("data_rows"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"),
    )


def form_content(spark, d):
    return E.document_content(C.forms(spark, d)).select(
        "doc_id", F.size("paragraphs").cast(BIG).alias("n_paragraphs"),
        F.md5(F.array_join("paragraphs", "\n")).alias("paragraphs_md5"),
        F.size(F.get("tables", F.lit(0))["rows"]).cast(BIG).alias("data_rows"),
    )


def form_outline(spark, d):
    return E.content_outline(C.forms(spark, d)).select("doc_id", F.md5("outline").alias("outline_md5"))


def form_source_blocks(spark, d):
    return E.source_blocks(C.forms(spark, d)).groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )


def form_layouts(spark, d):
    lo = A.layouts_of(A.with_layout(C.forms(spark, d)))
    return lo.select("group_id", F.size("sigs").cast(BIG).alias("n_nodes"), "n_docs", "first_seq",
                     F.array_join("sigs", ";").alias("signature"))


def form_representatives(spark, d):
    return A.pick_representative(C.forms(spark, d)).select("group_id", "rep_seq", "n_documents")


def page_alignment(spark, d):
    """Every page against its language's representative (alignment by layout)."""
    laid = A.with_layout(C.page_documents(spark, d))
    layouts = A.layouts_of(laid)
    al = A.align_to(laid, A.representatives(layouts), layouts)
    return al.select("group_id", "doc_id", F.size("pairs").cast(BIG).alias("rep_nodes"),
                     F.size(F.filter("pairs", lambda p: p >= 0)).cast(BIG).alias("aligned"))


QUERIES = {
    f.__name__: f
    for f in (
        form_elements, text_documents, page_elements, duplicate_documents, sectioned_forms, form_neighbors,
        line_batches, largest_orders, form_preview, form_content, form_outline, form_source_blocks,
        form_layouts, form_representatives, page_alignment,
    )
}

_H = f"list_transform(cells, lambda r: '[\"' || array_to_string(r, '\",\"') || '\"]')"
_GRID = "'[' || array_to_string(list_concat(['[\"Part\",\"Quantity\",\"Price\"]'], coalesce(" + _H + ", [])), ',') || ']'"
_CELL = "coalesce(list_transform(cells, lambda r: array_to_string(r, ' | ')), [])"

ORACLES = {
    "form_elements": f"""WITH {C.FORMS_SQL} SELECT group_id, doc_id, doc_order::BIGINT AS doc_order, node_id, type, text,
        CASE WHEN type = 'table' THEN n_lines + 1 ELSE 0 END AS n_rows,
        CASE WHEN type = 'table' THEN md5({_GRID}) END AS grid_md5 FROM els""",
    "text_documents": f"""WITH {C.LINES_SQL}, t AS (SELECT lang AS group_id, line,
        CASE WHEN upper(line) = line AND lower(line) <> line AND length(line) > 2 AND length(line) < 80 THEN 'heading'
             WHEN regexp_matches(line, '^(?:[-*•]|[0-9]+[.)])\\s') THEN 'list_item' ELSE 'paragraph' END AS type FROM lines)
        SELECT group_id, type, count(*) AS n, sum(length(line))::BIGINT AS chars FROM t GROUP BY ALL""",
    "page_elements": r"""WITH v AS (SELECT page_id, regexp_replace(html, '<!--[\s\S]*?-->|<script[\s\S]*?</script>|<style[\s\S]*?</style>|<title[\s\S]*?</title>', '', 'g') AS h FROM pages),
        b AS (SELECT page_id, regexp_extract(h, '<h1>([\s\S]*?)</h1>', 1) AS t,
              len(regexp_extract_all(h, '<h[1-6]>')) AS headings, list_filter(regexp_extract_all(h, '<li>[\s\S]*?</li>'), lambda x: length(regexp_replace(x, '<[^>]*>', '', 'g')) > 0) AS lis FROM v)
        SELECT page_id::VARCHAR AS doc_id, headings::BIGINT AS headings, len(lis)::BIGINT AS items,
          trim(regexp_replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title
        FROM b""",
    "duplicate_documents": f"""WITH {C.LINES_SQL}, t AS (SELECT doc_id, pos, line,
        CASE WHEN upper(line) = line AND lower(line) <> line AND length(line) > 2 AND length(line) < 80 THEN 'heading'
             WHEN regexp_matches(line, '^(?:[-*•]|[0-9]+[.)])\\s') THEN 'list_item' ELSE 'paragraph' END AS type FROM lines),
        h AS (SELECT d.doc_id, sha256(coalesce(string_agg(type || ':' || line || chr(10), '' ORDER BY pos), '')) AS content_hash
              FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id)
        SELECT content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM h GROUP BY content_hash HAVING count(*) > 1""",
    "sectioned_forms": f"""WITH {C.FORMS_SQL}, w AS (SELECT *,
        last_value(CASE WHEN type = 'heading' THEN node_id END IGNORE NULLS) OVER o AS k,
        last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER o AS t,
        last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY doc_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u
        FROM els WINDOW o AS (PARTITION BY doc_id ORDER BY doc_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT coalesce(k, 'preamble') AS section_key, coalesce(t, 'Preamble') AS section_title, coalesce(u, '') AS under_heading, count(*) AS n_nodes FROM w GROUP BY ALL""",
    "form_neighbors": """SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN o_totalprice > 400000 THEN 'n0006,n0007,n0008,n0009,n0010' ELSE 'n0005,n0006,n0007,n0008,n0009' END AS around FROM orders JOIN customer ON o_custkey = c_custkey""",
    "line_batches": """WITH b AS (SELECT l_orderkey, l_quantity, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 3 AS batch_id FROM lineitem)
        SELECT l_orderkey, batch_id, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM b GROUP BY ALL""",
    "largest_orders": """SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 24""",
    "form_preview": f"""WITH {C.FORMS_SQL} SELECT type, count(*) AS n_blocks, sum(CASE WHEN type = 'table' THEN n_lines ELSE 0 END)::BIGINT AS data_rows, sum(length(text))::BIGINT AS chars
        FROM els GROUP BY type""",
    "form_content": f"""WITH {C.FORMS_SQL} SELECT doc_id, count(*) FILTER (type <> 'table') AS n_paragraphs,
        md5(string_agg(text, chr(10) ORDER BY doc_order) FILTER (type <> 'table')) AS paragraphs_md5, max(n_lines) AS data_rows FROM els GROUP BY doc_id""",
    "form_outline": f"""WITH {C.FORMS_SQL}, l AS (SELECT doc_id, doc_order, CASE WHEN type = 'table' THEN 'TABLE: Part | Quantity | Price' || array_to_string(list_transform({_CELL}, lambda c: chr(10) || '  ' || c), '')
        WHEN type = 'heading' THEN chr(10) || '# ' || text ELSE text END AS line FROM els)
        SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY doc_order)) AS outline_md5 FROM l GROUP BY doc_id""",
    "form_source_blocks": f"""WITH {C.FORMS_SQL} SELECT 'b' || doc_order AS block_id, count(*) AS n, sum(length(
        CASE WHEN type = 'table' THEN array_to_string(list_concat(['Part | Quantity | Price', 'Part | Quantity | Price'], {_CELL}), chr(10)) ELSE text END))::BIGINT AS chars FROM els GROUP BY ALL""",
    "form_layouts": """SELECT o_orderpriority AS group_id, CASE WHEN o_totalprice > 400000 THEN 11 ELSE 10 END::BIGINT AS n_nodes, count(*) AS n_docs, min(o_orderkey) AS first_seq,
        'p:normal:1;p:order number;p:customer name;p:order date;p:status;' || CASE WHEN o_totalprice > 400000 THEN 'p:normal:2;' ELSE '' END
        || 'h:line items;t:part|quantity|price;p:total due;h:terms;p:normal:3' AS signature
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "form_representatives": """SELECT o_orderpriority AS group_id, min(o_orderkey) FILTER (o_totalprice > 400000) AS rep_seq, count(*) AS n_documents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
}
