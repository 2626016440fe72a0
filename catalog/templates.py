"""Comparing documents and deriving templates: diff, classes, fields, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common as C
from formloom.operators import classify as K
from formloom.operators import diff as D
from formloom.operators import elements as E
from formloom.operators import fields as FD
from formloom.operators import naming as N
from formloom.operators import tagging as TG
from formloom.plans import analyze as P
from formloom.sources import text as S

BIG = "bigint"


def form_diff(spark, d):
    """Every order form against its priority group's representative."""
    r = D.diff_corpus(C.staged_forms(spark, d))
    return r.select(
        "group_id", "node_id", "type", "status", "n_documents", "n_present", "is_optional", "is_constant", "confidence",
        "static_prefix", "static_suffix", "detected_kind", "n_distinct", "header_identical", "row_count_variable",
        F.col("min_rows").cast(BIG).alias("min_rows"), F.col("max_rows").cast(BIG).alias("max_rows"), "notes",
        F.get("sample_texts", F.lit(0)).alias("first_sample"), F.get("variable_parts", F.lit(0)).alias("first_part"),
    )


def form_node_values(spark, d):
    """All texts, variable parts and picture hashes of every form node."""
    r = D.corpus_values(C.staged_forms(spark, d))
    return r.select("group_id", "ri", "node_id", "type", "status", "text", "variable_part", "image_hash", "n_docs", "in_representative")


def form_row_counts(spark, d):
    r = D.corpus_row_counts(C.staged_forms(spark, d))
    return r.select("group_id", "ri", F.col("n_rows").cast(BIG).alias("n_rows"), "n_docs")


def form_diff_summary(spark, d):
    s = D.diff_summary(D.diff_corpus(C.staged_forms(spark, d)))
    return s.select("group_id", F.explode("summary").alias("status", "n_nodes"))


def page_diff(spark, d):
    r = D.diff_corpus(C.page_documents(spark, d))
    return r.select("group_id", "ri", "node_id", "type", "status", "n_present", "is_optional", "n_distinct", "detected_kind", "static_prefix", "static_suffix")


def part_skeletons(spark, d):
    """Shared wording of generated part lines per brand, without collecting them."""
    p = C.table(spark, d, "part")
    lines = p.select(
        F.col("p_brand").alias("brand"),
        F.concat(F.lit("Item "), F.col("p_type"), F.lit(" size "), F.col("p_size").cast("string"), F.lit(" in stock")).alias("text"),
    ).distinct()
    return D.common_skeleton(lines, ["brand"])


def brand_values(spark, d):
    p = C.table(spark, d, "part")
    vals = p.select("p_brand", F.col("p_name").alias("text"), "p_partkey")
    return D.distinct_texts(vals, ["p_brand"], "p_partkey").select(
        "p_brand", "n_distinct", F.array_join("texts", "|").alias("texts")
    )


def _analysis(spark, d):
    return P.analyze(C.staged_forms(spark, d))


def form_classes(spark, d):
    a = _analysis(spark, d)
    return a.classified.select(
        "group_id", "node_id", "classification", "field_name", "field_type", "description", "required", "confidence",
        "optional", "static_prefix", "section_key", "rationale",
    )


def form_class_counts(spark, d):
    return K.classification_breakdown(_analysis(spark, d).classified)


def form_fields(spark, d):
    a = _analysis(spark, d)
    return a.fields.select(
        "group_id", F.col("field_order").cast(BIG).alias("field_order"), "field_name", "label", "field_type",
        "classification", "required", "default", F.array_join("node_ids", ",").alias("node_ids"), "section_key",
        F.array_join(F.transform("columns", lambda c: F.concat(c["field_name"], F.lit(":"), c["field_type"])), ",").alias("columns"),
        "confidence",
    )


def form_rules(spark, d):
    a = _analysis(spark, d)
    return FD.derive_rules(a.fields).select("group_id", "rule_id", "rule_type", "field_name", "message", "severity")


def form_doc_types(spark, d):
    return K.guess_doc_type(E.explode_documents(C.forms(spark, d))).groupBy("group_id", "document_type").agg(F.count(F.lit(1)).alias("n_docs"))


def form_sections(spark, d):
    a = _analysis(spark, d)
    return a.sections.select("group_id", F.col("section_order").cast(BIG).alias("section_order"), "section_key", "title", "purpose",
                             F.array_join("field_names", ",").alias("field_names"))


def page_classes(spark, d):
    """Every page read on its own: classes with body runs merged."""
    els = E.explode_documents(C.page_documents(spark, d))
    c = K.classify(els)
    return c.groupBy("doc_id", "classification", "rationale").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("field_name").alias("n_fields")
    )


def text_doubts(spark, d):
    els = E.explode_documents(S.documents_from_text(C.wide(spark, d, "documents"), group="lang", key="doc_id"))
    return K.questionable(K.classify(els)).groupBy("group_id", "classification").agg(F.count(F.lit(1)).alias("n_nodes"))


def page_tags(spark, d):
    """Full-template mode: every text of every page becomes a field."""
    els = E.explode_documents(C.page_documents(spark, d))
    t = TG.enforce_tags_only(els, K.classify(els))
    return t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("forced")).alias("forced"),
        F.count_distinct("field_name").alias("n_fields"), F.count_if(F.col("field_name").isNull()).alias("unnamed"),
    )


def line_field_names(spark, d):
    """Collision-free names for the lines of each order, in line order."""
    li = C.table(spark, d, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
        F.lower(F.concat_ws("_", F.lit("line"), "l_returnflag", "l_linestatus")).alias("base"),
    )
    named = N.with_unique_names(li, ["l_orderkey"], "ord", "base", "field_name")
    return named.groupBy("l_orderkey", "base").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("field_name").alias("first_name"), F.count_distinct("field_name").alias("n_names")
    )


def brand_version_diff(spark, d):
    from formloom.operators import records as R

    p = C.table(spark, d, "part")
    def version(brand_side, required):
        return p.where(brand_side).groupBy(F.col("p_type").alias("template_id"), F.col("p_name").alias("field_name")).agg(
            F.max("p_brand").alias("field_type"), F.max(required).alias("required"))
    a = version(F.col("p_size") <= 30, F.col("p_retailprice") > 1000)
    b = version(F.col("p_size") > 20, F.col("p_retailprice") > 1400)
    return R.version_diff(a, b)


QUERIES = {
    f.__name__: f
    for f in (
        form_diff, form_node_values, form_row_counts, form_diff_summary, page_diff, part_skeletons, brand_values, form_classes, form_class_counts,
        form_fields, form_rules, form_doc_types, form_sections, page_classes, text_doubts, page_tags,
        line_field_names, brand_version_diff,
    )
}

#: What the fixed form layout must come to, node by node (derived by hand).
_N = """(VALUES
 (0,'paragraph','identical',NULL,NULL), (1,'paragraph','partial_change','Order Number: ','number'),
 (2,'paragraph','partial_change','Customer Name: ','text'), (3,'paragraph','partial_change','Order Date: ','date'),
 (4,'paragraph','partial_change','Status: ','text'), (5,'paragraph','identical',NULL,NULL),
 (6,'heading','identical',NULL,NULL), (7,'table','row_count_changed',NULL,NULL),
 (8,'paragraph','partial_change','Total Due: ','number'), (9,'heading','identical',NULL,NULL),
 (10,'paragraph','identical',NULL,NULL)) AS n(ri, type, status, prefix, kind)"""
_DIFF_SQL = f"""{C.FORMS_SQL}, pos AS (
  SELECT *, doc_order + CASE WHEN NOT big AND doc_order > 4 THEN 1 ELSE 0 END AS ri,
         CASE WHEN type = 'table' THEN coalesce(cells::VARCHAR, '') ELSE text END AS val FROM els
), rep AS (SELECT group_id, min(doc_seq) FILTER (big) AS rep_seq, count(DISTINCT doc_seq) AS n_documents FROM pos GROUP BY group_id
), agg AS (
  SELECT pos.group_id, ri, count(*) AS n_present, count(DISTINCT val) AS n_distinct, min(n_lines) + 1 AS lo, max(n_lines) + 1 AS hi,
         max(text) FILTER (doc_seq = rep_seq) AS rep_text
  FROM pos JOIN rep USING (group_id) GROUP BY pos.group_id, ri)"""

_CLS_SQL = f"""(VALUES
 ('n0001','FIXED',NULL,NULL,'',false,false,NULL,'preamble','identical across samples'),
 ('n0002','DYNAMIC_NUMBER','order_number','number','Dynamic number value for ''Order Number''',true,false,'Order Number: ','preamble','diff:partial_change'),
 ('n0003','DYNAMIC_TEXT','customer_name','text','Dynamic text value for ''Customer Name''',true,false,'Customer Name: ','preamble','diff:partial_change'),
 ('n0004','DYNAMIC_DATE','order_date','date','Dynamic date value for ''Order Date''',true,false,'Order Date: ','preamble','diff:partial_change'),
 ('n0005','DYNAMIC_TEXT','status','text','Dynamic text value for ''Status''',true,false,'Status: ','preamble','diff:partial_change'),
 ('n0006','FIXED',NULL,NULL,'',false,true,NULL,'preamble','identical across samples'),
 ('n0007','FIXED',NULL,NULL,'',false,false,NULL,'n0007','heading / structural label'),
 ('n0008','REPEATABLE_TABLE','line_items','table','Repeatable table rows for ''Line Items''',true,false,NULL,'n0007','table rows vary across samples'),
 ('n0009','DYNAMIC_NUMBER','total_due','number','Dynamic number value for ''Total Due''',true,false,'Total Due: ','n0007','diff:partial_change'),
 ('n0010','FIXED',NULL,NULL,'',false,false,NULL,'n0010','heading / structural label'),
 ('n0011','FIXED',NULL,NULL,'',false,false,NULL,'n0010','identical across samples'))
 AS c(node_id, classification, field_name, field_type, description, required, optional, static_prefix, section_key, rationale)"""
_GROUPS = "(SELECT DISTINCT o_orderpriority AS group_id FROM orders)"
_FIELDS_SQL = f"""(VALUES
 (0,'order_number','Order Number','number','DYNAMIC_NUMBER',true,NULL,'n0002','preamble',''),
 (1,'customer_name','Customer Name','text','DYNAMIC_TEXT',true,NULL,'n0003','preamble',''),
 (2,'order_date','Order Date','date','DYNAMIC_DATE',true,NULL,'n0004','preamble',''),
 (3,'status','Status','text','DYNAMIC_TEXT',true,NULL,'n0005','preamble',''),
 (4,'line_items','Line Items','table','REPEATABLE_TABLE',true,NULL,'n0008','n0007','part:text,quantity:number,price:number'),
 (5,'total_due','Total Due','number','DYNAMIC_NUMBER',true,NULL,'n0009','n0007',''),
 (6,'include_orders_of_this_size_are','Include: ' || substr('{S.FORM_CLAUSE}', 1, 40),'boolean','FIXED',false,'true','n0006',NULL,''))
 AS f(field_order, field_name, label, field_type, classification, required, "default", node_ids, section_key, columns)"""

ORACLES = {
    "form_diff": f"""WITH {_DIFF_SQL} SELECT group_id, 'n' || lpad((n.ri + 1)::VARCHAR, 4, '0') AS node_id, n.type, n.status, n_documents, n_present,
        n_present < n_documents AS is_optional, n.status = 'identical' AND (n.type = 'table' OR n_present = n_documents) AS is_constant, 0.95::DOUBLE AS confidence,
        prefix AS static_prefix, CASE WHEN prefix IS NOT NULL THEN '' END AS static_suffix, kind AS detected_kind, n_distinct,
        CASE WHEN n.type = 'table' THEN true END AS header_identical, CASE WHEN n.type = 'table' THEN true END AS row_count_variable,
        CASE WHEN n.type = 'table' THEN lo END AS min_rows, CASE WHEN n.type = 'table' THEN hi END AS max_rows,
        CASE WHEN n_present < n_documents THEN 'absent in some samples' ELSE '' END AS notes,
        CASE WHEN n.type = 'table' THEN 'Part | Quantity | Price' ELSE rep_text END AS first_sample,
        CASE WHEN prefix IS NOT NULL THEN rep_text[length(prefix)+1:] END AS first_part
        FROM agg JOIN {_N} ON n.ri = agg.ri JOIN rep USING (group_id)""",
    "form_node_values": f"""WITH {_DIFF_SQL}, told AS (
        SELECT DISTINCT pos.group_id, pos.ri, pos.text, count(*) OVER w AS n_docs, bool_or(doc_seq = rep_seq) OVER w AS in_representative
        FROM pos JOIN rep USING (group_id) WINDOW w AS (PARTITION BY pos.group_id, pos.ri, pos.text))
        SELECT group_id, n.ri, 'n' || lpad((n.ri + 1)::VARCHAR, 4, '0') AS node_id, n.type, n.status, text,
        CASE WHEN prefix IS NOT NULL THEN text[length(prefix)+1:] END AS variable_part, NULL::VARCHAR AS image_hash, n_docs, in_representative
        FROM told JOIN {_N} ON n.ri = told.ri""",
    "form_row_counts": f"""WITH {_DIFF_SQL} SELECT DISTINCT group_id, ri, n_lines + 1 AS n_rows, count(*) OVER (PARTITION BY group_id, ri, n_lines) AS n_docs
        FROM pos WHERE type = 'table'""",
    "form_diff_summary": f"SELECT group_id, status, count(*) AS n_nodes FROM {_GROUPS} CROSS JOIN {_N} GROUP BY ALL",
    "part_skeletons": """WITH l AS (SELECT DISTINCT p_brand AS brand, p_type, p_size FROM part),
        s AS (SELECT brand, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes, min(p_type) AS t, min(p_size)::VARCHAR AS z, count(*) AS n FROM l GROUP BY brand)
        SELECT brand, 'Item ' || CASE WHEN types = 1 THEN t || ' size ' ELSE '' END AS prefix,
        CASE WHEN sizes = 1 THEN ' size ' || z ELSE '' END || ' in stock' AS suffix FROM s WHERE n > 1""",
    "brand_values": """WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS k FROM part GROUP BY ALL),
        r AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM f)
        SELECT p_brand, max(n) AS n_distinct, string_agg(p_name, '|' ORDER BY k) AS texts FROM r GROUP BY p_brand""",
    "form_classes": f"SELECT group_id, c.*, 0.95::DOUBLE AS confidence FROM {_GROUPS} CROSS JOIN {_CLS_SQL}",
    "form_class_counts": f"SELECT group_id, classification, count(*) AS n_nodes FROM {_GROUPS} CROSS JOIN {_CLS_SQL} GROUP BY ALL",
    "form_fields": f"SELECT group_id, f.*, 0.95::DOUBLE AS confidence FROM {_GROUPS} CROSS JOIN {_FIELDS_SQL}",
    "form_rules": f"""WITH f AS (SELECT * FROM {_GROUPS} CROSS JOIN {_FIELDS_SQL})
        SELECT group_id, field_name || ':required' AS rule_id, 'required' AS rule_type, field_name, '''' || label || ''' is required' AS message, 'error' AS severity FROM f WHERE required
        UNION ALL SELECT group_id, field_name || ':date_format', 'date_format', field_name, '''' || label || ''' should be a valid date', 'warning' FROM f WHERE field_type = 'date'
        UNION ALL SELECT group_id, field_name || ':numeric_format', 'numeric_format', field_name, '''' || label || ''' should be numeric', 'warning' FROM f WHERE field_type = 'number'
        UNION ALL SELECT group_id, field_name || ':table_schema', 'table_schema', field_name, 'Rows of ''' || label || ''' must match the column schema', 'warning' FROM f WHERE field_type = 'table'""",
    "form_doc_types": "SELECT o_orderpriority AS group_id, 'Order Form' AS document_type, count(*) AS n_docs FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "form_sections": f"""SELECT group_id, s.* FROM {_GROUPS} CROSS JOIN (VALUES
        (-1, 'preamble', 'Preamble', 'Top-of-document content.', 'order_number,customer_name,order_date,status'),
        (6, 'n0007', 'Line Items', 'Content belonging to the ''Line Items'' section.', 'line_items,total_due'),
        (9, 'n0010', 'Terms', 'Content belonging to the ''Terms'' section.', '')) AS s(section_order, section_key, title, purpose, field_names)""",
    "line_field_names": """WITH b AS (SELECT l_orderkey, lower('line_' || l_returnflag || '_' || l_linestatus) AS base FROM lineitem)
        SELECT l_orderkey, base, count(*) AS n_lines, base AS first_name, count(*) AS n_names FROM b GROUP BY ALL""",
    "brand_version_diff": """WITH a AS (SELECT p_type AS template_id, p_name AS field_name, max(p_brand) AS ft, max(p_retailprice > 1000) AS rq FROM part WHERE p_size <= 30 GROUP BY ALL),
        b AS (SELECT p_type AS template_id, p_name AS field_name, max(p_brand) AS ft, max(p_retailprice > 1400) AS rq FROM part WHERE p_size > 20 GROUP BY ALL)
        SELECT template_id, field_name, CASE WHEN a.ft IS NULL THEN 'added' WHEN b.ft IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM a FULL JOIN b USING (template_id, field_name) WHERE a.ft IS NULL OR b.ft IS NULL OR a.ft <> b.ft OR a.rq <> b.rq""",
}
