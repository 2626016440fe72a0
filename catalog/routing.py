"""Routing texts, documents and model answers onto fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common as C
from catalog.compliance import received_and_templates
from formloom.functions import similarity as SIM
from formloom.operators import compliance as K
from formloom.operators import elements as E
from formloom.operators import naming as N
from formloom.operators import responses as RS
from formloom.operators import routing as R
from formloom.sources import text as S

BIG = "bigint"


def order_fields(spark, d):
    """The order form's fields, one set per priority group (as derived)."""
    groups = C.table(spark, d, "orders").select(F.col("o_orderpriority").alias("template_id")).distinct()
    def f(i, name, label, kind, required=True, columns=(), description=""):
        cols = F.array(*[F.struct(F.lit(n).alias("field_name"), F.lit(l).alias("label"), F.lit(t).alias("field_type"), F.lit(False).alias("required"))
                         for n, l, t in columns]) if columns else F.array()
        return F.struct(F.lit(i).alias("field_order"), F.lit(name).alias("field_name"), F.lit(label).alias("label"), F.lit(kind).alias("field_type"),
                        F.lit(required).alias("required"), F.lit(description).alias("description"),
                        cols.cast("array<struct<field_name:string,label:string,field_type:string,required:boolean>>").alias("columns"),
                        F.array().cast("array<string>").alias("enum_values"))
    return groups.select("template_id", F.inline(F.array(
        f(0, "order_number", "Order Number", "number"), f(1, "customer_name", "Customer Name", "text"), f(2, "order_date", "Order Date", "date"),
        f(3, "status", "Status", "text"),
        f(4, "line_items", "Line Items", "table", columns=(("part", "Part", "text"), ("quantity", "Quantity", "number"), ("price", "Price", "number"))),
        f(5, "total_due", "Total Due", "number"),
        f(6, "terms_note", "Terms note", "multiline_text", False, description="goods remain property seller claims delivery"))))


def _texts(spark, d):
    return E.document_content(C.forms(spark, d)).select(
        F.col("doc_id").alias("request_id"), F.col("group_id").alias("template_id"), F.array_join("paragraphs", "\n").alias("text"), "paragraphs", "tables")


def routed_texts(spark, d):
    p, _ = R.route_text(_texts(spark, d), order_fields(spark, d))
    return p.select("request_id", "field_name", "value", "confidence", "ambiguous", "note")


def unmapped_lines(spark, d):
    _, lost = R.route_text(_texts(spark, d), order_fields(spark, d))
    return lost.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def routed_documents(spark, d):
    """Forms read by content: label lines, prose and the table."""
    p, _ = R.route_document_content(_texts(spark, d), order_fields(spark, d))
    t = p.where("rows IS NOT NULL")
    return t.select("request_id", "field_name", "confidence", F.size("rows").cast(BIG).alias("n_rows"),
                    F.md5(F.array_join(F.transform("rows", lambda r: F.concat_ws("|", r["part"], r["quantity"], r["price"])), ";")).alias("rows_md5"))


def structural_values(spark, d):
    """Received forms read against their template, element by element."""
    p = R.route_structural(K.compare(*received_and_templates(spark, d)))
    return p.select("request_id", "field_name", F.coalesce("value", F.concat(F.size("rows").cast("string"), F.lit(" rows"))).alias("value"), "confidence")


def route_coverage(spark, d):
    docs, specs = received_and_templates(spark, d)
    p = R.route_structural(K.compare(docs, specs))
    req = docs.select(F.col("doc_id").alias("request_id"), F.col("group_id").alias("template_id"))
    f = order_fields(spark, d).where("field_name <> 'terms_note'")
    cov = R.structural_coverage(req, p, f)
    mis = R.document_mismatch(req, p, f)
    return cov.join(mis, "request_id").select("request_id", F.round("coverage", 4).alias("coverage"), "filled", "required", "mismatch")


def _supplied(spark, d):
    o = C.table(spark, d, "orders")
    def kv(k, v):
        return F.struct(F.lit(k).alias("field_name"), v.cast("string").alias("value"))
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("template_id"), F.inline(F.array(
        kv("order_number", F.col("o_orderkey")), kv("status", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))),
        kv("clerk", F.col("o_custkey"))))).withColumn("rows", F.lit(None).cast(R.ROWS))


def structured_placements(spark, d):
    return R.route_structured(_supplied(spark, d), order_fields(spark, d)).select("request_id", "field_name", "value", "confidence")


def structured_gaps(spark, d):
    data, f = _supplied(spark, d), order_fields(spark, d)
    p = R.route_structured(data, f)
    miss = R.missing_required(f, data, p).groupBy("request_id").agg(F.count(F.lit(1)).alias("n_missing"))
    odd = R.unknown_keys(data, f).groupBy("request_id").agg(F.min("unmapped").alias("unmapped"))
    return miss.join(odd, "request_id", "full_outer")


def part_labels(spark, d):
    """Part names matched to the part kinds of their brand by shared words."""
    p = C.table(spark, d, "part")
    labels = p.select(F.col("p_brand").alias("template_id"), F.concat("p_name", F.lit(" of "), F.lower("p_type")).alias("label"))
    fields = p.groupBy(F.col("p_brand").alias("template_id"), F.concat(F.lower("p_type"), F.lit("_"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("field_name")).agg(
        F.min("p_partkey").alias("field_order")).withColumn("label", F.replace("field_name", F.lit("_"), F.lit(" ")))
    return R.match_labels(labels, fields).select("template_id", "label", "field_name", F.round("score", 6).alias("score"))


def _answers(spark, d):
    """Answers about orders: names exact, as labels, misspelt or unknown."""
    o = C.table(spark, d, "orders")
    def a(i, name, value, drafted=False):
        return F.struct(F.lit(i).alias("answer_order"), name.alias("name"), value.cast("string").alias("value"), F.lit("0.8").alias("confidence"),
                        F.lit(drafted).alias("ai_drafted"), F.lit("").alias("note"))
    st = F.col("o_orderstatus")
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("template_id"), F.inline(F.array(
        a(0, F.when(st == "F", "Order Number").when(st == "O", "order_numbr").otherwise("order_number"), F.col("o_orderkey")),
        a(1, F.lit("order_number"), F.lit("second")),
        a(2, F.lit("Order Date"), F.when(st == "P", "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), True),
        a(3, F.when(st == "P", "clerk").otherwise("status"), st))))


def merged_answers(spark, d):
    p, _ = RS.merge_placements(_answers(spark, d), order_fields(spark, d))
    return p.select("request_id", "field_name", "value", "confidence", "ai_drafted", "note", "flagged")


def unplaceable_answers(spark, d):
    _, lost = RS.merge_placements(_answers(spark, d), order_fields(spark, d))
    return lost.groupBy("template_id", "name").agg(F.count(F.lit(1)).alias("n"))


def composed_values(spark, d):
    o = C.table(spark, d, "orders")
    base = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("template_id"), F.lit("status").alias("field_name"),
                    F.col("o_orderstatus").alias("value"), F.lit(0.7).alias("confidence"), F.lit(False).alias("ai_drafted"), F.lit("").alias("note"))
    new = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("template_id"),
        F.when(F.col("o_orderstatus") == "F", "status").otherwise("total_due").alias("field_name"),
        F.when(F.col("o_orderstatus") == "F", "Filled").otherwise("unknown").alias("value"), F.lit("1.5").alias("confidence"), F.lit(True).alias("ai_drafted"), F.lit("").alias("note"))
    return RS.compose_updates(base, new, order_fields(spark, d)).drop("template_id")


def refined_values(spark, d):
    o = C.table(spark, d, "orders")
    cur = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("template_id"), F.inline(F.array(
        F.struct(F.lit("status").alias("field_name"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("order_number").alias("field_name"), F.col("o_orderkey").cast("string").alias("value")))))
    upd = o.where("o_totalprice > 300000").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("template_id"), F.lit("status").alias("field_name"),
        F.lit("Large").alias("value"), F.lit("0.9").alias("confidence"), F.lit("").alias("note"), F.lit(False).alias("ai_drafted"))
    rem = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("template_id"), F.lit("order_number").alias("field_name"))
    return RS.refine_patch(cur, upd, rem, order_fields(spark, d)).select("request_id", "field_name", "value", "confidence")


def name_similarity(spark, d):
    """Every part name against its brand's first part name."""
    p = C.table(spark, d, "part")
    first = p.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("first_name"))
    j = p.join(first, "p_brand")
    return j.select("p_partkey", F.round(SIM.similarity("p_name", "first_name"), 6).alias("score"),
                    SIM.similar_enough("p_name", "first_name", 0.8).alias("close"))


def page_requests(spark, d):
    """Batched model requests for every page's nodes (no evidence: read alone)."""
    els = E.explode_documents(C.page_documents(spark, d))
    none = els.limit(0).select("group_id", "node_id", F.lit("").alias("status"), F.lit("").alias("detected_kind"), F.lit("").alias("static_prefix"),
                               F.lit(False).alias("row_count_variable"), F.array(F.lit("")).alias("sample_texts"), F.lit(0.5).alias("confidence"))
    r = RS.inference_requests(els, none)
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_requests"), F.sum("n_items").cast(BIG).alias("n_nodes"))


QUERIES = {f.__name__: f for f in (
    routed_texts, unmapped_lines, routed_documents, structural_values, route_coverage, structured_placements, structured_gaps, part_labels,
    merged_answers, unplaceable_answers, composed_values, refined_values, name_similarity, page_requests)}

_B = f"""base AS (SELECT o_orderkey AS k, o_orderpriority AS g, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%Y-%m-%d') AS day, c_name, o_orderstatus AS st,
   o_totalprice::DECIMAL(18,2)::VARCHAR AS total, o_totalprice > {S.CLAUSE_ABOVE} AS big, coalesce(n, 0) AS n, cells
   FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n,
     list(l_partkey || '|' || l_quantity::DECIMAL(18,0) || '|' || l_extendedprice::DECIMAL(18,2) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS cells FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_SV = f"""{_B}, v AS (
   SELECT k, 'order_number' AS field_name, k::VARCHAR AS value FROM base UNION ALL SELECT k, 'customer_name', c_name FROM base WHERE m <> '04'
   UNION ALL SELECT k, 'order_date', CASE WHEN m = '03' THEN 'n/a' ELSE day END FROM base UNION ALL SELECT k, 'status', st FROM base
   UNION ALL SELECT k, 'total_due', '$' || total FROM base UNION ALL SELECT k, 'line_items', n || ' rows' FROM base WHERE m <> '05' AND n > 0)"""
_TOK = lambda x: f"list_distinct(list_filter(string_split(replace(lower({x}), ' ', '_'), '_'), lambda w: w NOT IN ('', 'the', 'a', 'an', 'and', 'or')))"

ORACLES = {
    # Topic words of the terms field: terms, note, goods, remain, property, seller, claims.  The
    # sentence's first five words cover four of the seven, the heading "Terms" one, the clause none.
    "routed_texts": f"""WITH {_B} SELECT k::VARCHAR AS request_id, u.field_name, u.value, CASE WHEN u.field_name = 'terms_note' THEN 0.45 ELSE 0.7 END::DOUBLE AS confidence, false AS ambiguous,
        CASE WHEN u.field_name = 'terms_note' THEN 'Low-confidence: matched to this field by keyword overlap.' ELSE '' END AS note
        FROM base, LATERAL (SELECT unnest([{{'field_name': 'order_number', 'value': k::VARCHAR}}, {{'field_name': 'customer_name', 'value': c_name}}, {{'field_name': 'order_date', 'value': day}},
        {{'field_name': 'status', 'value': st}}, {{'field_name': 'total_due', 'value': '$' || total}}, {{'field_name': 'terms_note', 'value': '{S.FORM_TERMS}'}}]) AS u)""",
    "unmapped_lines": f"WITH {_B} SELECT unnest(['Line Items', 'Terms']) AS line, count(*) AS n FROM base UNION ALL SELECT '{S.FORM_CLAUSE}', count(*) FROM base WHERE big",
    "routed_documents": f"""WITH {_B} SELECT k::VARCHAR AS request_id, 'line_items' AS field_name, 0.6::DOUBLE AS confidence, n AS n_rows, md5(coalesce(array_to_string(cells, ';'), '')) AS rows_md5 FROM base""",
    "structural_values": f"WITH {_SV} SELECT k::VARCHAR AS request_id, field_name, value, 0.9::DOUBLE AS confidence FROM v",
    "route_coverage": f"WITH {_SV}, c AS (SELECT base.k, count(v.k) AS n FROM base LEFT JOIN v ON v.k = base.k GROUP BY 1) SELECT k::VARCHAR AS request_id, round(n / 6, 4) AS coverage, n AS filled, 6::BIGINT AS required, n / 6 < 0.5 AS mismatch FROM c",
    "structured_placements": "SELECT o_orderkey AS request_id, 'order_number' AS field_name, o_orderkey::VARCHAR AS value, 1.0::DOUBLE AS confidence FROM orders UNION ALL SELECT o_orderkey, 'status', o_orderstatus, 1.0 FROM orders WHERE o_orderstatus <> 'F'",
    "structured_gaps": "SELECT o_orderkey AS request_id, CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 4 END::BIGINT AS n_missing, 'unknown key: clerk' AS unmapped FROM orders",
    "part_labels": f"""WITH l AS (SELECT DISTINCT p_brand AS t, p_name || ' of ' || lower(p_type) AS label FROM part),
        f AS (SELECT p_brand AS t, lower(p_type) || '_' || string_split(p_name, ' ')[2] AS fname, min(p_partkey) AS ord FROM part GROUP BY ALL),
        s AS (SELECT l.t, label, fname, ord, {_TOK('label')} AS a, {_TOK('fname')} AS b FROM l JOIN f ON l.t = f.t),
        j AS (SELECT *, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS score FROM s)
        SELECT t AS template_id, label, fname AS field_name, round(score, 6) AS score FROM j WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY t, label ORDER BY score DESC, ord) = 1""",
    "merged_answers": """SELECT o_orderkey AS request_id, 'order_number' AS field_name, o_orderkey::VARCHAR AS value, 0.8::DOUBLE AS confidence, false AS ai_drafted, '' AS note, false AS flagged FROM orders
        UNION ALL SELECT o_orderkey, 'order_date', CASE WHEN o_orderstatus = 'P' THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderstatus = 'P' THEN 0.3 ELSE 0.8 END, true,
          CASE WHEN o_orderstatus = 'P' THEN 'AI-drafted Needs review — not a recognizable date.' ELSE 'AI-drafted' END, o_orderstatus = 'P' FROM orders
        UNION ALL SELECT o_orderkey, 'status', o_orderstatus, 0.8, false, '', false FROM orders WHERE o_orderstatus <> 'P'""",
    "unplaceable_answers": "SELECT o_orderpriority AS template_id, 'clerk' AS name, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL",
    "composed_values": """SELECT o_orderkey AS request_id, 'status' AS field_name, CASE WHEN o_orderstatus = 'F' THEN 'Filled' ELSE o_orderstatus END AS value, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence,
        o_orderstatus = 'F' AS ai_drafted, CASE WHEN o_orderstatus = 'F' THEN 'AI-drafted' ELSE '' END AS note, false AS flagged FROM orders
        UNION ALL SELECT o_orderkey, 'total_due', 'unknown', 0.3, true, 'AI-drafted Needs review — not numeric.', true FROM orders WHERE o_orderstatus = 'P'""",
    "refined_values": """SELECT o_orderkey AS request_id, 'status' AS field_name, CASE WHEN o_totalprice > 300000 THEN 'Large' ELSE o_orderstatus END AS value, CASE WHEN o_totalprice > 300000 THEN 0.9 END::DOUBLE AS confidence FROM orders
        UNION ALL SELECT o_orderkey, 'order_number', o_orderkey::VARCHAR, NULL FROM orders WHERE o_orderstatus <> 'P'""",
}
