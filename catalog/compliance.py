"""Validation and compliance of received forms against their template."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from catalog import common as C
from formloom.operators import compliance as K
from formloom.operators import fields as FD
from formloom.operators import render as G
from formloom.operators import validate as VA
from formloom.operators.align import LAYOUT
from formloom.plans import analyze as P
from formloom.session import stage
from formloom.sources import text as S

ALTERED = "Goods are sold as seen; the seller accepts no claims."
OTHER_HEADERS = ("Article", "Units", "Cost")


def received(docs):
    """Forms as they came back: depending on the order's month the terms are
    altered or gone, the date or the customer is unusable, the table is gone or
    has other columns.  Every form is in it."""
    month = F.substring(F.get("elements", F.lit(3))["text"], 18, 2)

    def damage(e):
        text = (
            F.when((F.col("_m") == "01") & (e["text"] == S.FORM_TERMS), ALTERED)
            .when((F.col("_m") == "03") & e["text"].startswith("Order Date:"), "Order Date: n/a")
            .when((F.col("_m") == "04") & e["text"].startswith("Customer Name:"), "Customer Name: ")
            .otherwise(e["text"])
        )
        ts = e["table_structure"]
        heads = F.array(*[F.lit(h) for h in OTHER_HEADERS])
        renamed = ts.withField("headers", heads).withField("rows", F.concat(F.array(heads), F.slice(ts["rows"], 2, F.greatest(F.size(ts["rows"]), F.lit(1)))))
        return e.withField("text", text).withField(
            "table_structure", F.when((F.col("_m") == "06") & ts.isNotNull(), renamed).otherwise(ts))

    kept = F.filter(
        F.transform("elements", damage),
        lambda e: ~(((F.col("_m") == "02") & (e["text"] == S.FORM_TERMS)) | ((F.col("_m") == "05") & (e["type"] == "table"))),
    )
    return docs.withColumn("_m", month).withColumn("elements", kept).drop("_m", *LAYOUT)


def published(docs):
    """The forms' templates (``specs``, ``fields``, ``rules``, ``blocks``), derived
    from the given orders by every query that uses them."""
    a = P.analyze(docs)
    fields = stage(a.fields, "fields")
    keyed = lambda df: df.withColumnRenamed("group_id", "template_id").drop("doc_id")
    return {
        "specs": stage(K.template_specs(a.representatives, a.classified, fields), "templates"),
        "fields": keyed(fields),
        "rules": keyed(FD.derive_rules(fields)),
        "blocks": G.template_blocks(a.representatives, a.classified, fields, a.sections),
    }


def received_and_templates(spark, d):
    """The forms as they came back, beside the specs of the forms' templates."""
    docs, back = C.staged_forms_and(spark, d, received)
    return back, published(docs)["specs"]


def _reports(spark, d):
    return K.check_compliance(*received_and_templates(spark, d))


def form_compliance(spark, d):
    r = _reports(spark, d)
    dims = {n: F.get(F.col("dimensions"), F.lit(i))["score"] for i, n in enumerate(K.DIMENSIONS)}
    return r.select("group_id", "doc_id", "score", "grade", "fixable", *[c.alias(n) for n, c in dims.items()],
                    F.array_join("matched_fields", ",").alias("matched"), F.array_join("missing_fields", ",").alias("missing"))


def compliance_differences(spark, d):
    return _reports(spark, d).select("doc_id", K.inlined(F.col("differences"))).select(
        "doc_id", "kind", "field_name", "severity", "expected", "found", "message")


def compliance_alignment(spark, d):
    rows = _reports(spark, d).select("group_id", K.inlined(F.col("alignment")))
    return rows.groupBy("group_id", "classification", "status", "severity", "field_name").agg(F.count(F.lit(1)).alias("n"))


def actionable_rows(spark, d):
    return K.actionable(_reports(spark, d)).groupBy("status", "highlight_left").agg(F.count(F.lit(1)).alias("n"))


def _judgeable(spark, d):
    """What judging reads of the reports, written once; alignments stay out of it."""
    return stage(_reports(spark, d).select("group_id", "doc_id", "score", "dimensions", "differences"), "reports")


def judged_compliance(spark, d):
    """Reports after a judge called every missing piece material."""
    r = _judgeable(spark, d)
    verdicts = r.select("group_id", "doc_id", F.posexplode("differences").alias("index", "x")).select(
        "group_id", "doc_id", "index", F.lit("error").alias("severity"),
        F.col("x.kind").startswith("missing").alias("material"), F.lit("Judged").alias("rationale"))
    j = K.apply_verdicts(r, verdicts)
    sem = F.get(F.filter("dimensions", lambda x: x["name"] == "semantic"), F.lit(0))["score"]
    return j.select("doc_id", "score", sem.alias("semantic"), F.size("differences").cast("bigint").alias("n_differences"),
                    F.array_join(F.array_distinct(F.transform("differences", lambda x: x["severity"])), ",").alias("severities"))


def repaired_forms(spark, d):
    fixed = K.fix_boilerplate(*received_and_templates(spark, d))
    return fixed.select("doc_id", F.col("n_fixed").cast("bigint").alias("n_fixed"), F.md5(F.array_join(F.transform(
        "blocks", lambda b: F.concat(b["type"], F.lit(":"), b["text"])), "\n")).alias("blocks_md5"))


def _order_context(spark, d):
    """Order values as supplied for generation, some unusable."""
    o = C.table(spark, d, "orders")
    rows = S.line_item_rows(C.table(spark, d, "lineitem")).hint("merge")
    keyed = F.transform("data_rows", lambda r: F.when(
        r[1].cast("int") > 49, F.create_map(F.lit("part"), r[0], F.lit("price"), r[2], F.lit("note"), F.lit("bulk"))
    ).otherwise(F.create_map(F.lit("part"), r[0], F.lit("quantity"), r[1], F.lit("price"), r[2])))
    wide = o.join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    def given(name, value=None, rows=None):
        return F.struct(
            F.lit(name).alias("field_name"), (value if value is not None else F.lit(None)).cast("string").alias("value"),
            (rows if rows is not None else F.lit(None)).cast("array<map<string,string>>").alias("rows"))

    pairs = F.array(
        given("order_date", F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))),
        given("total_due", F.when(F.col("o_totalprice") < 5000, "none").otherwise(S.money(F.col("o_totalprice")))),
        given("status", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))),
        given("line_items", rows=keyed),
    )
    return wide.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("template_id"), F.inline(pairs))


def _order_rules(spark, d):
    groups = C.table(spark, d, "orders").select(F.col("o_orderpriority").alias("template_id")).distinct()
    P_ = FD.rule_params
    def field(name, label):
        return F.struct(F.lit(name).alias("field_name"), F.lit(label).alias("label"))
    fields = groups.select("template_id", F.inline(F.array(
        field("order_date", "Order Date"), field("total_due", "Total Due"), field("status", "Status"), field("line_items", "Line Items"))))
    def rule(name, kind, severity, params):
        return F.struct(F.lit(name).alias("field_name"), F.lit(f"{name}:{kind}").alias("rule_id"), F.lit(kind).alias("rule_type"),
                        params.alias("params"), F.lit(None).cast("string").alias("message"), F.lit(severity).alias("severity"))
    s = lambda *xs: F.array(*[F.lit(x) for x in xs])
    rules = groups.select("template_id", F.inline(F.array(
        rule("order_date", "date_format", "warning", P_(formats=s("%d/%m/%Y"))),
        rule("total_due", "numeric_format", "warning", P_()),
        rule("total_due", "max_length", "info", P_(max=F.lit(8))),
        rule("total_due", "regex", "info", P_(pattern=F.lit("[0-9]+[.][0-9]{2}|none"))),
        rule("status", "required", "error", P_()),
        rule("status", "enum", "error", P_(allowed=s("O", "F"))),
        rule("status", "min_length", "info", P_(min=F.lit(1))),
        rule("line_items", "table_schema", "warning", P_(columns=s("part", "quantity", "price"), required_columns=s("quantity"))),
    )))
    return fields, rules


def order_issues(spark, d):
    fields, rules = _order_rules(spark, d)
    found = VA.validate(_order_context(spark, d), fields, rules)
    return found.groupBy("request_id", "rule_id", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.min("message").alias("first_message"), F.max("suggested_fix").alias("fix"))


def order_status(spark, d):
    fields, rules = _order_rules(spark, d)
    ctx = _order_context(spark, d)
    return VA.issue_summary(ctx, VA.validate(ctx, fields, rules))


def pattern_issues(spark, d):
    """Regex rules on customers: a valid pattern, and one that does not compile."""
    c = C.table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.lit("t").alias("template_id"), "c_name", "c_mktsegment")
    value = lambda name, v: F.struct(F.lit(name).alias("field_name"), F.col(v).alias("value"), F.lit(None).cast("array<map<string,string>>").alias("rows"))
    context = c.select("request_id", "template_id", F.inline(F.array(value("name", "c_name"), value("segment", "c_mktsegment"))))
    named = lambda name, label: F.struct(F.lit(name).alias("field_name"), F.lit(label).alias("label"))
    rule = lambda name, i, pattern: F.struct(
        F.lit(name).alias("field_name"), F.lit(f"{name}:{i}").alias("rule_id"), F.lit("regex").alias("rule_type"),
        FD.rule_params(pattern=F.lit(pattern)).alias("params"), F.lit(None).cast("string").alias("message"), F.lit("warning").alias("severity"))
    one = c.select("template_id").distinct()
    fields = one.select("template_id", F.inline(F.array(named("name", "Name"), named("segment", "Segment"))))
    rules = one.select("template_id", F.inline(F.array(
        rule("name", 1, r"(?s)Customer.\d*[02468]"), rule("name", 2, "(?m)Cust"), rule("segment", 1, "[z-a]"), rule("segment", 2, "(?i)[a-m].*"))))
    return VA.validate(context, fields, rules).select("request_id", "rule_id", "severity", "message")


def twice_judged(spark, d):
    """Two verdicts on each first difference: the later severity, both reasons."""
    r = _judgeable(spark, d)
    first = r.where(F.size("differences") > 0).select("group_id", "doc_id", F.lit(0).alias("index"))
    verdict = lambda ord, severity, material: first.withColumns({
        "ord": F.lit(ord), "severity": F.lit(severity), "material": F.lit(material), "rationale": F.lit(f"reason {ord}")})
    j = K.apply_verdicts(r, verdict(2, "info", False).unionByName(verdict(1, "error", True)).unionByName(verdict(3, "odd", True)))
    sem = F.get(F.filter("dimensions", lambda x: x["name"] == "semantic"), F.lit(0))["score"]
    d0 = F.get("differences", F.lit(0))
    return j.select("doc_id", sem.alias("semantic"), d0["severity"].alias("severity"), F.coalesce(d0["message"].endswith(". reason 1. reason 2. reason 3"), F.lit(False)).alias("folded"))


QUERIES = {
    f.__name__: f
    for f in (form_compliance, compliance_differences, compliance_alignment, actionable_rows, judged_compliance,
              repaired_forms, order_issues, order_status, pattern_issues, twice_judged)
}

_PCT = int(SequenceMatcher(None, ALTERED, S.FORM_TERMS).ratio() * 100)
_HSIM = SequenceMatcher(None, " | ".join(OTHER_HEADERS).lower(), " | ".join(S.FORM_HEADERS).lower()).ratio()
assert _PCT < 90 and _HSIM < 0.8
_T60, _T120 = S.FORM_TERMS[:60], S.FORM_TERMS[:120]
_C60, _C120 = S.FORM_CLAUSE[:60], S.FORM_CLAUSE[:120]

#: Received forms: base(k, g, m, n, big) and their differences diff(...)
_DIFF = f"""WITH base AS (
  SELECT o_orderkey AS k, o_orderpriority AS g, strftime(o_orderdate, '%m') AS m, o_totalprice > {S.CLAUSE_ABOVE} AS big, c_name, o_orderstatus,
         strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice, coalesce(n, 0) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
), diff AS (
  SELECT k, 6 AS pos, 'missing_fixed' AS kind, NULL AS field_name, 'error' AS severity, '{_C120}' AS expected, NULL AS found, 'Expected fixed content is missing: “{_C60}”' AS message, 'structure' AS dim, 1.0 AS lost FROM base WHERE NOT big
  UNION ALL SELECT k, 11, 'changed_fixed', NULL, 'warning', '{_T120}', '{ALTERED}', 'Fixed content was modified (similarity {_PCT}%).', 'structure', 0.7 FROM base WHERE m = '01'
  UNION ALL SELECT k, 11, 'missing_fixed', NULL, 'error', '{_T120}', NULL, 'Expected fixed content is missing: “{_T60}”', 'structure', 1.0 FROM base WHERE m = '02'
  UNION ALL SELECT k, 4, 'format', 'order_date', 'warning', NULL, 'n/a', '''Order Date'' should be a valid date', 'fields', 1.0 FROM base WHERE m = '03'
  UNION ALL SELECT k, 3, 'missing_field', 'customer_name', 'error', NULL, NULL, 'Required field “customer_name” has no value.', 'fields', 2.0 FROM base WHERE m = '04'
  UNION ALL SELECT k, 8, 'missing_table', 'line_items', 'error', NULL, NULL, 'Expected table “line_items” is missing.', 'tables', 2.0 FROM base WHERE m = '05'
  UNION ALL SELECT k, 8, 'table_shape', 'line_items', 'warning', NULL, NULL, 'Table “line_items” has no data rows.', 'tables', 1.0 FROM base WHERE m <> '05' AND n = 0
  UNION ALL SELECT k, 8, 'table_shape', 'line_items', 'warning', 'Part, Quantity, Price', 'Article, Units, Cost', 'Table “line_items” columns differ from the template.', 'tables', 1.0 FROM base WHERE m = '06' AND n > 0
), tot AS (SELECT base.k, g, m, coalesce(sum(lost) FILTER (dim = 'structure'), 0) AS ls, coalesce(sum(lost) FILTER (dim = 'fields'), 0) AS lf,
   coalesce(sum(lost) FILTER (dim = 'tables'), 0) AS lt, coalesce(bool_or(kind IN ('changed_fixed', 'missing_fixed')), false) AS fixable,
   count(kind) AS nd, count(*) FILTER (kind LIKE 'missing%') AS nm FROM base LEFT JOIN diff ON diff.k = base.k GROUP BY ALL
), sc AS (SELECT *, round((100 * (17 - ls - lf - lt) / 17)::DOUBLE, 1) AS score FROM tot)"""

ORACLES = {
    "form_compliance": f"""{_DIFF} SELECT g AS group_id, k::VARCHAR AS doc_id, score, CASE WHEN score >= 90 THEN 'pass' WHEN score >= 70 THEN 'warning' ELSE 'fail' END AS grade, fixable,
        round((100 * (5 - ls) / 5)::DOUBLE, 1) AS structure, round((100 * (10 - lf) / 10)::DOUBLE, 1) AS fields, round((100 * (2 - lt) / 2)::DOUBLE, 1) AS tables,
        CASE WHEN m = '04' THEN 'order_number,order_date,status,total_due' ELSE 'order_number,customer_name,order_date,status,total_due' END AS matched,
        CASE WHEN m = '04' THEN 'customer_name' ELSE '' END AS missing FROM sc""",
    "compliance_differences": f"{_DIFF} SELECT k::VARCHAR AS doc_id, kind, field_name, severity, expected, found, message FROM diff",
    "compliance_alignment": f"""{_DIFF}, a AS (
        SELECT g, 'FIXED' AS classification, 'match' AS status, 'info' AS severity, NULL AS field_name, 3 + big::INT + (m NOT IN ('01','02'))::INT AS n FROM base
        UNION ALL SELECT g, 'FIXED', 'changed', 'warning', NULL, 1 FROM base WHERE m = '01'
        UNION ALL SELECT g, 'FIXED', 'missing', 'error', NULL, (NOT big)::INT + (m = '02')::INT FROM base
        UNION ALL SELECT g, 'DYNAMIC_NUMBER', 'field', 'info', unnest(['order_number', 'total_due']), 1 FROM base
        UNION ALL SELECT g, 'DYNAMIC_DATE', 'field', 'info', 'order_date', 1 FROM base
        UNION ALL SELECT g, 'DYNAMIC_TEXT', 'field', 'info', 'status', 1 FROM base
        UNION ALL SELECT g, 'DYNAMIC_TEXT', CASE WHEN m = '04' THEN 'field_missing' ELSE 'field' END, CASE WHEN m = '04' THEN 'error' ELSE 'info' END, 'customer_name', 1 FROM base
        UNION ALL SELECT g, 'REPEATABLE_TABLE', CASE m WHEN '05' THEN 'missing_table' WHEN '06' THEN 'table_changed' ELSE 'table' END, CASE m WHEN '05' THEN 'error' WHEN '06' THEN 'warning' ELSE 'info' END, 'line_items', 1 FROM base)
        SELECT g AS group_id, classification, status, severity, field_name, sum(n)::BIGINT AS n FROM a GROUP BY ALL HAVING sum(n) > 0""",
    "actionable_rows": f"""{_DIFF} SELECT 'changed' AS status, lower('{S.FORM_TERMS}') AS highlight_left, count(*) AS n FROM base WHERE m = '01'
        UNION ALL SELECT 'missing', lower('{S.FORM_TERMS}'), count(*) FROM base WHERE m = '02'
        UNION ALL SELECT 'missing', lower('{S.FORM_CLAUSE}'), count(*) FROM base WHERE NOT big
        UNION ALL SELECT 'field_missing', 'customer name: ' || lower(r), count(*) FROM (SELECT b.*, first_value(c_name) OVER (PARTITION BY g ORDER BY NOT big, k) AS r FROM base b) WHERE m = '04' GROUP BY 2""",
    "pattern_issues": """WITH c AS (SELECT c_custkey AS request_id, unnest([
          {'rule_id': 'name:1', 'ok': regexp_full_match(c_name, 'Customer.[0-9]*[02468]'), 'f': 'Name'}, {'rule_id': 'name:2', 'ok': false, 'f': 'Name'},
          {'rule_id': 'segment:1', 'ok': NULL, 'f': 'Segment'}, {'rule_id': 'segment:2', 'ok': regexp_matches(lower(c_mktsegment), '^[a-m]'), 'f': 'Segment'}], recursive := true) FROM customer)
        SELECT request_id, rule_id, CASE WHEN ok IS NULL THEN 'error' ELSE 'warning' END AS severity,
          CASE WHEN ok IS NULL THEN 'Rule pattern of ''Segment'' cannot be read' ELSE '''' || f || ''' does not match the required format' END AS message
        FROM c WHERE ok IS NOT true""",
    # Severity "odd" is not one, so the second verdict's stays; two of three were material.
    "twice_judged": f"""{_DIFF} SELECT k::VARCHAR AS doc_id, CASE WHEN nd > 0 THEN 33.3::DOUBLE END AS semantic,
        CASE WHEN nd > 0 THEN 'info' END AS severity, nd > 0 AS folded FROM sc""",
    "judged_compliance": f"""{_DIFF} SELECT k::VARCHAR AS doc_id, score, CASE WHEN nd > 0 THEN round(100 * (1 - nm / nd), 1) END AS semantic, nd AS n_differences,
        CASE WHEN nd > 0 THEN 'error' ELSE '' END AS severities FROM sc""",
    "repaired_forms": f"""{_DIFF} SELECT k::VARCHAR AS doc_id, (NOT big)::BIGINT + (m IN ('01', '02'))::BIGINT AS n_fixed, md5(array_to_string(list_filter([
        'paragraph:{S.FORM_TITLE}', 'paragraph:Order Number: ' || k, 'paragraph:Customer Name: ' || CASE WHEN m = '04' THEN '' ELSE c_name END,
        'paragraph:Order Date: ' || CASE WHEN m = '03' THEN 'n/a' ELSE day END, 'paragraph:Status: ' || o_orderstatus, 'paragraph:{S.FORM_CLAUSE}',
        'heading:Line Items', CASE WHEN m <> '05' THEN 'table:' END, 'paragraph:Total Due: $' || o_totalprice::DECIMAL(18,2)::VARCHAR, 'heading:Terms', 'paragraph:{S.FORM_TERMS}'
        ], lambda x: x IS NOT NULL), chr(10))) AS blocks_md5 FROM base""",
}
_ISSUES = """WITH li AS (SELECT l_orderkey AS k, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem),
  v AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice AS p, CASE WHEN o_totalprice < 5000 THEN 'none' ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END AS t FROM orders),
  iss AS (
   SELECT k AS request_id, 'order_date:date_format' AS rule_id, 'warning' AS severity, '''Order Date'' is not a recognizable date' AS message, 'Use a date like 01/06/2026.' AS fix FROM v WHERE st = 'P'
   UNION ALL SELECT k, 'total_due:numeric_format', 'warning', '''Total Due'' is not numeric', 'Enter a number for ''Total Due''.' FROM v WHERE t = 'none'
   UNION ALL SELECT k, 'total_due:max_length', 'info', '''Total Due'' must be at most 8 characters', 'Shorten ''Total Due'' to 8 characters or fewer.' FROM v WHERE length(t) > 8
   UNION ALL SELECT k, 'status:required', 'error', '''Status'' is required', 'Provide a value for ''Status''.' FROM v WHERE st = 'F'
   UNION ALL SELECT k, 'status:enum', 'error', '''Status'' must be one of: O, F', 'Choose one of: O, F.' FROM v WHERE st = 'P'
   UNION ALL SELECT k, 'line_items:table_schema', 'warning', 'Row ' || rn || ' of ''Line Items'' is missing required column ''quantity''', '' FROM li WHERE l_quantity > 49
   UNION ALL SELECT k, 'line_items:table_schema', 'info', 'Row ' || rn || ' of ''Line Items'' has unexpected column ''note''', 'Allowed columns: part, price, quantity.' FROM li WHERE l_quantity > 49)"""
ORACLES["order_issues"] = _ISSUES + " SELECT request_id, rule_id, severity, count(*) AS n, min(message) AS first_message, max(fix) AS fix FROM iss GROUP BY ALL"
ORACLES["order_status"] = _ISSUES + """ SELECT v.k AS request_id, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info,
  CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'fail' WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'warning' ELSE 'pass' END AS status
  FROM v LEFT JOIN iss ON request_id = v.k GROUP BY v.k"""
