"""Usage and cost, quotas, retention, jobs, history, accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common as C
from formloom.operators import accounting as A
from formloom.operators import learning as L
from formloom.operators import records as R

BIG = "bigint"


def _calls(spark, d):
    """Model calls read off the events: type -> model, value and props -> tokens."""
    e = C.table(spark, d, "events")
    model = (
        F.when(F.col("event_type") == "click", "gemini-2.5-flash-lite-preview-09-2025")
        .when(F.col("event_type") == "view", " GPT-4o ").when(F.col("event_type") == "purchase", "gpt-4o-mini-2024")
        .when(F.col("event_type") == "signup", "house-model"))
    return e.select(
        F.col("user_id").alias("owner_id"), model.alias("model"), F.round(F.col("value") * 100).cast(BIG).alias("in_tokens"),
        F.get_json_object("props", "$.k").cast(BIG).alias("out_tokens"), "ts", "event_id")


def model_usage(spark, d):
    return A.usage_by_model(_calls(spark, d), ["owner_id"])


def owner_usage(spark, d):
    r = A.usage_rollup(_calls(spark, d), ["owner_id"])
    return r.select("owner_id", "in_tokens", "out_tokens", "calls", "cost_usd", F.size("by_model").cast(BIG).alias("n_models"),
                    F.try_element_at("by_model", F.lit("?"))["calls"].alias("unnamed_calls"))


def merged_usage(spark, d):
    c = _calls(spark, d)
    def packed(df, name):
        r = A.usage_rollup(df, ["owner_id"])
        return r.select("owner_id", F.struct(F.col("in_tokens").alias("in"), F.col("out_tokens").alias("out"), "calls", "cost_usd", "by_model").alias(name))
    a, b = packed(c.where("in_tokens < 5000"), "a"), packed(c.where("in_tokens >= 5000"), "b")
    m = a.join(b, "owner_id", "full_outer").withColumn("u", A.merge_usage(F.col("a"), F.col("b")))
    return m.select("owner_id", F.col("u.in").alias("in_tokens"), F.col("u.out").alias("out_tokens"), F.col("u.calls").alias("calls"),
                    F.size("u.by_model").cast(BIG).alias("n_models"))


def owner_tokens(spark, d):
    c = _calls(spark, d)
    part = lambda cond: c.where(cond).select("owner_id", "in_tokens", "out_tokens", F.lit(0.001).alias("cost_usd"))
    return A.token_totals(part(F.month("ts") == 1), part(F.month("ts") > 1), part(F.col("in_tokens") == 0)).select(
        "owner_id", "in_tokens", "out_tokens", "actions")


def _owners(spark, d):
    c = C.table(spark, d, "customer")
    configs = c.select(F.col("c_custkey").alias("owner_id"), (F.col("c_acctbal") > 0).alias("enabled"),
                       F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("key-"), "c_name")).otherwise(" ").alias("api_key"),
                       F.floor(F.abs("c_acctbal") / 500).cast("int").alias("free_used")).where("c_mktsegment <> 'FURNITURE'")
    return c.select(F.col("c_custkey").alias("owner_id")), configs


def ai_plans(spark, d):
    o, cfg = _owners(spark, d)
    return A.resolve_ai_plan(o, cfg, free_enabled=True, free_limit=10, global_active=False)


def preview_plans(spark, d):
    o, cfg = _owners(spark, d)
    return A.resolve_ai_plan(o, cfg, free_enabled=True, free_limit=10, global_active=False, allow_free=False)


def quotas(spark, d):
    o, cfg = _owners(spark, d)
    return A.quota_snapshot(o, cfg, free_enabled=True, free_limit=10).withColumn("free_used", F.col("free_used").cast(BIG)).withColumn(
        "free_remaining", F.col("free_remaining").cast(BIG)).withColumn("free_limit", F.col("free_limit").cast(BIG))


def prune_files(spark, d):
    e = C.table(spark, d, "events")
    files = e.select(F.col("event_id").alias("key"), F.round(F.col("value") * 1000).cast(BIG).alias("size"),
                     F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("mtime"))
    now = F.lit(1706745600.0)  # 2024-02-01
    return A.prune_plan(files, now, 14, 50 * 1024 * 1024).select("key", "size", "reason")


def recovered_jobs(spark, d):
    o = C.table(spark, d, "orders")
    jobs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "running")
                    .when(F.col("o_orderstatus") == "O", "pending").otherwise("completed").alias("status"))
    return A.recover_stuck(jobs)


def audit_counts(spark, d):
    e = C.table(spark, d, "events")
    rows = A.audit_rows(e.select(F.col("event_type").alias("kind"), F.when(F.col("value") > 10, "writer").otherwise("heuristic").alias("source"),
                                 F.lit("user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"),
                                 F.lit(None).cast("string").alias("model_used"), F.col("props").alias("summary")))
    return A.audit_report(rows)


def latest_shipments(spark, d):
    """Newest line of each order as its latest output."""
    o = C.table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"))
    li = C.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_shipdate").alias("created_at"),
                                              (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("output_id"))
    return R.latest_output(o, li)


def project_members(spark, d):
    """Nations as projects, their customers as templates."""
    n = C.table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    t = C.table(spark, d, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("template_id"))
    return R.project_templates(n, t).select("project_id", "name", "template_id")


def projects_overview(spark, d):
    n = C.table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"))
    t = C.table(spark, d, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("created_at"))
    return R.project_with_templates(n, t)


def inherited_context(spark, d):
    """Order values over customer defaults (market segment, balance)."""
    o = C.table(spark, d, "orders")
    req = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("project_id"))
    ctx = o.select(F.col("o_orderkey").alias("request_id"), F.inline(F.array(
        F.struct(F.lit("status").alias("field_name"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("segment").alias("field_name"), F.when(F.col("o_orderstatus") == "F", "FULFILLED").alias("value"))
    ))).withColumn("rows", F.lit(None).cast("array<map<string,string>>"))
    meta = C.table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.inline(F.array(
        F.struct(F.lit("segment").alias("field_name"), F.col("c_mktsegment").alias("value")),
        F.struct(F.lit("customer").alias("field_name"), F.col("c_name").alias("value")))))
    return R.inherit_project_meta(ctx, req, meta).select("request_id", "field_name", "value")


def error_log(spark, d):
    e = C.table(spark, d, "events")
    logs = e.select(F.col("event_id").alias("log_id"), "ts", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
                    F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" "), "event_type").alias("message"),
                    F.concat(F.lit("app."), "event_type").alias("logger"))
    return R.search_log(logs, "ERROR", "user 1").select("log_id", "message")


def log_tail(spark, d):
    e = C.table(spark, d, "events")
    logs = e.select(F.col("event_id").alias("log_id"), "ts", F.col("event_type").alias("message"))
    return R.tail_logs(logs, 200).select("log_id", "message")


def recent_orders(spark, d):
    o = C.table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_orderpriority").alias("owner_id"), F.col("o_orderdate").alias("created_at"))
    return R.list_recent(o, "1-URGENT").select("o_orderkey", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


def draft_edits(spark, d):
    """Each turn against the next one of its conversation, as a draft and its edit."""
    c = C.wide(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), "conv_id", "turn", "role", "text").dropDuplicates()
    prior = c.select("request_id", F.col("role").alias("field_name"), F.col("turn").alias("ord"), F.col("text").alias("value"), "conv_id", "turn")
    nxt = c.select(F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("request_id"), F.col("text").alias("value"))
    final = prior.select("request_id", "field_name").join(nxt, "request_id")
    return L.edit_summaries(prior, final).select("request_id", "field_name", F.md5("summary").alias("summary_md5"))


def learned_lines(spark, d):
    """Newest lines of each role and conversation, as guidance."""
    c = C.wide(spark, d, "conversations").select("conv_id", "turn", "role", "text").distinct().select(
        F.col("conv_id").alias("owner_id"), F.col("role").alias("kind"), F.timestamp_seconds("turn").alias("created_at"), F.col("text").alias("summary"))
    return L.fewshot_lines(c, ["owner_id", "kind"]).select("owner_id", "kind", F.size("lines").cast(BIG).alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("lines_md5"))


def stored_corrections(spark, d):
    li = C.table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).otherwise(" ").alias("summary"))
    return L.record_corrections(li, ["l_orderkey"], "ord", 3)


def retyped_parts(spark, d):
    """Parts as classified nodes, before and after a price-driven edit."""
    p = C.table(spark, d, "part").select(F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("node_id"), "p_size", "p_retailprice",
        F.lit("DYNAMIC_TEXT").alias("classification"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("field_name"), F.lit("text").alias("field_type"), F.lit("Part: ").alias("static_prefix"))
    final = p.withColumn("classification", F.when(F.col("p_size") > 40, "FIXED").otherwise(F.col("classification"))).withColumn(
        "field_name", F.when(F.col("p_size") < 10, F.concat("field_name", F.lit("_new"))).otherwise(F.col("field_name"))).withColumn(
        "field_type", F.when(F.col("p_retailprice") > 1500, "number").otherwise(F.col("field_type")))
    return L.classification_edits(p, final).select("node_id", "summary")


def purged_owner(spark, d):
    c = C.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("owner_id"))
    o = C.table(spark, d, "orders").select(F.col("o_custkey").alias("template_id"), "o_orderkey")
    s = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("MACHINERY").alias("owner_id"))
    kept, counts = A.purge_owner({"templates": c, "template_versions": o, "source_documents": s, "template_corrections": c}, "MACHINERY")
    left = [df.agg(F.count(F.lit(1)).alias("n_kept")).select(F.lit(n).alias("table"), "n_kept") for n, df in kept.items()]
    total = left[0]
    for x in left[1:]:
        total = total.unionByName(x)
    return total.join(counts, "table", "left")


QUERIES = {f.__name__: f for f in (
    model_usage, owner_usage, merged_usage, owner_tokens, ai_plans, preview_plans, quotas, prune_files, recovered_jobs, audit_counts,
    latest_shipments, projects_overview, project_members, inherited_context, error_log, log_tail, recent_orders, draft_edits, learned_lines,
    stored_corrections, retyped_parts, purged_owner)}

_CALLS = """calls AS (SELECT user_id AS owner_id, CASE event_type WHEN 'click' THEN 'gemini-2.5-flash-lite-preview-09-2025' WHEN 'view' THEN ' GPT-4o ' WHEN 'purchase' THEN 'gpt-4o-mini-2024' WHEN 'signup' THEN 'house-model' ELSE '?' END AS model,
  round(value * 100)::BIGINT AS i, (props->>'$.k')::BIGINT AS o, ts FROM events)"""
_PER = f"""{_CALLS}, per AS (SELECT owner_id, model, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o, count(*) AS n FROM calls GROUP BY ALL),
  priced AS (SELECT *, CASE WHEN model LIKE 'gemini-2.5-flash-lite%' THEN ((i * 10 + o * 40 + 50) // 100) / 1000000.0 WHEN model = ' GPT-4o ' THEN ((i * 250 + o * 1000 + 50) // 100) / 1000000.0
   WHEN model LIKE 'gpt-4o-mini%' THEN ((i * 15 + o * 60 + 50) // 100) / 1000000.0 END::DOUBLE AS cost FROM per)"""
_CFG = """u AS (SELECT c_custkey AS owner_id, c_mktsegment <> 'FURNITURE' AS has, c_mktsegment = 'MACHINERY' AND c_acctbal > 0 AS own,
  CASE WHEN c_mktsegment <> 'FURNITURE' THEN floor(abs(c_acctbal) / 500)::BIGINT ELSE 0 END AS used FROM customer)"""

ORACLES = {
    "model_usage": f"WITH {_PER} SELECT owner_id, model, i AS in_tokens, o AS out_tokens, n AS calls, cost AS cost_usd FROM priced",
    "owner_usage": f"WITH {_PER} SELECT owner_id, sum(i)::BIGINT AS in_tokens, sum(o)::BIGINT AS out_tokens, sum(n)::BIGINT AS calls, round(sum(cost), 6) AS cost_usd, count(*) AS n_models, max(n) FILTER (model = '?') AS unnamed_calls FROM priced GROUP BY owner_id",
    "merged_usage": f"WITH {_CALLS} SELECT owner_id, sum(i)::BIGINT AS in_tokens, sum(o)::BIGINT AS out_tokens, count(*) AS calls, count(DISTINCT model) AS n_models FROM calls GROUP BY owner_id",
    "owner_tokens": f"WITH {_CALLS}, a AS (SELECT * FROM calls UNION ALL SELECT * FROM calls WHERE i = 0) SELECT owner_id, sum(i)::BIGINT AS in_tokens, sum(o)::BIGINT AS out_tokens, count(*) FILTER (i + o > 0) AS actions FROM a GROUP BY owner_id",
    "ai_plans": f"WITH {_CFG} SELECT owner_id, CASE WHEN own THEN 'own' WHEN used < 10 THEN 'free' ELSE 'none' END AS mode FROM u",
    "preview_plans": f"WITH {_CFG} SELECT owner_id, CASE WHEN own THEN 'own' ELSE 'none' END AS mode FROM u",
    "quotas": f"WITH {_CFG} SELECT owner_id, true AS free_enabled, 10::BIGINT AS free_limit, used AS free_used, greatest(0, 10 - used)::BIGINT AS free_remaining, own AS has_own_key FROM u",
    "prune_files": """WITH f AS (SELECT event_id AS key, round(value * 1000)::BIGINT AS size, epoch(date_trunc('second', ts))::DOUBLE AS m FROM events),
        a AS (SELECT *, 1706745600 - m > 14 * 86400 AS aged FROM f),
        r AS (SELECT *, sum(size) OVER () AS total, coalesce(sum(size) OVER (ORDER BY m, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a WHERE NOT aged)
        SELECT key, size, 'age' AS reason FROM a WHERE aged UNION ALL SELECT key, size, 'size' FROM r WHERE total - before > 50 * 1024 * 1024""",
    "recovered_jobs": """SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('P', 'O') THEN 'failed' ELSE 'completed' END AS status, o_orderstatus IN ('P', 'O') AS recovered,
        CASE WHEN o_orderstatus IN ('P', 'O') THEN 'Interrupted by a server restart.' END AS error FROM orders""",
    "audit_counts": "SELECT event_type AS kind, CASE WHEN value > 10 THEN 'writer' ELSE 'heuristic' END AS source, count(*) AS n_decisions, count(DISTINCT user_id) AS n_subjects FROM events GROUP BY ALL",
    "latest_shipments": """WITH r AS (SELECT l_orderkey, l_shipdate, l_partkey * 1000 + l_suppkey AS output_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey * 1000 + l_suppkey DESC) AS rn FROM lineitem)
        SELECT o_orderkey AS request_id, output_id, l_shipdate AS output_at FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND rn = 1""",
    "projects_overview": "SELECT n_nationkey AS project_id, n_name AS name, count(c_custkey) AS n_templates, max(c_custkey) AS last_created FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL",
    "inherited_context": """SELECT o_orderkey AS request_id, 'status' AS field_name, o_orderstatus AS value FROM orders
        UNION ALL SELECT o_orderkey, 'segment', CASE WHEN o_orderstatus = 'F' THEN 'FULFILLED' ELSE c_mktsegment END FROM orders LEFT JOIN customer ON c_custkey = o_custkey
        UNION ALL SELECT o_orderkey, 'customer', c_name FROM orders JOIN customer ON c_custkey = o_custkey""",
    "error_log": "SELECT event_id AS log_id, 'User ' || user_id || ' error' AS message FROM events WHERE event_type = 'error' AND 'user ' || user_id LIKE 'user 1%'",
    "log_tail": "SELECT event_id AS log_id, event_type AS message FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "recent_orders": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderpriority = '1-URGENT'",
    "project_members": "SELECT n_nationkey AS project_id, n_name AS name, c_custkey AS template_id FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey",
    "draft_edits": f"""WITH c AS (SELECT DISTINCT conv_id, turn, role, {C.strip_sql('text')} AS t FROM conversations),
        e AS (SELECT a.conv_id || ':' || a.turn AS request_id, a.role AS field_name, a.t AS was, b.t AS now FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.t <> b.t),
        s AS (SELECT *, length(now) / greatest(length(was), 1) AS r, length(now) - length(replace(now, chr(10), '')) AS nn, length(was) - length(replace(was, chr(10), '')) AS wn,
              trim(regexp_replace(now, '[\\s\\x{{85}}\\x{{a0}}]+', ' ', 'g')) AS flat FROM e)
        SELECT request_id, field_name, md5(CASE WHEN now = '' THEN 'the user cleared "' || field_name || '" — the AI should not have filled it' WHEN was = '' THEN 'the user filled "' || field_name || '" in by hand — the AI left it empty'
        WHEN r <= 0.6 THEN 'the user cut "' || field_name || '" to ' || round(r * 100)::INT || '% of its length — write it more briefly'
        WHEN r >= 1.6 THEN 'the user expanded "' || field_name || '" — write it in more detail than the draft did'
        WHEN nn > wn THEN 'the user broke "' || field_name || '" into more paragraphs or bullets' WHEN nn < wn THEN 'the user merged "' || field_name || '" into fewer blocks'
        ELSE 'the user rewrote "' || field_name || '" (kept: "' || CASE WHEN length(flat) <= 60 THEN flat ELSE rtrim(flat[1:60]) || '…' END || '")' END) AS summary_md5 FROM s""",
    "learned_lines": f"""WITH c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) <= 5),
        l AS (SELECT conv_id, role, turn, unnest(range(len(string_split(text, chr(10))))) AS pos, trim({C.strip_sql("unnest(string_split(text, chr(10)))")}, ' -•' || chr(9)) AS line FROM r),
        f AS (SELECT conv_id, role, line, min((1000000 - turn) * 1000000 + pos) AS seen FROM l WHERE line <> '' GROUP BY ALL),
        k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY seen) <= 8)
        SELECT conv_id AS owner_id, role AS kind, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY seen)) AS lines_md5 FROM k GROUP BY ALL""",
    "stored_corrections": """WITH l AS (SELECT l_orderkey, 'part ' || l_partkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem WHERE l_returnflag <> 'R')
        SELECT l_orderkey, string_agg(s, chr(10) ORDER BY rn) AS summary FROM l WHERE rn <= 3 GROUP BY l_orderkey""",
    "retyped_parts": """WITH p AS (SELECT p_partkey, p_size, p_retailprice, replace(p_name, ' ', '_') AS n FROM part), f AS (SELECT *, CASE WHEN p_size < 10 THEN n || '_new' ELSE n END AS nn FROM p)
        SELECT p_partkey AS node_id, CASE WHEN p_size > 40 THEN 'reclassified "' || nn || '" from DYNAMIC_TEXT to FIXED' WHEN p_size < 10 THEN 'renamed field "' || n || '" to "' || nn || '"'
        ELSE 'set field "' || nn || '" type to number (was text)' END AS summary FROM f WHERE p_size > 40 OR p_size < 10 OR p_retailprice > 1500""",
    "purged_owner": """SELECT 'templates' AS "table", count(*) FILTER (c_mktsegment <> 'MACHINERY') AS n_kept, count(*) FILTER (c_mktsegment = 'MACHINERY') AS n_removed FROM customer
        UNION ALL SELECT 'template_versions', count(*) FILTER (c_mktsegment IS DISTINCT FROM 'MACHINERY'), count(*) FILTER (c_mktsegment = 'MACHINERY') FROM orders LEFT JOIN customer ON c_custkey = o_custkey
        UNION ALL SELECT 'source_documents', 0, count(*) FROM supplier UNION ALL SELECT 'template_corrections', count(*), NULL FROM customer""",
}
