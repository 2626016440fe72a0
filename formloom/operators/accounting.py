"""Token and cost accounting, quotas, retention, recovery, audit, purging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom import vocabulary as V
from formloom.functions import text as X
from formloom.session import stage

STUCK_MESSAGE = "Interrupted by a server restart."


# -- prices --------------------------------------------------------------------
def prices(spark: SparkSession) -> DataFrame:
    """The fixed price list (22 rows)."""
    rows = [(m, i, o) for m, (i, o) in V.MODEL_PRICES.items()]
    return spark.createDataFrame(rows, "known string, in_rate double, out_rate double")


def price_lookup(usage: DataFrame, price_list: DataFrame) -> DataFrame:
    """Add ``in_rate, out_rate`` of a model: its own price, else that of the
    longest known name it starts with, else null.

    Distinct models are priced once; the fixed list is the only broadcast side.
    """
    models = usage.select("model").distinct()
    hit = models.join(
        F.broadcast(price_list), F.startswith(F.lower(X.strip("model")), F.col("known")), "left"
    ).groupBy("model").agg(
        F.max_by(F.struct("in_rate", "out_rate"), F.length("known")).alias("p")
    ).select("model", "p.in_rate", "p.out_rate")
    return usage.join(hit, "model", "left")


def call_cost(n_in: Column, n_out: Column, in_rate: Column, out_rate: Column) -> Column:
    """Rounded half-up to a millionth, computed in decimals so ties are exact."""
    exact = n_in * in_rate.cast("decimal(10,4)") + n_out * out_rate.cast("decimal(10,4)")
    return F.round(exact / 1000000, 6).cast("double")


def usage_by_model(calls: DataFrame, keys: list[str]) -> DataFrame:
    """``keys + model``: tokens in and out, calls, cost (null when unpriced)."""
    spark = calls.sparkSession
    per = calls.withColumn("model", F.coalesce("model", F.lit("?"))).groupBy(*keys, "model").agg(
        F.sum(F.coalesce("in_tokens", F.lit(0))).alias("in_tokens"),
        F.sum(F.coalesce("out_tokens", F.lit(0))).alias("out_tokens"), F.count(F.lit(1)).alias("calls"),
    )
    priced = price_lookup(per, prices(spark))
    return priced.withColumn("cost_usd", call_cost(*(F.col(c) for c in ("in_tokens", "out_tokens", "in_rate", "out_rate")))).drop(
        "in_rate", "out_rate")


def usage_rollup(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per action: totals, cost (unpriced models count nothing; null when no
    model is priced) and the per-model map."""
    per = usage_by_model(calls, keys)
    return per.groupBy(*keys).agg(
        F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.sum("calls").alias("calls"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            "model", F.struct(F.col("in_tokens").alias("in"), F.col("out_tokens").alias("out"), "calls").alias("u"))))).alias("by_model"),
    )


def merge_usage(a: Column, b: Column) -> Column:
    """Sum of two usage structs ``(in, out, calls, cost_usd, by_model)``, model by model."""
    zero = F.lit(0)

    def add(field: str) -> Column:
        return (F.coalesce(a[field], zero) + F.coalesce(b[field], zero)).alias(field)

    def both(_k: Column, x: Column, y: Column) -> Column:
        return F.struct(*[(F.coalesce(x[f], zero) + F.coalesce(y[f], zero)).alias(f) for f in ("in", "out", "calls")])

    empty = F.create_map().cast("map<string,struct<in:bigint,out:bigint,calls:bigint>>")
    models = F.map_zip_with(F.coalesce(a["by_model"], empty), F.coalesce(b["by_model"], empty), both)
    cost = F.when(a["cost_usd"].isNull() & b["cost_usd"].isNull(), None).otherwise(
        F.coalesce(a["cost_usd"], F.lit(0.0)) + F.coalesce(b["cost_usd"], F.lit(0.0)))
    return F.struct(add("in"), add("out"), add("calls"), cost.alias("cost_usd"), models.alias("by_model"))


def token_totals(*tables: DataFrame) -> DataFrame:
    """Lifetime totals per owner over several action tables, each with
    ``owner_id, in_tokens, out_tokens, cost_usd``; actions without usage do not count."""
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t, allowMissingColumns=True)
    used = (F.coalesce("in_tokens", F.lit(0)) + F.coalesce("out_tokens", F.lit(0))) > 0
    return merged.groupBy("owner_id").agg(
        F.sum(F.coalesce("in_tokens", F.lit(0))).alias("in_tokens"), F.sum(F.coalesce("out_tokens", F.lit(0))).alias("out_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count_if(used).alias("actions"),
    )


# -- plans and quotas ------------------------------------------------------------
def _has_own() -> Column:
    return F.coalesce(F.col("enabled"), F.lit(False)) & ~X.is_blank("api_key")


def resolve_ai_plan(owners: DataFrame, configs: DataFrame, *, free_enabled: bool, free_limit: int,
                    global_active: bool, allow_free: bool = True) -> DataFrame:
    """``mode`` per owner: own key first; then the free tier while credits last
    (never for previews), and no fallback behind it; else the global setting."""
    j = owners.join(configs, "owner_id", "left")
    left = F.coalesce("free_used", F.lit(0)) < free_limit
    other = (
        F.when(left & F.lit(allow_free), "free").otherwise("none") if free_enabled
        else F.lit("global" if global_active else "none")
    )
    return j.select("owner_id", F.when(_has_own(), "own").otherwise(other).alias("mode"))


def quota_snapshot(owners: DataFrame, configs: DataFrame, *, free_enabled: bool, free_limit: int) -> DataFrame:
    used = F.coalesce("free_used", F.lit(0))
    return owners.join(configs, "owner_id", "left").select(
        "owner_id", F.lit(free_enabled).alias("free_enabled"), F.lit(free_limit).alias("free_limit"), used.alias("free_used"),
        F.greatest(F.lit(0), F.lit(free_limit) - used).alias("free_remaining"), _has_own().alias("has_own_key"),
    )


# -- retention ---------------------------------------------------------------------
def prune_plan(files: DataFrame, now: Column, max_age_days: int, cap_bytes: int) -> DataFrame:
    """Which files go: ``reason`` ``age`` (older than the limit; unknown times
    stay), then ``size`` - oldest first, unknown times before all, until the rest fits
    under the cap.  A file goes while more than the cap is left with it.

    The running total is global, so the files are dealt out by ranges of time and key:
    the ranges' totals tell which go or stay as a whole, and only ranges that the cap
    falls into are summed file by file.  No task sees more than its own range, however
    many files share a time or have none.  Ties in time go by key.
    """
    mtime = F.coalesce("mtime", F.lit(0.0))
    aged = F.when(
        F.lit(max_age_days > 0) & (mtime > 0) & (now - mtime > max_age_days * 86400), "age"
    )
    marked = files.withColumn("_t", mtime).withColumn("reason", aged)
    old = marked.where(F.col("reason") == "age").drop("_t")
    if not cap_bytes:
        return old
    rest = marked.where(F.col("reason").isNull()).drop("reason")
    dealt = stage(rest.repartitionByRange("_t", "key").withColumn("_range", F.spark_partition_id()), "by-time")
    per = dealt.groupBy("_range").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_size"))  # one row for each range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("_size").over(Window.partitionBy()) - F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    per = per.select("_range", left.alias("_left"), (left - F.col("_size")).alias("_after"))
    placed = dealt.join(F.broadcast(per), "_range").where(F.col("_left") > cap_bytes)
    whole = placed.where(F.col("_after") > cap_bytes)
    inside = Window.partitionBy("_range").orderBy("_t", "key").rowsBetween(Window.unboundedPreceding, -1)
    some = placed.where(F.col("_after") <= cap_bytes).withColumn(
        "_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).where(F.col("_left") - F.col("_before") > cap_bytes)
    gone = whole.select(*files.columns).unionByName(some.select(*files.columns))
    return old.unionByName(gone.withColumn("reason", F.lit("size")))


# -- jobs, audit, accounts -----------------------------------------------------------
def recover_stuck(jobs: DataFrame) -> DataFrame:
    """Active jobs of a stopped process become failed; ``recovered`` tells which."""
    stuck = F.col("status").isin("pending", "running")
    error = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    return jobs.withColumn("recovered", stuck).withColumn("error", F.when(stuck, STUCK_MESSAGE).otherwise(error)).withColumn(
        "status", F.when(F.col("recovered"), "failed").otherwise(F.col("status")))


def audit_rows(decisions: DataFrame) -> DataFrame:
    """Decision-log rows in their stored shape (append these)."""
    return decisions.select("kind", "source", "subject_type", "subject_id", "model_used", F.col("summary").cast("string").alias("summary"))


def audit_report(log: DataFrame) -> DataFrame:
    return log.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n_decisions"), F.count_distinct("subject_id").alias("n_subjects"))


#: Tables with an owner, children by parent id; two log tables are kept on purpose.
OWNED_TABLES = ("generated_documents", "generation_requests", "templates", "analysis_jobs", "source_documents", "projects",
                "ai_decision_logs", "user_ai_configs")
CHILD_TABLES = {"extracted_documents": ("source_documents", "source_document_id"), "template_versions": ("templates", "template_id")}


def purge_owner(tables: dict[str, DataFrame], owner_id) -> tuple[dict[str, DataFrame], DataFrame]:
    """Everything without one owner's rows, plus ``(table, n_removed)``."""
    kept, removed = {}, []
    for name, df in tables.items():
        if name in OWNED_TABLES:
            kept[name] = df.where(~F.col("owner_id").eqNullSafe(F.lit(owner_id)))
            gone = df.where(F.col("owner_id") == owner_id)
        elif name in CHILD_TABLES and CHILD_TABLES[name][0] in tables:
            parent, key = CHILD_TABLES[name]
            mine = tables[parent].where(F.col("owner_id") == owner_id).select(F.col("id").alias(key)).distinct()
            kept[name] = df.join(mine, key, "left_anti")
            gone = df.join(mine, key, "left_semi")
        else:
            kept[name] = df
            continue
        removed.append(gone.agg(F.count(F.lit(1)).alias("n_removed")).select(F.lit(name).alias("table"), "n_removed"))
    counts = removed[0]
    for r in removed[1:]:
        counts = counts.unionByName(r)
    return kept, counts
