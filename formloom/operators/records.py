"""Joins and lookups over the application's own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom import vocabulary as V
from formloom.functions import text as X
from formloom.session import stage


def join_node(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Lookup by (group, node)."""
    return left.join(right, ["group_id", "node_id"], how)


def evidence_join(elements: DataFrame, diffs: DataFrame, samples: int = 4, chars: int = 80) -> DataFrame:
    """Elements beside their diff evidence, samples few and short."""
    ev = diffs.select(
        "group_id", "node_id", "status", "detected_kind", "static_prefix", "row_count_variable",
        F.transform(F.slice("sample_texts", 1, samples), lambda s: F.substring(s, 1, chars)).alias("samples"),
        F.round("confidence", 2).alias("confidence"),
    )
    return elements.join(ev, ["group_id", "node_id"], "left").withColumn("has_evidence", F.col("status").isNotNull())


def version_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fields added, removed or changed (type or required) between two versions."""
    old = a.select("template_id", "field_name", F.col("field_type").alias("old_type"), F.col("required").alias("old_required"))
    new = b.select("template_id", "field_name", F.col("field_type").alias("new_type"), F.col("required").alias("new_required"))
    changed = ~(F.col("old_type").eqNullSafe(F.col("new_type")) & F.col("old_required").eqNullSafe(F.col("new_required")))
    return old.withColumn("in_a", F.lit(True)).join(new.withColumn("in_b", F.lit(True)), ["template_id", "field_name"], "full_outer").select(
        "template_id", "field_name",
        F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(changed, "changed").alias("change"),
    ).where(F.col("change").isNotNull())


def inherit_project_meta(context: DataFrame, requests: DataFrame, project_meta: DataFrame) -> DataFrame:
    """Project metadata as defaults for each request; its own non-null values
    win, and keys of either side pass through.

    ``context(request_id, field_name, value, rows)``, ``requests(request_id,
    project_id)``, ``project_meta(project_id, field_name, value)``."""
    base = requests.select("request_id", "project_id").join(project_meta, "project_id").select(
        "request_id", "field_name", F.col("value").alias("default_value")
    )
    return context.join(base, ["request_id", "field_name"], "full_outer").select(
        "request_id", "field_name",
        F.when(F.col("rows").isNull(), F.coalesce("value", "default_value")).otherwise(F.col("value")).alias("value"), "rows",
    )


def project_with_templates(projects: DataFrame, templates: DataFrame) -> DataFrame:
    """Each project with how many templates it holds and which (newest first)."""
    held = templates.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_templates"), F.max("created_at").alias("last_created"),
    )
    return projects.join(held, "project_id", "left").withColumn("n_templates", F.coalesce("n_templates", F.lit(0)))


def delete_project(templates: DataFrame, project_id) -> DataFrame:
    """Templates after a project is deleted: its reference becomes null."""
    return templates.withColumn("project_id", F.when(F.col("project_id") != project_id, F.col("project_id")))


def project_templates(projects: DataFrame, templates: DataFrame) -> DataFrame:
    """Each project with its templates as rows, one with nulls where it has none."""
    return projects.join(templates, "project_id", "left")


def latest_output(requests: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each request with its newest output (null when there is none)."""
    newest = outputs.groupBy("request_id").agg(
        F.max_by("output_id", F.struct("created_at", "output_id")).alias("output_id"), F.max("created_at").alias("output_at")
    )
    return requests.join(newest, "request_id", "left")


def list_recent(df: DataFrame, owner_id) -> DataFrame:
    """An owner's rows, newest first."""
    return df.where(F.col("owner_id") == owner_id).orderBy(F.col("created_at").desc())


def search_log(logs: DataFrame, level: str | None = None, query: str | None = None) -> DataFrame:
    """Level equality plus a case-insensitive substring of message or logger."""
    out = logs if not level else logs.where(F.col("level") == level)
    if query:
        q = query.lower()
        out = out.where(F.lower("message").contains(q) | F.lower("logger").contains(q))
    return out


def tail_logs(logs: DataFrame, n: int, owner_id=None) -> DataFrame:
    """The last ``n`` (1..1000) records, in order."""
    kept = max(1, min(1000, n))
    mine = logs if owner_id is None else logs.where(F.col("owner_id") == owner_id)
    return mine.orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(kept).orderBy("ts", "log_id")


def nested_in_looped_table(elements: DataFrame, classified: DataFrame) -> DataFrame:
    """Nodes owned by a looped table: any looped ancestor decides, and row 0 stays
    out (it is the heading row above the loop).

    Ancestors are found by pointer jumping: each round doubles the distance walked,
    all keyed by (document, node), and is written to the shared folder.  Rounds go
    on until no node has an ancestor left to look at, so depth has no limit."""
    keys = ["group_id", "doc_id"]
    looped = classified.where(
        (F.col("classification") == "REPEATABLE_TABLE")
    ).select(*keys, "node_id", F.lit(True).alias("looped"))
    nodes = elements.select(*keys, "node_id", "parent_node_id", "subtype").join(looped, [*keys, "node_id"], "left")
    # For each node: the farthest ancestor reached, whether a looped one lies on the way.
    reach = nodes.where(F.col("parent_node_id").isNotNull()).select(
        *keys, "node_id", "subtype", F.col("parent_node_id").alias("up"))
    tops = nodes.select(*keys, F.col("node_id").alias("up"), F.coalesce("looped", F.lit(False)).alias("up_looped"))
    reach = stage(reach.join(tops, [*keys, "up"], "left").select(
        *keys, "node_id", "subtype", "up", F.coalesce("up_looped", F.lit(False)).alias("hit")), "nesting")
    while True:
        further = reach.select(*keys, F.col("node_id").alias("up"), F.col("up").alias("next_up"), F.col("hit").alias("next_hit"))
        met = reach.join(further, [*keys, "up"], "left")
        if met.where(F.col("next_up").isNotNull()).isEmpty():
            break
        reach = stage(met.select(*keys, "node_id", "subtype", F.coalesce("next_up", "up").alias("up"),
                                 (F.col("hit") | F.coalesce("next_hit", F.lit(False))).alias("hit")), "nesting")
    return reach.where(F.col("hit") & (F.coalesce(X.cell_row("subtype"), F.lit(-1)) != 0)).select(*keys, "node_id")
