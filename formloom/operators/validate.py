"""Checking values against rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.functions import text as X
from formloom.functions import values as N

#: Shape of one finding.
ISSUE = "struct<severity:string,message:string,suggested_fix:string>"


def _issue(severity: Column, message: Column, fix: Column | str = "") -> Column:
    return F.struct(
        severity.alias("severity"), message.alias("message"),
        (F.lit(fix) if isinstance(fix, str) else fix).alias("suggested_fix"),
    )


def rule_failure(rule: Column, label: Column, value: Column) -> Column:
    """The finding of one scalar rule on a non-empty text value, else null.

    ``rule`` is a struct ``(rule_type, params, message, severity)``; works on a
    column and inside an array lambda alike."""
    kind, p = rule["rule_type"], rule["params"]
    quoted = F.concat(F.lit("'"), label, F.lit("'"))

    def found(message: Column, fix: Column | str = "") -> Column:
        return _issue(rule["severity"], F.coalesce(F.nullif(rule["message"], F.lit("")), message), fix)

    n = F.length(value)
    allowed = F.array_join(p["allowed"], ", ")
    return (
        F.when((kind == "date_format") & ~N.is_valid_date(value, p["formats"]),
               found(F.concat(quoted, F.lit(" is not a recognizable date")),
                     F.concat(F.lit("Use a date like "), _sample_date(p["formats"]), F.lit("."))))
        .when((kind == "numeric_format") & N.parse_number(value).isNull(),
              found(F.concat(quoted, F.lit(" is not numeric")), F.concat(F.lit("Enter a number for "), quoted, F.lit("."))))
        .when((kind == "enum") & (F.size(p["allowed"]) > 0) & ~F.array_contains(p["allowed"], value),
              found(F.concat(quoted, F.lit(" must be one of: "), allowed), F.concat(F.lit("Choose one of: "), allowed, F.lit("."))))
        .when((kind == "min_length") & (n < F.coalesce(p["min"], F.lit(0))),
              found(F.concat(quoted, F.lit(" must be at least "), p["min"].cast("string"), F.lit(" characters"))))
        .when((kind == "max_length") & (F.coalesce(p["max"], F.lit(0)) > 0) & (n > p["max"]),
              found(F.concat(quoted, F.lit(" must be at most "), p["max"].cast("string"), F.lit(" characters")),
                    F.concat(F.lit("Shorten "), quoted, F.lit(" to "), p["max"].cast("string"), F.lit(" characters or fewer."))))
    )


def _sample_date(formats: Column) -> Column:
    first = F.coalesce(F.get(formats, F.lit(0)), F.lit("%Y-%m-%d"))
    return (
        F.when(first == "%d/%m/%Y", "01/06/2026").when(first == "%m/%d/%Y", "06/01/2026")
        .when(first == "%B %d, %Y", "June 01, 2026").otherwise("2026-06-01")
    )


def table_failures(rule: Column, label: Column, rows: Column) -> Column:
    """Findings of a table rule: missing required cells and unexpected columns,
    row by row."""
    p = rule["params"]
    quoted = F.concat(F.lit("'"), label, F.lit("'"))
    allowed = F.coalesce(p["columns"], F.array().cast("array<string>"))

    def per_row(row: Column, i: Column) -> Column:
        head = F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(" of "), quoted)
        missing = F.transform(
            F.filter(p["required_columns"], lambda c: X.is_blank(F.try_element_at(row, c))),
            lambda c: _issue(rule["severity"], F.concat(head, F.lit(" is missing required column '"), c, F.lit("'"))),
        )
        extra = F.transform(
            F.filter(F.map_keys(row), lambda k: (F.size(allowed) > 0) & ~F.array_contains(allowed, k)),
            lambda k: _issue(
                F.lit("info"), F.concat(head, F.lit(" has unexpected column '"), k, F.lit("'")),
                F.concat(F.lit("Allowed columns: "), F.array_join(F.array_sort(allowed), ", "), F.lit(".")),
            ),
        )
        none = F.array().cast(f"array<{ISSUE}>")
        return F.concat(F.coalesce(missing, none), F.coalesce(extra, none))

    return F.flatten(F.transform(rows, per_row))


def validate(context: DataFrame, fields: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of every rule on every request.

    ``context(request_id, template_id, field_name, value, rows)``; ``fields`` and
    ``rules`` are keyed by ``template_id``.  A request takes part when it has at
    least one context row (or appears with a null field name).
    Returns ``request_id, template_id, field_name, rule_id, severity, message,
    suggested_fix``.
    """
    labelled = rules.join(
        fields.select("template_id", "field_name", "label"), ["template_id", "field_name"], "left"
    ).select(
        "template_id", F.struct("field_name", F.coalesce("label", "field_name").alias("label"), "rule_id",
                                F.struct("rule_type", "params", "message", "severity").alias("rule")).alias("d"),
    )
    # A template's rules and a request's values are few, so both travel as arrays: the
    # values are grouped once, and every rule is checked within the request's row.
    due = labelled.groupBy("template_id").agg(F.collect_list("d").alias("due"))
    given = F.when(F.col("field_name").isNotNull(), F.struct("field_name", "value", "rows"))
    packed = context.groupBy("request_id", "template_id").agg(F.collect_list(given).alias("given"))

    def checks(d: Column) -> Column:
        """One check for each value of the rule's field, one of nothing where it has none."""
        own = F.filter("given", lambda g: g["field_name"] == d["field_name"])
        nothing = F.array(F.lit(None).cast(context.select(F.struct("field_name", "value", "rows").alias("g")).schema["g"].dataType))
        return F.transform(F.when(F.size(own) > 0, own).otherwise(nothing), lambda g: F.struct(
            d.alias("d"), g["value"].alias("value"), g["rows"].alias("rows")))

    checked = packed.join(due, "template_id").select(
        "request_id", "template_id", F.flatten(F.transform("due", checks)).alias("checks"))
    pattern = F.transform("checks", lambda c: F.when(c["d"]["rule"]["rule_type"] == "regex", F.nullif(c["d"]["rule"]["params"]["pattern"], F.lit(""))))
    # Values without a pattern, and requests without any, stay out of Python.
    some = F.exists(pattern, lambda p: p.isNotNull())
    matched = checked.withColumn("matches", pattern_matches(F.when(some, pattern), F.when(some, F.transform(
        F.arrays_zip(F.col("checks").alias("c"), pattern.alias("p")), lambda z: F.when(z["p"].isNotNull(), z["c"]["value"])))))
    issues = F.flatten(F.transform("checks", lambda c, i: F.transform(
        _findings(c["d"]["rule"], c["d"]["label"], c["value"], c["rows"], F.get("matches", i)),
        lambda issue: F.struct(c["d"]["field_name"].alias("field_name"), c["d"]["rule_id"].alias("rule_id"), issue.alias("issue")))))
    return matched.select("request_id", "template_id", F.explode(issues).alias("x")).select(
        "request_id", "template_id", "x.field_name", "x.rule_id", "x.issue.*")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _matched(patterns: pd.Series, values: pd.Series) -> pd.Series:
    def one(p: str | None, v: str | None) -> str | None:
        if p is None:
            return None
        try:
            return "yes" if re.fullmatch(p, v or "") else "no"
        except (re.error, RecursionError, OverflowError):
            return "bad"

    return pd.Series(
        [None if ps is None else [one(p, v) for p, v in zip(ps, vs)] for ps, vs in zip(patterns, values)], dtype="object")


def pattern_matches(patterns: Column, values: Column) -> Column:
    """Whole-value matches of two ``ARRAY<STRING>`` columns: yes, no, or bad for a
    pattern that does not compile; null without a pattern."""
    return _matched(patterns, values)


def pattern_failure(rule: Column, label: Column, match: Column) -> Column:
    """The finding of a regex rule whose answer is ``match``, else null."""
    quoted = F.concat(F.lit("'"), label, F.lit("'"))
    return F.when(match == "bad", _issue(F.lit("error"), F.concat(F.lit("Rule pattern of "), quoted, F.lit(" cannot be read")))).when(
        match == "no", _issue(rule["severity"], F.coalesce(
            F.nullif(rule["message"], F.lit("")), F.concat(quoted, F.lit(" does not match the required format")))))


def _findings(rule: Column, label: Column, value: Column, rows: Column, match: Column) -> Column:
    """What one rule finds in one value, as an array."""
    kind = rule["rule_type"]
    empty = F.when(rows.isNotNull(), F.size(rows) == 0).otherwise(X.is_blank(value))
    quoted = F.concat(F.lit("'"), label, F.lit("'"))
    single = (
        F.when((kind == "required") & empty, _issue(
            rule["severity"], F.coalesce(F.nullif(rule["message"], F.lit("")), F.concat(quoted, F.lit(" is required"))),
            F.concat(F.lit("Provide a value for "), quoted, F.lit("."))))
        .when((kind == "required") | empty, None)
        .when(match.isin("bad", "no"), pattern_failure(rule, label, match))
        .when((kind == "table_schema") & rows.isNull(), _issue(
            rule["severity"], F.concat(quoted, F.lit(" must be a list of rows")), "Provide rows as a list of objects."))
        .otherwise(rule_failure(rule, label, value))
    )
    many = F.when((kind == "table_schema") & ~empty & rows.isNotNull(), table_failures(rule, label, rows))
    return F.concat(
        F.array_compact(F.array(single)).cast(f"array<{ISSUE}>"),
        F.coalesce(many, F.array().cast(f"array<{ISSUE}>")),
    )


def issue_summary(requests: DataFrame, issues: DataFrame) -> DataFrame:
    """Per request: findings per severity (all three) and the overall status."""
    per = issues.groupBy("request_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("error", "warning", "info")]
    )
    out = requests.select("request_id").distinct().join(per, "request_id", "left").na.fill(0)
    return out.withColumn(
        "status", F.when(F.col("n_error") > 0, "fail").when(F.col("n_warning") > 0, "warning").otherwise("pass")
    )


def field_value_problem(field_type: Column, enum_values: Column, value: Column) -> Column:
    """Reason a value does not suit its field's type, null when it does."""
    v = F.coalesce(value, F.lit(""))
    return (
        F.when((field_type == "date") & ~N.normalize_date(v)["ok"], "not a recognizable date")
        .when((field_type == "number") & ~N.normalize_number(v)["ok"], "not numeric")
        .when(
            (field_type == "enum") & (F.size(enum_values) > 0) & ~F.array_contains(enum_values, v),
            F.concat(F.lit("must be one of ["), F.array_join(F.transform(enum_values, lambda e: F.concat(F.lit("'"), e, F.lit("'"))), ", "), F.lit("]")),
        )
    )


def flag_invalid(placements: DataFrame, fields: DataFrame) -> DataFrame:
    """Values that fail the check drop to at most 0.3 confidence and say why."""
    f = fields.select("template_id", "field_name", F.col("field_type").alias("_type"), F.col("enum_values").alias("_enum"))
    j = placements.join(f, ["template_id", "field_name"], "left")
    problem = F.when(~F.coalesce(F.col("value") == "", F.lit(True)), field_value_problem(F.col("_type"), F.col("_enum"), F.col("value")))
    j = j.withColumn("_problem", problem)
    note = F.concat(F.lit("Needs review — "), F.col("_problem"), F.lit("."))
    bad = F.col("_problem").isNotNull()
    return j.withColumn("confidence", F.when(bad, F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence"))).withColumn(
        "note", F.when(bad, X.strip(F.concat_ws(" ", F.nullif("note", F.lit("")), note))).otherwise(F.col("note"))
    ).withColumn("flagged", bad).drop("_type", "_enum", "_problem")
