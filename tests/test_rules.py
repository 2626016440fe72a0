"""Rules, routing order, verdicts, nesting, repeated blocks, dates: literal cases."""

import pytest
from pyspark.sql import functions as F

from formloom.functions import values as N
from formloom.functions.register import register_functions
from formloom.functions.text import slug
from formloom.operators import compliance as K
from formloom.operators import records as RC
from formloom.operators import render as G
from formloom.operators import routing as R
from formloom.operators import validate as VA
from formloom.operators.fields import rule_params

ROWS = "array<map<string,string>>"


def test_regex_rules(spark):
    patterns = {
        "(?s)a.*b": "yes", "(?m)x": "no", "[z-a]": "bad", "x{5,2}": "bad", "(": "bad", "a\nb": "yes", "a.b": "no", "(?s)a.b": "yes", r"\w\s\w": "yes", "": None,
    }
    context = spark.createDataFrame([("r", "t", "f", "a\nb", None)], f"request_id string, template_id string, field_name string, value string, rows {ROWS}")
    fields = spark.createDataFrame([("t", "f", "F")], "template_id string, field_name string, label string")
    rules = spark.createDataFrame([("t", "f", p, p) for p in patterns], "template_id string, field_name string, rule_id string, p string").select(
        "template_id", "field_name", "rule_id", F.lit("regex").alias("rule_type"), rule_params(pattern=F.col("p")).alias("params"),
        F.lit(None).cast("string").alias("message"), F.lit("warning").alias("severity"))
    found = {r.rule_id: "bad" if "cannot be read" in r.message else "no" for r in VA.validate(context, fields, rules).collect()}
    assert found == {p: v for p, v in patterns.items() if v in ("bad", "no")}


def test_values_met_twice_and_missing_fields(spark):
    context = spark.createDataFrame(
        [("r", "t", "f", "1", None), ("r", "t", "f", "x", None), ("s", "t", None, None, None)],
        f"request_id string, template_id string, field_name string, value string, rows {ROWS}")
    fields = spark.createDataFrame([("t", "f", "F")], "template_id string, field_name string, label string")
    rule = lambda kind: (
        "t", "f", kind, kind, (None, None, None, None, None, None, None), None, "error")
    rules = spark.createDataFrame([rule("required"), rule("numeric_format")], (
        "template_id string, field_name string, rule_id string, rule_type string, params struct<formats:array<string>,allowed:array<string>,"
        "min:int,max:int,pattern:string,columns:array<string>,required_columns:array<string>>, message string, severity string"))
    assert sorted((r.request_id, r.rule_id) for r in VA.validate(context, fields, rules).collect()) == [("r", "numeric_format"), ("s", "required")]


def test_last_placement_wins(spark):
    rows = [("r", "t", "f", "old", None, 1), ("r", "t", "f", "new", None, 2), ("r", "t", "f", None, None, 3)]
    p = spark.createDataFrame(rows, f"request_id string, template_id string, field_name string, value string, rows {ROWS}, ord int")
    assert [r.value for r in R.to_context(p).collect()] == ["new"]
    with pytest.raises(ValueError):
        R.to_context(p.drop("ord"))


def test_verdicts_fold(spark):
    reports = spark.createDataFrame(
        [("g", "d", [("info", "m")], [("x", 1.0, 1.0, 100.0)]), ("h", "d", [("info", "m")], [("x", 1.0, 1.0, 100.0)])],
        "group_id string, doc_id string, differences array<struct<severity:string,message:string>>, dimensions array<struct<name:string,satisfied:double,total:double,score:double>>")
    verdicts = spark.createDataFrame(
        [("g", "d", 0, 2, "info", False, "second"), ("g", "d", 0, 1, "error", True, "first"), ("g", "d", 0, 3, "odd", True, ""), ("g", "d", 9, 1, "error", True, "far")],
        "group_id string, doc_id string, index int, ord int, severity string, material boolean, rationale string")
    got = {r.group_id: r for r in K.apply_verdicts(reports, verdicts).collect()}
    assert tuple(got["g"].differences[0]) == ("info", "m. first. second") and got["g"].dimensions[-1].score == 33.3
    assert tuple(got["h"].differences[0]) == ("info", "m") and got["h"].dimensions[-1].score == 100.0


def test_nesting_has_no_depth_limit(spark):
    chain = [("g", "d", f"n{i}", f"n{i - 1}" if i else None, "r1c0") for i in range(40)]
    elements = spark.createDataFrame(chain + [("g", "d", "z", None, None)], "group_id string, doc_id string, node_id string, parent_node_id string, subtype string")
    classified = spark.createDataFrame([("g", "d", "n0", "REPEATABLE_TABLE"), ("g", "d", "z", "FIXED")], "group_id string, doc_id string, node_id string, classification string")
    got = {r.node_id for r in RC.nested_in_looped_table(elements, classified).collect()}
    assert got == {f"n{i}" for i in range(1, 40)}


def test_repeated_blocks_alternate(spark):
    columns = (
        "group_id string, block_order int, type string, text string, field_name string, prefix string, suffix string, loop string,"
        "columns array<string>, headers array<string>, n_rows int, role string, condition string, hide_empty boolean, toggle string")
    block = lambda i, text, loop, role: ("t", i, "paragraph", text, "f" if loop else None, "", "", loop, None, None, None, role, None, False, None)
    blocks = spark.createDataFrame([block(0, "Top", None, None), block(1, None, "block", "title"), block(2, None, "block", "body"), block(3, "End", None, None)], columns)
    context = spark.createDataFrame(
        [("r", "f", "repeatable", None, [{"title": "T1", "body": "B1\n- x"}, {"title": "T2", "body": "B2"}], None, None)],
        f"request_id string, field_name string, field_type string, value string, rows {ROWS}, items array<string>, blocks array<struct<kind:string,level:int,marker:string,text:string>>")
    requests = spark.createDataFrame([("r", "t")], "request_id string, template_id string")
    out = G.render_documents(blocks, context, requests).orderBy("block_order", "part").collect()
    assert [(r.type, r.text) for r in out] == [
        ("paragraph", "Top"), ("paragraph", "T1"), ("rich_paragraph", "B1"), ("rich_bullet", "x"), ("paragraph", "T2"), ("paragraph", "B2"), ("paragraph", "End")]


def test_dates_with_time_and_weekday(spark):
    good = ["2026-06-01T10:00:00", "2026-06-01 10:00", "Mon, 1 June 2026", "2026-06-01T10:00:00.5+02:00", "Monday 1 June 2026", "6/1/2026 3:15 PM", "2026-06-01"]
    bad = ["10:00", "Mon", "2026-06-01T", "soon 10:00", "2026-13-41T10:00"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", N.is_valid_date("t").alias("ok"), N.normalize_date("t")["iso"].alias("iso"))
    got = {r.t: r for r in df.collect()}
    assert all(got[t].ok for t in good) and not any(got[t].ok for t in bad)
    assert {got[t].iso for t in good if "/" not in t} == {"2026-06-01"}


def test_sql_slug_is_the_column_slug(spark):
    register_functions(spark)
    texts = ["The And", "Report Date: x", "  a an  the  Total   due of  the first quarter ", "9 lives", "", "::", "É b", " Name "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", slug("t").alias("want"), F.expr("slugify_field(t)").alias("got"))
    assert [(r.t, r.got) for r in df.collect()] == [(r.t, r.want) for r in df.collect()]
    assert df.first().got == "the_and"


def test_staged_tables_go_with_their_scope(spark):
    from pathlib import Path

    from formloom.session import shared_dir, stage, staging

    folder = Path(shared_dir(spark).removeprefix("file:")) / "stage"
    with staging(spark):
        kept = stage(spark.range(3), "scoped").count()
        assert list(folder.glob("scoped-*"))
    assert kept == 3 and not list(folder.glob("scoped-*"))
