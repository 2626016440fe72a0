"""Golden results on small documents: diff, classes, fields, compliance."""

import pytest
from pyspark.sql import functions as F

from formloom.operators import compliance as K
from formloom.operators import diff as D
from formloom.operators import elements as E
from formloom.operators import naming as N
from formloom.operators import tagging as TG
from formloom.operators.classify import classify
from formloom.plans.analyze import analyze
from formloom.schemas import DOCUMENT_DDL, ELEMENT_COLUMNS


def el(i, kind, text="", rows=None, **more):
    base = dict.fromkeys(ELEMENT_COLUMNS)
    base.update(doc_order=i, node_id=f"n{i + 1:04d}", type=kind, text=text, position_index=i, section_index=0,
                style_name={"heading": "Heading 1"}.get(kind, "Normal"), **more)
    if rows:
        base["table_structure"] = {"n_rows": len(rows), "n_cols": len(rows[0]), "headers": rows[0], "rows": rows,
                                   "merged_cells": [], "col_widths": [None] * len(rows[0])}
    return base


def report(name, date, author, summary, tasks):
    head = ["Task", "Owner", "Status", "Due Date"]
    return [
        el(0, "paragraph", "MONTHLY PROJECT STATUS REPORT"), el(1, "paragraph", f"Project Name: {name}"),
        el(2, "paragraph", f"Report Date: {date}"), el(3, "paragraph", f"Prepared By: {author}"),
        el(4, "paragraph", "This report covers the work of the month."), el(5, "heading", "Summary", subtype="1"),
        el(6, "paragraph", summary), el(7, "heading", "Task Status", subtype="1"), el(8, "table", rows=[head, *tasks]),
        el(9, "heading", "Confidentiality", subtype="1"), el(10, "paragraph", "Confidential. Do not share outside the company."),
        el(11, "paragraph", "Page 1", header_footer_scope="footer:0", semantic_hints=["auto_field"]),
    ]


TASKS = [["Plan", "Ann", "Done", "2026-05-01"], ["Build", "Bob", "Open", "2026-06-01"]]


def reports():
    return [
        ("report", "a", 1, report("Apollo", "2026-05-01", "Jane Smith", "Phase one is complete and tested.", TASKS)),
        ("report", "b", 2, report("Zeus", "2026-06-01", "John Doe", "The second phase has begun on time.", [*TASKS, ["Ship", "Cy", "Open", "2026-07-01"]])),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(reports(), DOCUMENT_DDL)


@pytest.fixture(scope="module")
def analysis(docs):
    return analyze(docs)


def test_diff_golden(docs):
    rows = {r.ri: r for r in D.diff_corpus(docs).collect()}
    assert rows[0].status == "identical" and rows[0].is_constant
    assert (rows[2].status, rows[2].static_prefix, rows[2].detected_kind) == ("partial_change", "Report Date: ", "date")
    assert "2026-05-01" in rows[2].variable_parts
    assert rows[1].static_prefix == "Project Name: "
    assert (rows[8].status, rows[8].header_identical, rows[8].row_count_variable) == ("row_count_changed", True, True)
    assert {r.confidence for r in rows.values()} == {0.75}


def test_all_values_beyond_the_preview(spark):
    """More differing documents than a diff row previews: every part, picture and row count is told."""
    rows = [
        ("report", f"d{i:02d}", i, [
            el(0, "paragraph", "REPORT"), el(1, "paragraph", f"Project Name: Place {i // 2}"),
            el(2, "image", "", image_ref={"hash": f"h{i}"}), el(3, "table", rows=[["Task"], *[["x"]] * (1 + i % 25)]),
        ]) for i in range(60)
    ]
    docs = spark.createDataFrame(rows, DOCUMENT_DDL)
    diffs = {r.ri: r for r in D.diff_corpus(docs).collect()}
    got = D.corpus_values(docs).collect()
    parts = {r.variable_part: r.n_docs for r in got if r.ri == 1}
    assert parts == {f"Place {i}": 2 for i in range(30)} and diffs[1].static_prefix == "Project Name: "
    pictures = [r.image_hash for r in got if r.ri == 2]
    assert sorted(pictures) == sorted(f"h{i}" for i in range(60)) and {r.status for r in got if r.ri == 2} == {"image_changed"}
    assert [(r.text, r.variable_part, r.n_docs, r.in_representative) for r in got if r.ri == 0] == [("REPORT", None, 60, True)]
    assert sum(r.in_representative for r in got) == 4
    counts = {r.n_rows: r.n_docs for r in D.corpus_row_counts(docs).collect()}
    assert counts == {2 + k: 3 if k < 10 else 2 for k in range(25)}


def test_fields_golden(analysis):
    got = {r.field_name: (r.field_type, r.classification, r.required) for r in analysis.fields.collect()}
    assert got == {
        "project_name": ("text", "DYNAMIC_TEXT", True), "report_date": ("date", "DYNAMIC_DATE", True),
        "prepared_by": ("person", "DYNAMIC_PERSON", True), "summary": ("text", "DYNAMIC_TEXT", True),
        "task_status": ("table", "REPEATABLE_TABLE", True),
    }
    table = analysis.fields.where("field_name = 'task_status'").first()
    assert [(c.field_name, c.field_type) for c in table.columns] == [
        ("task", "text"), ("owner", "text"), ("status", "text"), ("due_date", "date")]
    assert analysis.document_types.first().document_type == "Monthly Project Status Report"
    kinds = {r.rule_type for r in analysis.rules.collect()}
    assert kinds == {"required", "date_format", "table_schema"}


def test_compliance_golden(spark, docs, analysis):
    specs = K.template_specs(analysis.representatives, analysis.classified, analysis.fields)
    good = K.check_compliance(docs, specs).collect()
    assert [(r.score, r.grade) for r in good] == [(100.0, "pass")] * 2
    other = [("report", "x", 9, [el(0, "paragraph", "INVOICE"), el(1, "paragraph", "Invoice Number: 7"), el(2, "heading", "Terms", subtype="1")])]
    bad = K.check_compliance(spark.createDataFrame(other, DOCUMENT_DDL), specs).first()
    assert bad.score < 80 and bad.grade == "fail" and "report_date" in bad.missing_fields


def test_repair_puts_boilerplate_back(spark, docs, analysis):
    specs = K.template_specs(analysis.representatives, analysis.classified, analysis.fields)
    broken = [e for e in report("Hera", "2026-08-01", "Amy Poe", "Something else entirely happened.", TASKS) if e["doc_order"] != 9]
    broken[9]["text"] = "You may share this with anybody."
    fixed = K.fix_boilerplate(spark.createDataFrame([("report", "h", 3, broken)], DOCUMENT_DDL), specs).first()
    texts = [b.text for b in fixed.blocks]
    assert fixed.n_fixed == 2 and "Confidentiality" in texts and "Confidential. Do not share outside the company." in texts
    assert "You may share this with anybody." not in texts


def test_optional_clause_becomes_toggle(spark):
    base = [el(0, "paragraph", "SERVICE AGREEMENT"), el(1, "paragraph", "Reference: A-1"), el(2, "heading", "Signatures", subtype="1")]
    more = [*base[:2], el(2, "paragraph", "Special clause applies to this agreement only."), el(3, "heading", "Signatures", subtype="1")]
    base2 = [dict(e) for e in base]
    base2[1]["text"] = "Reference: B-2"
    docs = spark.createDataFrame([("g", "1", 1, more), ("g", "2", 2, base2)], DOCUMENT_DDL)
    toggles = analyze(docs).fields.where("field_type = 'boolean'").collect()
    assert len(toggles) == 1 and toggles[0].field_name.startswith("include_") and toggles[0].default == "true"


def test_skeleton_rejoins(spark):
    rows = [("k", "Ref x--y end"), ("k", "Ref x-y end"), ("m", "alpha"), ("m", "beta"), ("n", "Date: 2026-06-01"), ("n", "Date: 2025-12-31")]
    vals = spark.createDataFrame(rows, "g string, text string")
    got = {r.g: (r.prefix, r.suffix) for r in D.common_skeleton(vals, ["g"]).collect()}
    assert "m" not in got and got["n"] == ("Date: ", "")
    pre, suf = got["k"]
    for g, t in rows[:2]:
        assert t.startswith(pre) and t.endswith(suf) and len(pre) + len(suf) <= len(t)


def test_alignment_matches_brute_force(spark):
    """Layouts of many shapes against the longest, checked with a plain matcher."""
    import random
    from difflib import SequenceMatcher

    from formloom.operators import align as A

    rng = random.Random(7)
    docs = [("g", str(i), i, [el(k, "heading", rng.choice("abcdef")) for k in range(rng.randint(1, 9))]) for i in range(40)]
    laid = A.with_layout(spark.createDataFrame(docs, DOCUMENT_DDL))
    layouts = A.layouts_of(laid)
    rep = max(docs, key=lambda d: (len(d[3]), -d[2]))
    want = [f"h:{e['text']}" for e in rep[3]]
    for row in A.align_to(laid, A.representatives(layouts), layouts).collect():
        have = [f"h:{e['text']}" for e in docs[row.doc_seq][3]]
        expect = [-1] * len(want)
        for tag, i1, i2, j1, j2 in SequenceMatcher(None, want, have, autojunk=False).get_opcodes():
            if tag in ("equal", "replace"):
                for k in range(min(i2 - i1, j2 - j1)):
                    expect[i1 + k] = j1 + k
        assert list(row.pairs) == expect


def test_single_document_runs_merge(spark):
    doc = [el(0, "heading", "Notes", subtype="1"), *[el(i, "list_item", f"point number {i} of the list") for i in (1, 2, 3)], el(4, "paragraph", "Owner: Jane Smith")]
    rows = {r.node_id: r for r in classify(E.explode_documents(spark.createDataFrame([("g", "1", 1, doc)], DOCUMENT_DDL))).collect()}
    assert {rows[f"n000{i}"].classification for i in (2, 3, 4)} == {"REPEATABLE_SECTION"}
    assert {rows[f"n000{i}"].field_name for i in (2, 3, 4)} == {"notes"}
    assert (rows["n0005"].field_name, rows["n0005"].classification) == ("owner", "DYNAMIC_PERSON")


def test_tags_only_leaves_nothing_untagged(spark):
    doc = [
        el(0, "paragraph", "CONTENTS"), el(1, "heading", "Intro", subtype="1"), el(2, "paragraph", "First words."), el(3, "paragraph", "More words."),
        el(4, "paragraph", ""), el(5, "paragraph", "A single line."), el(6, "table", rows=[["A", "B"], ["1", "2"], ["3", "4"]]),
    ]
    els = E.explode_documents(spark.createDataFrame([("g", "1", 1, doc)], DOCUMENT_DDL))
    rows = {r.node_id: r for r in TG.enforce_tags_only(els, classify(els)).collect()}
    assert rows["n0001"].field_name == "contents_label" and "[structural]" in rows["n0001"].rationale
    assert rows["n0002"].field_name == "intro_title"
    assert rows["n0005"].field_name is None
    assert all(r.field_name for n, r in rows.items() if n != "n0005")
    assert rows["n0003"].field_name == rows["n0004"].field_name


def test_names(spark):
    df = spark.createDataFrame([("d", i, b) for i, b in enumerate(["x", "x", "x_2", "y", "x"])], "k string, o int, b string")
    got = [r.n for r in N.with_unique_names(df, ["k"], "o", "b", "n").orderBy("o").collect()]
    assert got == ["x", "x_2", "x_2_2", "y", "x_3"]


def test_resolve_names(spark):
    fields = spark.createDataFrame([("t", "header_level_1_title", "Header Level 1", 0), ("t", "executive_summary", "Summary", 1), ("t", "review_summary", "", 2)],
                                   "template_id string, field_name string, label string, field_order int")
    names = spark.createDataFrame([("t", n) for n in ("executive_summary", "Header Level 1", "executive_sumary", "review_scope", "")], "template_id string, name string")
    got = {r.name: r.field_name for r in N.resolve_names(names, fields).collect()}
    assert got == {"executive_summary": "executive_summary", "Header Level 1": "header_level_1_title", "executive_sumary": "executive_summary", "review_scope": None}
