"""Releases, edits, several templates for a document, and long documents."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from formloom.functions import similarity as S
from formloom.operators import compliance as K
from formloom.operators import fields as FD
from formloom.operators import naming as N
from formloom.plans.analyze import analyze
from formloom.schemas import DOCUMENT_DDL
from formloom.sources import packages as PK
from formloom.sources import releases as R

from test_templates import el, reports


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(reports(), DOCUMENT_DDL)


@pytest.fixture(scope="module")
def analysis(docs):
    return analyze(docs)


def keyed(df):
    return df.withColumnRenamed("group_id", "template_id")


EDIT = "group_id string, node_id string, action string, field_name string, field_type string, classification string, required boolean, ord int"


def test_overrides_fold_in_order(spark, analysis):
    edits = spark.createDataFrame([
        ("report", "n0002", "include", "first", "number", None, True, 1), ("report", "n0002", "include", "second", "text", None, False, 2),
        ("report", "n0003", "include", "never", "text", None, True, 9), ("report", "n0003", "exclude", None, None, None, None, 1),
        ("report", "n0011", "promote", "secrecy", None, None, True, 1),
    ], EDIT)
    before = {r.node_id: r for r in analysis.classified.collect()}
    after = {r.node_id: r for r in FD.apply_overrides(analysis.classified, edits).collect()}
    assert len(after) == len(before)
    assert (after["n0002"].field_name, after["n0002"].field_type, after["n0002"].required) == ("second", "text", False)
    assert (after["n0003"].classification, after["n0003"].field_name) == ("FIXED", None)
    assert (after["n0011"].classification, after["n0011"].field_name, after["n0011"].field_type) == ("DYNAMIC_TEXT", "secrecy", "text")
    assert {n for n in before if before[n] != after[n]} == {"n0002", "n0003", "n0011"}
    fields = FD.edit_fields(analysis.fields, edits, analysis.classified).orderBy("field_order").collect()
    names = [f.field_name for f in fields]
    assert "second" in names and "project_name" not in names and "report_date" not in names and names[-1] == "secrecy"
    assert fields[-1].node_ids == ["n0011"] and fields[-1].required and fields[-1].label == "Secrecy"


def test_releases(spark, analysis, tmp_path):
    base = str(tmp_path / "releases")
    parts = {"fields": keyed(analysis.fields), "rules": keyed(analysis.rules), "classifications": keyed(analysis.classified),
             "representative": keyed(analysis.representatives), "sections": keyed(analysis.sections)}
    with pytest.raises(ValueError):
        R.republish_all(spark, base, spark.createDataFrame([], EDIT.replace("group_id", "template_id")))
    assert R.publish_all(parts, base) == 1
    edits = spark.createDataFrame([("report", "n0003", "exclude", None, None, None, None, 1)], EDIT)
    assert R.republish_all(spark, base, keyed(edits)) == 2
    told = R.changelog(R.versions(spark, base)).orderBy("version").collect()
    assert [(t.version, t.changelog) for t in told] == [(1, "Initial version"), (2, "Edited fields → v2")]
    assert told[1].summary == f"Re-published 'report' v2 with {told[0].n_fields - 1} field(s)."
    first, second = (R.read_release(spark, base, "fields", v) for v in (1, 2))
    assert {r.field_name for r in first.collect()} - {r.field_name for r in second.collect()} == {"report_date"}
    assert R.read_release(spark, base, "fields").select("version").distinct().collect()[0].version == 2
    kinds = {r.node_id: r.classification for r in R.read_release(spark, base, "classifications").collect()}
    assert kinds["n0003"] == "FIXED" and kinds["n0002"] != "FIXED"
    # Folders that never reached the log are no release.
    keyed(analysis.fields).write.parquet(f"{base}/fields/commit=rstray")
    assert R.versions(spark, base).count() == 2


def test_writers_share_no_version(spark, tmp_path):
    base, errors = str(tmp_path / "r"), []

    def write(i):
        try:
            for _ in range(2):
                R.publish_all({"fields": spark.createDataFrame([("t", f"f{i}"), (f"own{i}", "g")], "template_id string, field_name string")}, base)
                PK.publish_version(spark, f"{base}-single", "t", {"fields": spark.createDataFrame([(f"f{i}",)], "field_name string")}, name="T")
        except Exception as e:  # told below
            errors.append(e)

    writers = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert errors == []
    versions = [(r.template_id, r.version) for r in R.versions(spark, base).collect()]
    assert sorted(v for t, v in versions if t == "t") == [1, 2, 3, 4, 5, 6] and len(set(versions)) == len(versions) == 12
    assert [r.version for r in PK.list_versions(spark, f"{base}-single", "t").collect()] == [1, 2, 3, 4, 5, 6]


def test_claims_and_refusals(spark, tmp_path):
    assert PK.claim(spark, f"{tmp_path}/c/1") and not PK.claim(spark, f"{tmp_path}/c/1")
    df = spark.createDataFrame([("t", 1, "a")], "template_id string, version int, x string")
    PK.write_packages("fields", df, str(tmp_path))
    with pytest.raises(FileExistsError):
        PK.write_packages("fields", df, str(tmp_path))
    PK.write_packages("fields", df.withColumn("version", F.lit(2)), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/fields").count() == 2


def test_edited_rules_and_owners(spark, docs, analysis):
    """A regex rule counts, one that cannot be read too; a node claimed twice is one spec."""
    names = {r.field_name for r in analysis.fields.collect()}
    assert "project_name" in names
    pattern = lambda p, i: spark.range(1).select(F.lit("report").alias("group_id"), F.lit("project_name").alias("field_name"), F.lit(i).alias("rule_id"),
        F.lit("regex").alias("rule_type"), FD.rule_params(pattern=F.lit(p)).alias("params"), F.lit(None).cast("string").alias("message"), F.lit("warning").alias("severity"))
    again = analysis.fields.where("field_name = 'project_name'").withColumns({"field_name": F.lit("project_again"), "field_order": F.lit(99)})
    specs = K.template_specs(analysis.representatives, analysis.classified, analysis.fields, pattern("A.*", "a"))
    got = {r.doc_id: [x.message for x in r.differences if x.kind == "format"] for r in K.check_compliance(docs, specs).collect()}
    assert got == {"a": [], "b": ["'Project Name' does not match the required format"]}
    specs = K.template_specs(analysis.representatives, analysis.classified, analysis.fields, pattern("[z-a]", "a"))
    got = {r.doc_id: [x.message for x in r.differences if x.kind == "format"] for r in K.check_compliance(docs, specs).collect()}
    assert got["a"] == ["Rule pattern of 'Project Name' cannot be read"]
    twice = K.template_specs(analysis.representatives, analysis.classified, analysis.fields.unionByName(again)).first()
    assert len(twice.specs) == len(twice.rep_sigs) == analysis.representatives.count()
    assert [s.name for s in twice.specs if s.node_id == "n0002"] == ["project_again"]


def test_candidates_are_those_of_brute_force(spark):
    dice = random.Random(4)
    words = [f"Label {i}: x" for i in range(30)]
    docs = [("g", f"d{i}", i, [el(j, "paragraph", dice.choice(words[: 6 + i % 25])) for j in range(dice.randint(0, 9))]) for i in range(60)]
    sig = lambda t: "p:" + t.split(":")[0].lower()
    templates = [(f"t{i}", i % 3, [sig(dice.choice(words[: 5 + i])) for _ in range(dice.randint(1, 8))]) for i in range(25)]
    table = spark.createDataFrame(templates, "template_id string, version int, rep_sigs array<string>")
    for share in (0.3, 0.5, 1.0):
        want = set()
        for g, doc, _, els in docs:
            have = {sig(e["text"]) for e in els}
            for t, v, sigs in templates:
                n = len(have & set(sigs))
                if n >= -(-len(set(sigs)) * share // 1):
                    want.add((g, doc, t, v, n))
        got = K.candidate_templates(spark.createDataFrame(docs, DOCUMENT_DDL), table, share).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_long_documents_are_repaired_in_one_pass(spark):
    """Thousands of elements: missing, altered and extra ones, in seconds."""
    n = 8_000
    sigs, specs = [], []
    for i in range(n):
        text = f"Clause {i}: the parties agree on item {i} of the list"
        sigs.append(f"p:clause {i}")
        specs.append((i, f"n{i}", "paragraph", text, None, "FIXED", f"n{i}", False, None, False, "", None, [], None, None, False))
    a = spark.range(1).select(F.lit("g").alias("group_id"))
    kind = ("array<struct<ri:int,node_id:string,type:string,expected:string,headers:array<string>,classification:string,name:string,required:boolean,"
            f"static_prefix:string,has_field:boolean,label:string,field_type:string,f_rules:array<{FD.RULE}>,columns:array<string>,field_order:int,optional:boolean>>")
    templates = spark.createDataFrame([("g", sigs, specs)], f"group_id string, rep_sigs array<string>, specs {kind}")
    texts = [s[3] for s in specs]
    kept = [t if i % 7 else t + " or not, as they please, and so on" for i, t in enumerate(texts) if i % 5]
    kept.insert(10, "Extra: something else")
    doc = spark.createDataFrame([("g", "d", 0, [el(i, "paragraph", t) for i, t in enumerate(kept)])], DOCUMENT_DDL)
    start = time.perf_counter()
    fixed = K.fix_boilerplate(doc, templates).first()
    report = K.check_compliance(doc, templates).first()
    assert time.perf_counter() - start < 120
    assert a.count() == 1 and [r.document_text for r in report.alignment if r.status == "extra"] == ["Extra: something else"]
    got = [b.text for b in fixed.blocks if b.text != "Extra: something else"]
    assert got == texts[1:]  # nothing stands before the first one, so there is no place to put it back
    assert fixed.n_fixed == sum(1 for i in range(1, n) if i % 5 == 0) + sum(1 for i in range(n) if i % 5 and i % 7 == 0)


def test_letters_bound_and_pairs(spark):
    from difflib import SequenceMatcher

    dice = random.Random(9)
    words = ["".join(dice.choice("abcd_12é") for _ in range(dice.randint(1, 12))) for _ in range(60)]
    rows = [(a, b, SequenceMatcher(None, a, b).ratio()) for a in words for b in words]
    df = spark.createDataFrame(rows, "a string, b string, r double")
    assert df.where(S.letters_bound(S.letter_counts("a"), S.letter_counts("b")) < F.col("r") - 1e-12).count() == 0
    # Of names that share no letters none reaches Python; equal spellings are compared once.
    residue = spark.createDataFrame([(t, "customer_nam") for t in range(50)] + [(t, "zzzzzzzzzzzz") for t in range(50)], "template_id int, slug string")
    keys = spark.createDataFrame([(t, "customer_name", "customer_name", (0, 1)) for t in range(50)],
                                 "template_id int, key string, field_name string, rank struct<kind:int,field_order:int>")
    pairs = N.near_pairs(residue, keys, 0.86)
    assert pairs.count() == 50 and pairs.select("slug", "key").distinct().count() == 1
    got = N.closest_keys(residue, keys).collect()
    assert {(r.slug, r.near) for r in got} == {("customer_nam", "customer_name")} and len(got) == 50
