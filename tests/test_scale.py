"""Steps that must not read, build or broadcast whole tables more often than needed."""

import time

from pyspark.sql import functions as F

from formloom.operators import compliance as K
from formloom.operators import diff as D
from formloom.operators import fields as FD
from formloom.plans.analyze import analyze
from formloom.schemas import DOCUMENT_DDL
from formloom.session import stage
from formloom.sources import text as S

from test_templates import el, reports


def test_evidence_is_written_once_and_documents_are_left_alone(spark, tmp_path):
    """The passes over a corpus' values read what was written, not all documents again."""
    place = str(tmp_path / "docs")
    spark.createDataFrame(reports(), DOCUMENT_DDL).write.parquet(place)
    docs = spark.read.parquet(place)
    assert not [f for f in D.diff_corpus(docs).inputFiles() if place in f]
    assert not [f for f in D.corpus_values(docs).inputFiles() if place in f]
    assert {r.node_id: r.status for r in D.diff_corpus(docs).collect()} == {
        r.node_id: r.status for r in analyze(docs).diffs.collect()}


def test_representatives_are_chosen_without_signatures(spark):
    orders = spark.createDataFrame(
        [(i, 1, "O", 10.0 * i, "1-URGENT") for i in range(1, 6)],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    ).withColumn("o_orderdate", F.to_timestamp(F.lit("1995-02-03")))
    customer = spark.createDataFrame([(1, "Customer#1")], "c_custkey bigint, c_name string")
    lines = spark.createDataFrame(
        [(2, 1, 7, 8, 3.0, 4.0)],
        "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_quantity double")
    reps = spark.createDataFrame([("1-URGENT", 2, 5), (None, 3, 2)], "group_id string, rep_seq bigint, n_documents bigint")
    nodes = D.rep_nodes(S.order_forms(orders, customer, lines), reps)
    assert "replace(" not in nodes._jdf.queryExecution().optimizedPlan().toString().lower()
    rows = nodes.orderBy("ri").collect()
    assert [(r.doc_seq, r.n_documents, r.ri) for r in rows] == [(2, 5, i) for i in range(10)]
    assert [r.table_structure.n_rows for r in rows if r.type == "table"] == [2]


def test_judging_stages_no_alignments(spark, monkeypatch):
    from catalog import compliance as CC

    shape = ("group_id string, doc_id string, score double, dimensions array<struct<name:string,satisfied:double,total:double,score:double>>, "
             "differences array<struct<kind:string,severity:string,message:string>>, alignment array<string>")
    rows = [("g", "1", 50.0, [("structure", 1.0, 2.0, 50.0)], [("missing_fixed", "error", "Gone"), ("format", "warning", "Odd")], ["long"] * 9),
            ("g", "2", 100.0, [("structure", 2.0, 2.0, 100.0)], [], ["long"] * 9)]
    monkeypatch.setattr(CC, "_reports", lambda spark, d: spark.createDataFrame(rows, shape))
    written = []
    monkeypatch.setattr(CC, "stage", lambda df, name: written.append(df.columns) or df)
    judged = {r.doc_id: r for r in CC.judged_compliance(spark, None).collect()}
    assert (judged["1"].semantic, judged["1"].n_differences, judged["1"].severities) == (50.0, 2, "error")
    assert (judged["2"].semantic, judged["2"].n_differences) == (None, 0)
    twice = {r.doc_id: r for r in CC.twice_judged(spark, None).collect()}
    assert (twice["1"].severity, twice["1"].folded, twice["2"].folded) == ("info", True, False)
    assert len(written) == 2 and not any("alignment" in columns for columns in written)


def test_compliance_joins_the_order_tables_once(spark, monkeypatch, tmp_path):
    """Templates and received forms come from the rows written once; nothing else reads the tables."""
    from catalog import common as C
    from catalog import compliance as CC

    rows = {
        "orders": ["id AS o_orderkey", "1L AS o_custkey", "'O' AS o_orderstatus", "10.0D * id AS o_totalprice",
                   "'1-URGENT' AS o_orderpriority", "to_timestamp('1995-02-03') AS o_orderdate"],
        "customer": ["id AS c_custkey", "concat('Customer#', id) AS c_name"],
        "lineitem": ["id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "8L AS l_suppkey", "3.0D AS l_extendedprice",
                     "4.0D AS l_quantity"],
    }
    for name, columns in rows.items():
        spark.range(1, 7).selectExpr(*columns).write.parquet(f"{tmp_path}/{name}.parquet")
    read, table = [], C.table
    monkeypatch.setattr(C, "table", lambda spark, d, name: read.append(name) or table(spark, d, name))
    reports = CC._reports(spark, str(tmp_path))
    assert sorted(read) == ["customer", "lineitem", "orders"]
    assert not [f for f in reports.inputFiles() if str(tmp_path) in f]
    assert reports.count() == 6


def test_layouts_reach_python_as_text(spark):
    """One string for a layout, and only the tables' positions for its anchors."""
    from formloom.operators import align as A

    layouts = spark.createDataFrame(
        [("g", "a", ["p:x", "t:h", "p:y"], 1, 1), ("g", "b", ["t:h", "p:y"], 1, 2), ("g", "c", [], 1, 3)],
        "group_id string, layout string, sigs array<string>, n_docs bigint, first_seq bigint")
    reps = spark.createDataFrame([("g", ["p:x", "t:h", "p:y"])], "group_id string, rep_sigs array<string>")
    found = A.layout_pairs(layouts, reps)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join") == 2
    assert {r.layout: (r.pairs, r.anchors) for r in found.collect()} == {
        "a": ([0, 1, 2], [-1, 0, 0]), "b": ([-1, 0, 1], [-1, -1, -1]), "c": ([-1, -1, -1], [-1, -1, -1])}


def test_words_are_no_dates(spark):
    from formloom.functions import values as N

    rows = spark.sql("SELECT * FROM VALUES ('n/a'), (''), ('soon'), ('1995-02-03'), ('Friday, 3 Feb 1995 10:30'), (null) AS t(x)")
    told = rows.select(N.is_valid_date("x").alias("ok"))
    assert ", [0-9])" in told._jdf.queryExecution().analyzed().toString()
    assert [r.ok for r in told.collect()] == [False, False, False, True, True, False]


def _order_tables(spark, tmp_path):
    rows = {
        "orders": ["id AS o_orderkey", "1L AS o_custkey", "'O' AS o_orderstatus", "if(id % 2 = 0, 500000.0D, 10.0D) AS o_totalprice",
                   "'1-URGENT' AS o_orderpriority", "make_timestamp(1995, int(id), 3, 0, 0, 0) AS o_orderdate"],
        "customer": ["id AS c_custkey", "concat('Customer#', id) AS c_name"],
        "lineitem": ["id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "8L AS l_suppkey", "3.0D AS l_extendedprice",
                     "4.0D AS l_quantity"],
    }
    for name, columns in rows.items():
        spark.range(1, 7).selectExpr(*columns).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_layouts_are_written_with_the_order_rows(spark, tmp_path):
    """Signatures are made once, where the rows are written; changed forms have their own."""
    from catalog import common as C
    from catalog.compliance import received
    from formloom.operators import align as A

    docs, back = C.staged_forms_and(spark, _order_tables(spark, tmp_path), received)
    for made, parts in ((docs, docs.drop(*A.LAYOUT)), (back, back.drop(*A.LAYOUT))):
        layouts = A.layouts_of(A.with_layout(made))
        assert "transform(" not in layouts._jdf.queryExecution().optimizedPlan().toString()
        told = A.with_layout(parts).select("doc_id", *A.LAYOUT).collect()
        assert sorted(told) == sorted(A.with_layout(made).select("doc_id", *A.LAYOUT).collect())
    # February's terms and May's table are gone from the forms that came back.
    assert {r.doc_id: len(r.sigs) for r in docs.collect()} == {"1": 10, "2": 11, "3": 10, "4": 11, "5": 10, "6": 11}
    assert {r.doc_id: len(r.sigs) for r in back.collect()} == {"1": 10, "2": 10, "3": 10, "4": 11, "5": 9, "6": 11}
    assert not set(A.LAYOUT) & set(received(docs).columns)


def test_kinds_are_read_from_varying_parts_only(spark):
    """One reading of a value's kind, and none of texts that are all the same."""
    values = spark.createDataFrame(
        [("g", 0, "Date: 1995-02-03", 2, -1), ("g", 0, "Date: soon", 1, 2), ("g", 1, "1995-02-03", 3, -1),
         ("g", 2, "12", 1, -1), ("g", 2, "x", 1, 1), ("g", 2, "y", 1, 2)],
        "group_id string, ri int, text string, n_docs bigint, rank bigint").selectExpr(
        "*", "CAST(null AS string) header_key", "CAST(null AS bigint) grid_key", "CAST(null AS int) n_rows", "CAST(null AS string) image_hash")
    nodes = spark.createDataFrame(
        [("g", i, f"n{i}", "paragraph", 3, None, None) for i in range(3)],
        "group_id string, ri int, node_id string, type string, n_documents bigint, image_ref string, table_structure struct<headers:array<string>>")
    found = D._decide(values, nodes, 5)
    assert {r.ri: r.detected_kind for r in found.collect()} == {0: "date", 1: None, 2: "text"}
    dates = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if r"\d{1,4}" in line]
    assert dates and not [line for line in dates if "after_kind" in line or "text_kind" in line]


def test_words_are_made_of_distinct_labels_only(spark, monkeypatch):
    """Labels and lines are made distinct in a step of their own, so no filter on their words goes below it."""
    from formloom.operators import routing as R

    written = []
    monkeypatch.setattr(R, "stage", lambda df, name: written.append((name, df)) or df)
    fields = spark.createDataFrame([("t", "order_number", "Order Number", "", "number", 0), ("t", "note", "Goods seller", "", "text", 1)],
                                   "template_id string, field_name string, label string, description string, field_type string, field_order int")
    said = spark.createDataFrame([("t", "Order number", "the goods")] * 3 + [(None, "Note", "x")], "template_id string, label string, line string")
    hits = {(r.label, r.field_name, r.score) for r in R.match_labels(said, fields).collect()}
    fits = {(r.line, tuple(r.fits)) for r in R.match_prose(said, fields).collect()}
    assert hits == {("Order number", "order_number", 2.0)} and fits == {("the goods", ("note",))}
    assert [name for name, _ in written] == ["labels", "distinct-lines"]
    assert all("regexp" not in df._jdf.queryExecution().optimizedPlan().toString() for _, df in written)


def test_titles_search_for_capitals_only(spark):
    from formloom.operators import classify as K
    from formloom.schemas import ELEMENT_COLUMNS

    shape = {"group_id": "string", "doc_id": "string", **ELEMENT_COLUMNS}
    rows = [("a", 0, "paragraph", None, "plain"), ("a", 1, "paragraph", None, "MAIN TITLE"), ("b", 0, "table", None, "CAPITALS"),
            ("b", 1, "heading", None, "first part"), ("c", 0, "paragraph", ["date"], "CAPITALS"), ("d", 0, "paragraph", ["all_caps"], "hinted"),
            ("e", 0, "paragraph", None, None)]
    given = [{"group_id": "g", "doc_id": k, "doc_order": i, "type": t, "semantic_hints": h, "text": x} for k, i, t, h, x in rows]
    nodes = spark.createDataFrame([tuple(r.get(c) for c in shape) for r in given], ", ".join(f"{c} {t}" for c, t in shape.items()))
    found = K.guess_doc_type(nodes)
    assert {r.doc_id: r.document_type for r in found.collect()} == {
        "a": "Main Title", "b": "First Part", "c": "Document", "d": "Hinted", "e": "Document"}
    assert "@" not in found._jdf.queryExecution().optimizedPlan().toString().split("Scan")[0]  # the pattern of an address


def test_plain_names_stay_out_of_python(spark):
    """Equal names are numbered by Spark; Python sees rows whose names meet others, or many."""
    import random

    from pyspark.sql import functions as F

    from formloom.operators import naming as N

    draw, pool = random.Random(3), ["a", "a_2", "b", "", "field", None]
    rows = [(i, [draw.choice(pool) for _ in range(draw.randint(0, 5))], draw.sample(["a", "a_2", "b_3", "z"], draw.randint(0, 2))) for i in range(80)]
    rows += [(80, ["a"] * 40, []), (81, ["a", "a", "b"], ["c"]), (82, ["a", "b"], None)]
    df = spark.createDataFrame(rows, "i int, b array<string>, t array<string>")
    got = {r.i: r for r in N.with_names(df, F.col("b"), "n", F.col("t")).select(
        "i", "n", N._numbered(F.col("b"), F.coalesce("t", F.array().cast("array<string>"))).alias("easy")).collect()}
    for i, bases, taken in rows:
        used, want = set(taken or []), []
        for b in bases:
            want.append(b if b is None else N.free_name(b, used))
            used.add(want[-1])
        assert got[i].n == want and got[i].easy in (None, want)
    assert got[81].easy == ["a", "a_2", "b"] and got[82].easy == ["a", "b"] and got[80].easy is None


def test_answers_and_nodes_meet_in_one_shuffle_by_document(spark):
    from formloom.operators import responses as RS

    shape = ("group_id string, doc_id string, answer_order int, node_id string, classification string, field_name string, "
             "field_type string, description string, required boolean, confidence string, rationale string")
    told = [("g", "1", 1, "n1", "DYNAMIC_TEXT", "Status", "text", None, None, "2", None), ("g", "1", 0, "n2", "ODD", "Status", "odd", "d", False, None, "r"),
            ("g", "1", 2, "n1", "FIXED", "", None, None, None, None, None), ("g", "1", 3, "n9", "FIXED", "x", None, None, None, None, None),
            (None, "2", 0, "n1", "FIXED", "x", None, None, None, None, None)]
    nodes = spark.createDataFrame([("g", "1", "n1"), ("g", "1", "n2"), ("g", "1", "n3"), ("g", "1", "n3"), (None, "2", "n1")],
                                  "group_id string, doc_id string, node_id string")
    out = RS.merge_class_responses(spark.createDataFrame(told, shape), nodes)
    silent = ("FIXED", None, None, "", False, 0.4, "not classified by model; defaulted to fixed")
    assert sorted((r.doc_id, r.node_id, *r[3:]) for r in out.collect()) == sorted([
        ("1", "n1", "DYNAMIC_TEXT", "status_2", "text", "", True, 1.0, ""), ("1", "n2", "UNKNOWN", "status", None, "d", False, 0.5, "r"),
        ("1", "n3", *silent), ("1", "n3", *silent), ("2", "n1", *silent)])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


_SPEC = ("array<struct<ri:int,node_id:string,type:string,expected:string,headers:array<string>,classification:string,name:string,required:boolean,"
         f"static_prefix:string,has_field:boolean,label:string,field_type:string,f_rules:array<{FD.RULE}>,columns:array<string>,field_order:int,optional:boolean>>")


def _held_against(spark):
    """Two documents of one clause, and two templates: one holds the clause, one other words."""
    docs = spark.createDataFrame(
        [("g", d, i, [el(0, "paragraph", t)]) for i, (d, t) in enumerate([("a", "Clause: as agreed"), ("b", "Clause: altered")])], DOCUMENT_DDL)
    spec = lambda text: [(0, "n1", "paragraph", text, None, "FIXED", "n1", False, None, False, "", None, [], None, None, False)]
    held = [("g", 1, ["p:clause"], spec("Clause: as agreed")), ("h", 1, ["p:other"], spec("Other: words"))]
    return docs, spark.createDataFrame(held, f"template_id string, version bigint, rep_sigs array<string>, specs {_SPEC}")


def _fed_to_python(df):
    """The columns of the rows that wait while Python works."""
    todo, found = [df._jdf.queryExecution().optimizedPlan()], []
    while todo:
        plan = todo.pop()
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "ArrowEvalPython":
            out = below[0].output()
            found.append({out.apply(i).name(): out.apply(i).dataType().simpleString() for i in range(out.size())})
        todo += below
    return found


def test_rows_that_wait_for_python_are_light(spark):
    """They go to disk by the ten thousand, each with its specs and whole elements otherwise."""
    docs, templates = _held_against(spark)
    reports_ = K.check_compliance(docs, templates.where("template_id = 'g'").withColumnRenamed("template_id", "group_id").drop("version"))
    fed = _fed_to_python(reports_)
    assert fed and all(not {"specs", "nodes", "rep_sigs"} & set(names) for names in fed)
    assert all("style_name" not in kind for names in fed for kind in names.values())
    assert {r.doc_id: [x.kind for x in r.differences] for r in reports_.collect()} == {"a": [], "b": ["changed_fixed"]}


def test_shuffle_files_go_with_the_stage(spark):
    """Else they stay until the driver collects its garbage, on top of what is staged."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if "shuffle" in files.apply(i).getName()}

    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffles()
    kept = spark.conf.get(key)
    made = stage(spark.range(1000).repartition(3, "id"), "moved")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(key) == kept
    assert made.count() == 1000


def test_reports_are_made_once_for_their_rows(spark):
    """Rows of an array: no filter on its size is put below what makes the array."""
    made = spark.range(2).select(F.lit("g").alias("group_id"), F.col("id").cast("string").alias("doc_id"), F.from_json(
        F.concat(F.lit('[{"status":"missing"},{"status":"match"},{"status":"'), F.col("id").cast("string"), F.lit('"}]')), f"array<{K.PAIR}>").alias("alignment"))
    rows = K.actionable(made)
    assert "size(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.status) for r in rows.collect()) == [("0", "missing"), ("1", "missing")]


def test_documents_of_a_layout_are_assigned_without_a_shuffle(spark):
    docs, templates = _held_against(spark)
    found = K.candidate_templates(docs, templates, by_layout=True)
    assert [(r.group_id, r.template_id, r.version, r.shared) for r in found.collect()] == [("g", "g", 1, 1)]
    told = K.check_assigned(docs, templates, found)
    assert "hashpartitioning" not in told._jdf.queryExecution().executedPlan().toString()
    by_doc = K.check_assigned(docs, templates, K.candidate_templates(docs, templates))
    assert sorted(map(tuple, told.select("doc_id", "template_id", "version", "score").collect())) == sorted(
        map(tuple, by_doc.select("doc_id", "template_id", "version", "score").collect())) == [("a", "g", 1, 100.0), ("b", "g", 1, 30.0)]


def test_placements_are_made_of_the_staged_rows(spark, tmp_path, monkeypatch):
    """The orders' values come from the rows written for the forms, not from another join."""
    from catalog import rendering

    place = str(tmp_path)
    spark.createDataFrame([(1, 1, "O", 10.0, "1-URGENT")], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").withColumn(
        "o_orderdate", F.to_timestamp(F.lit("1995-02-03"))).write.parquet(f"{place}/orders.parquet")
    spark.createDataFrame([(1, "Customer#1")], "c_custkey bigint, c_name string").write.parquet(f"{place}/customer.parquet")
    spark.createDataFrame([(1, 1, 7, 8, 3.0, 4.0)], "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_quantity double").write.parquet(
        f"{place}/lineitem.parquet")
    monkeypatch.setattr(rendering, "published", lambda docs: dict.fromkeys(("blocks", "fields", "rules")))
    monkeypatch.setattr(rendering.PG, "generate", lambda requests, placements, *a, **b: placements)
    given = rendering._generation(spark, place)
    assert not [f for f in given.inputFiles() if place in f]
    assert {r.field_name: r.value or [dict(x) for x in r.rows] for r in given.collect()} == {
        "order_number": "1", "customer_name": "Customer#1", "order_date": "1995-02-03", "status": "O", "total_due": "$10.00",
        "include_orders_of_this_size_are": "no", "line_items": [{"part": "7", "quantity": "4", "price": "3.00"}]}
