"""Scoring documents against their template, and repairing boilerplate.

A template travels as one row per group with an array of node specs; a document
is one row with its element array.  After the layout join everything is narrow:
scores come out per document without another shuffle.  A document may be held
against several templates or versions: :func:`candidate_templates` finds those that
share enough of its layout, :func:`check_assigned` scores every assignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom import vocabulary as V
from formloom.functions import similarity as S
from formloom.functions import text as X
from formloom.operators.align import LAYOUT, align_signature, layouts_of, staged_pairs, with_layout
from formloom.operators.fields import RULE, rules_of_field
from formloom.operators.validate import pattern_failure, pattern_matches, rule_failure
from formloom.session import stage

DIMENSIONS = ("structure", "fields", "tables")


def template_specs(representative: DataFrame, classified: DataFrame, fields: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per group: ``rep_sigs`` and ``specs`` (what each representative
    node expects), in representative order.  Toggles and pictures own no value; of
    several fields that claim a node the last one owns it.

    ``rules(group_id, field_name, rule_id, rule_type, params, message, severity[,
    rule_order])`` are the rules to hold values against, as edited or published; by
    default they are those that follow from the fields."""
    ruled = fields.where(~F.col("field_type").isin("boolean", "image"))
    if rules is None:
        ruled = ruled.withColumn("f_rules", F.filter(rules_of_field(), lambda r: r["rule_type"] != "required"))
    else:
        order = "rule_order" if "rule_order" in rules.columns else "rule_id"
        rule = F.struct("rule_id", "rule_type", "params", "message", "severity").cast(RULE)
        given = rules.where("rule_type <> 'required'").groupBy("group_id", "field_name").agg(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("rule_id").alias("i"), rule.alias("r")))),
                        lambda x: x["r"]).alias("f_rules"))  # a field's own rules, few
        ruled = ruled.join(given, ["group_id", "field_name"], "left").withColumn(
            "f_rules", F.coalesce("f_rules", F.array().cast(f"array<{RULE}>")))
    claims = ruled.select(
        "group_id", F.explode("node_ids").alias("node_id"), "field_order", F.struct(
            F.col("field_name").alias("f_name"), "label", F.col("required").alias("f_required"), "field_type", "columns",
            "field_order", "f_rules").alias("f"),
    )
    owner = claims.groupBy("group_id", "node_id").agg(F.max_by("f", "field_order").alias("f")).select("group_id", "node_id", "f.*")
    cls = classified.select("group_id", "node_id", "classification", F.col("field_name").alias("c_name"),
                            F.col("required").alias("c_required"), "static_prefix", "static_suffix", "optional")
    top = representative.where(F.col("parent_node_id").isNull()) if "parent_node_id" in representative.columns else representative
    spec = F.struct(
        "ri", "node_id", "type", X.stripped("text").alias("expected"),
        F.col("table_structure.headers").alias("headers"), "classification",
        F.coalesce("f_name", "c_name", "node_id").alias("name"), F.coalesce("f_required", "c_required").alias("required"),
        "static_prefix", F.col("f_name").isNotNull().alias("has_field"), F.coalesce("label", F.lit("")).alias("label"),
        "field_type", F.coalesce("f_rules", F.array().cast(f"array<{RULE}>")).alias("f_rules"), "columns", "field_order", "optional",
    )
    joined = top.join(cls, ["group_id", "node_id"], "left").join(owner, ["group_id", "node_id"], "left")
    sig = align_signature(F.struct("type", "text", "style_name", "table_structure", "image_ref"))
    return joined.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("ri", sig.alias("sig")))).alias("s"),
        F.collect_list(F.struct("ri", spec.alias("spec"))).alias("packed"),
    ).select(
        "group_id", F.transform("s", lambda x: x["sig"]).alias("rep_sigs"),
        F.transform(F.array_sort("packed", lambda a, b: (a["ri"] - b["ri"]).cast("int")), lambda x: x["spec"]).alias("specs"),
    )


def _differing_texts(specs: Column, tops: Column, pairs: Column) -> tuple[Column, Column]:
    """Left (document) and right (template) texts that need a similarity, null
    where the answer is already known."""
    def pair(s: Column, i: Column) -> Column:
        oj = F.get(pairs, i)
        e = F.get(tops, oj)
        fixed = (s["classification"] == "FIXED") & (s["expected"] != "")
        table = (s["classification"] == "REPEATABLE_TABLE") & (e["type"] == "table")
        return F.when(oj < 0, None).when(
            fixed, F.struct(X.stripped(e["text"]).alias("a"), s["expected"].alias("b"))
        ).when(
            table, F.struct(
                F.lower(F.array_join(e["table_structure"]["headers"], " | ")).alias("a"),
                F.lower(F.array_join(s["headers"], " | ")).alias("b"),
            )
        )

    both = F.transform(specs, pair)
    return both, F.transform(both, lambda p: F.when(p["a"] != p["b"], p))


def compare(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """Documents beside their template's specs with ``nodes``: per spec the
    aligned element ``e`` (node id, type, text and table; null when missing), the
    similarity ``sim`` and the ``value``.

    While Python works at a batch its rows wait in a queue, on disk where memory runs
    short.  So they go there without specs, and with what is read of their elements only;
    the specs join again afterwards, by the number of the layout's row."""
    laid_out = with_layout(documents)
    pairs = staged_pairs(laid_out, templates)
    aligned = laid_out.join(pairs, ["group_id", "layout"])
    both, open_ = _differing_texts(F.col("specs"), F.col("tops"), F.col("pairs"))

    def asked(s: Column, i: Column) -> Column:
        value = X.extract_value(F.get("tops", F.get("pairs", i))["text"], s["static_prefix"])
        return F.transform(
            F.filter(s["f_rules"], lambda r: r["rule_type"] == "regex"),
            lambda r: F.struct(F.nullif(r["params"]["pattern"], F.lit("")).alias("p"), value.alias("v")))

    # Patterns are data, so all of a document's are matched at once and handed back in order.
    light = aligned.select(
        "group_id", "doc_id", "doc_seq", "pairs_row", F.transform("tops", _as_read).alias("tops"),
        open_.alias("_open"), F.flatten(F.transform("specs", asked)).alias("_asked"))
    some, due = F.exists("_open", lambda p: p.isNotNull()), F.size("_asked") > 0
    told = light.withColumns({
        "_sims": S.similarity_lists(
            F.when(some, F.transform("_open", lambda p: p["a"])), F.when(some, F.transform("_open", lambda p: p["b"]))),
        "_told": pattern_matches(
            F.when(due, F.transform("_asked", lambda a: a["p"])), F.when(due, F.transform("_asked", lambda a: a["v"]))),
    }).drop("_open")
    step = told.join(pairs.select("pairs_row", "specs", "pairs", "anchors"), "pairs_row")

    def node(s: Column, i: Column) -> Column:
        oj = F.get("pairs", i)
        e = F.when(oj >= 0, F.get("tops", oj))
        return F.struct(
            s.alias("s"), e.alias("e"), F.coalesce(F.get("_sims", i), F.lit(1.0)).alias("sim"),
            X.extract_value(e["text"], s["static_prefix"]).alias("value"),
        )

    answers = F.map_from_entries(F.array_distinct(F.coalesce(
        F.transform(F.arrays_zip(F.col("_asked").alias("a"), F.col("_told").alias("t")), lambda z: F.struct(
            _pattern_key(z["a"]["p"], z["a"]["v"]).alias("k"), z["t"].alias("t"))),
        F.array().cast("array<struct<k:string,t:string>>"))))
    return step.withColumn("nodes", F.transform("specs", node)).withColumn("matches", answers).select(
        "group_id", "doc_id", "doc_seq", "tops", "pairs", "anchors", "nodes", "matches")


def _as_read(e: Column) -> Column:
    """What comparing, scoring and routing read of an element."""
    ts = e["table_structure"]
    table = F.when(ts.isNotNull(), F.struct(*[ts[c].alias(c) for c in ("n_rows", "headers", "rows")]))
    return F.when(e.isNotNull(), F.struct(*[e[c].alias(c) for c in ("node_id", "type", "text")], table.alias("table_structure")))


def _pattern_key(pattern: Column, value: Column) -> Column:
    """One name for a pattern with the value it is matched to."""
    p, v = F.coalesce(pattern, F.lit("")), F.coalesce(value, F.lit(""))
    return F.concat(F.length(p).cast("string"), F.lit(":"), p, v)


def _result(dim: str, weight: Column, got: Column, difference: Column) -> Column:
    return F.struct(
        F.lit(dim).alias("dimension"), weight.cast("double").alias("total"), got.cast("double").alias("satisfied"),
        difference.alias("difference"),
    )


DIFFERENCE = (
    "struct<kind:string,node_id:string,field_name:string,severity:string,expected:string,found:string,message:string>"
)


def _difference(kind: str, s: Column, severity: str, message: Column, *, field: bool = False,
                expected: Column | None = None, found: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), s["node_id"].alias("node_id"),
        (s["name"] if field else F.lit(None).cast("string")).alias("field_name"), F.lit(severity).alias("severity"),
        (expected if expected is not None else F.lit(None).cast("string")).alias("expected"),
        (found if found is not None else F.lit(None).cast("string")).alias("found"), message.alias("message"),
    ).cast(DIFFERENCE)


def _none() -> Column:
    return F.lit(None).cast(DIFFERENCE)


def score_fixed(n: Column) -> Column:
    """Boilerplate: 1 when it matches, 0.3 when altered, 0 when gone."""
    s, e = n["s"], n["e"]
    want = s["expected"]
    altered = _difference(
        "changed_fixed", s, "warning",
        F.concat(F.lit("Fixed content was modified (similarity "), F.floor(n["sim"] * 100).cast("string"), F.lit("%).")),
        expected=F.substring(want, 1, 120), found=F.substring(X.stripped(e["text"]), 1, 120),
    )
    gone = _difference(
        "missing_fixed", s, "error",
        F.concat(F.lit("Expected fixed content is missing: “"), F.substring(want, 1, 60), F.lit("”")),
        expected=F.substring(want, 1, 120),
    )
    one = F.lit(1.0)
    return (
        F.when(e.isNull(), _result("structure", one, F.lit(0.0), gone))
        .when(n["sim"] >= V.FIXED_MATCH, _result("structure", one, one, _none()))
        .otherwise(_result("structure", one, F.lit(0.3), altered))
    )


def score_field(n: Column, matches: Column) -> Column:
    """A value: weight 2 when required, else 1; a badly formed one counts half.
    ``matches`` holds the answers of the regex rules."""
    s = n["s"]
    weight = F.when(s["required"], 2.0).otherwise(1.0)
    quoted = F.concat(F.lit("“"), s["name"], F.lit("”"))
    value = F.coalesce(n["value"], F.lit(""))

    def failure(r: Column) -> Column:
        answer = F.try_element_at(matches, _pattern_key(r["params"]["pattern"], n["value"]))
        pattern = F.when((r["rule_type"] == "regex") & (F.coalesce(r["params"]["pattern"], F.lit("")) != ""), answer)
        return F.coalesce(pattern_failure(r, s["label"], pattern), rule_failure(r, s["label"], value))

    problem = F.get(F.array_compact(F.transform(s["f_rules"], failure)), F.lit(0))
    required_gone = _difference(
        "missing_field", s, "error", F.concat(F.lit("Required field "), quoted, F.lit(" has no value.")), field=True)
    optional_gone = _difference(
        "missing_field", s, "info", F.concat(F.lit("Optional field "), quoted, F.lit(" is empty.")), field=True)
    bad = _difference("format", s, "warning", problem["message"], field=True, found=F.substring(value, 1, 80))
    return (
        F.when((value == "") & s["required"], _result("fields", weight, F.lit(0.0), required_gone))
        .when(value == "", _result("fields", weight, weight, optional_gone))
        .when(problem.isNotNull(), _result("fields", weight, weight * 0.5, bad))
        .otherwise(_result("fields", weight, weight, _none()))
    )


def score_table(n: Column) -> Column:
    """A repeating table: 2 with data under matching headers, 1 without either."""
    s, e = n["s"], n["e"]
    ts = e["table_structure"]
    quoted = F.concat(F.lit("“"), s["name"], F.lit("”"))
    gone = _difference("missing_table", s, "error", F.concat(F.lit("Expected table "), quoted, F.lit(" is missing.")), field=True)
    empty = _difference("table_shape", s, "warning", F.concat(F.lit("Table "), quoted, F.lit(" has no data rows.")), field=True)
    other = _difference(
        "table_shape", s, "warning", F.concat(F.lit("Table "), quoted, F.lit(" columns differ from the template.")), field=True,
        expected=F.array_join(s["headers"], ", "), found=F.array_join(ts["headers"], ", "),
    )
    two = F.lit(2.0)
    return (
        F.when(ts.isNull() | (e["type"] != "table"), _result("tables", two, F.lit(0.0), gone))
        .when(ts["n_rows"] < 2, _result("tables", two, F.lit(1.0), empty))
        .when(n["sim"] >= V.HEADER_MATCH, _result("tables", two, two, _none()))
        .otherwise(_result("tables", two, F.lit(1.0), other))
    )


def _scored(n: Column, matches: Column) -> Column:
    s = n["s"]
    return (
        F.when((s["classification"] == "FIXED") & (s["expected"] != ""), score_fixed(n))
        .when(s["classification"] == "REPEATABLE_TABLE", score_table(n))
        .when(s["classification"].isin(*V.DYNAMIC), score_field(n, matches))
    )


PAIR = (
    "struct<node_id:string,classification:string,status:string,severity:string,field_name:string,"
    "template_text:string,document_text:string,is_table:boolean,template_headers:array<string>,document_headers:array<string>>"
)
_NO_HEADERS = "array<string>"


def _pair(n: Column) -> Column:
    """Side-by-side row of one template node."""
    s, e = n["s"], n["e"]
    cls = s["classification"]
    ts = e["table_structure"]
    is_table = (cls == "REPEATABLE_TABLE")
    no_table = ts.isNull() | (e["type"] != "table")
    value, none = F.coalesce(n["value"], F.lit("")), F.array().cast(_NO_HEADERS)
    status = (
        F.when(cls == "FIXED", F.when(e.isNull(), "missing").when(n["sim"] >= V.FIXED_MATCH, "match").otherwise("changed"))
        .when(is_table, F.when(no_table, "missing_table").when(n["sim"] >= V.HEADER_MATCH, "table").otherwise("table_changed"))
        .otherwise(F.when(s["required"] & (value == ""), "field_missing").otherwise("field"))
    )
    severity = (
        F.when(status.isin("missing", "missing_table", "field_missing"), "error")
        .when(status.isin("changed", "table_changed"), "warning").otherwise("info")
    )
    shown = F.when(
        is_table & ~no_table, F.concat(F.greatest(ts["n_rows"] - 1, F.lit(0)).cast("string"), F.lit(" data row(s)"))
    ).when(~is_table, X.stripped(e["text"])).otherwise("")
    return F.struct(
        s["node_id"].alias("node_id"), cls.alias("classification"), status.alias("status"), severity.alias("severity"),
        F.when(cls != "FIXED", s["name"]).alias("field_name"), F.when(~is_table, s["expected"]).otherwise("").alias("template_text"),
        shown.alias("document_text"), is_table.alias("is_table"), F.when(is_table, F.coalesce(s["headers"], none)).otherwise(none).alias("template_headers"),
        F.when(is_table & ~no_table, ts["headers"]).otherwise(none).alias("document_headers"),
    ).cast(PAIR)


def _extra(tops: Column, pairs: Column, nodes: Column) -> Column:
    """Document content no scored template node lines up with (a table is listed
    only where it has a text of its own), by one difference of index sets."""
    used = F.transform(
        F.filter(F.arrays_zip(pairs.alias("oj"), nodes.alias("n")),
                 lambda z: ~F.coalesce(z["n"]["s"]["classification"], F.lit("UNKNOWN")).isin("AUTO_FIELD", "UNKNOWN")),
        lambda z: z["oj"],
    )
    every = F.when(F.size(tops) > 0, F.sequence(F.lit(0), F.size(tops) - 1)).otherwise(F.array().cast("array<int>"))
    loose = F.filter(F.transform(F.array_except(every, used), lambda i: F.get(tops, i)), lambda e: ~X.is_blank(e["text"]))
    none, nothing = F.array().cast(_NO_HEADERS), F.lit(None).cast("string")

    def row(e: Column) -> Column:
        table = e["type"] == "table"
        return F.struct(
            e["node_id"].alias("node_id"), nothing.alias("classification"), F.lit("extra").alias("status"),
            F.lit("info").alias("severity"), nothing.alias("field_name"), F.lit("").alias("template_text"),
            F.when(table, "(table not in template)").otherwise(F.substring(X.strip(e["text"]), 1, 400)).alias("document_text"),
            table.alias("is_table"), none.alias("template_headers"),
            F.when(table, F.coalesce(e["table_structure"]["headers"], none)).otherwise(none).alias("document_headers"),
        ).cast(PAIR)

    return F.transform(loose, row)


def _percent(satisfied: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * satisfied / total, 1)).otherwise(100.0)


def check_compliance(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """One report per document against its group's template.

    Columns: ``score, grade, fixable, dimensions, differences, matched_fields,
    missing_fields, alignment``.
    """
    compared = compare(documents, templates)
    scored = compared.withColumn("_parts", F.array_compact(F.transform("nodes", lambda n: _scored(n, F.col("matches")))))

    def total(dim: str | None, what: str) -> Column:
        parts = F.col("_parts") if dim is None else F.filter("_parts", lambda p: p["dimension"] == dim)
        return F.aggregate(F.transform(parts, lambda p: p[what]), F.lit(0.0), lambda acc, x: acc + x)

    # Parts of a point add up inexactly in binary; tidy the sums before rounding.
    sums = scored
    for dim in DIMENSIONS:
        sums = sums.withColumn(f"_{dim}_s", F.round(total(dim, "satisfied"), 6)).withColumn(f"_{dim}_t", total(dim, "total"))
    got = sum((F.col(f"_{d}_s") for d in DIMENSIONS), F.lit(0.0))
    due = sum((F.col(f"_{d}_t") for d in DIMENSIONS), F.lit(0.0))
    sums = sums.withColumn("score", _percent(F.round(got, 6), due))
    dynamic = F.filter("nodes", lambda n: n["s"]["classification"].isin(*V.DYNAMIC))
    filled = F.filter(dynamic, lambda n: F.coalesce(n["value"], F.lit("")) != "")
    unfilled = F.filter(dynamic, lambda n: (F.coalesce(n["value"], F.lit("")) == "") & n["s"]["required"])
    paired = F.filter(
        "nodes", lambda n: n["s"]["classification"].isin("REPEATABLE_TABLE", *V.DYNAMIC)
        | ((n["s"]["classification"] == "FIXED") & (n["s"]["expected"] != "")),
    )
    differences = F.array_compact(F.transform("_parts", lambda p: p["difference"]))
    return sums.select(
        "group_id", "doc_id", "doc_seq", "score",
        F.when(F.col("score") >= 90, "pass").when(F.col("score") >= 70, "warning").otherwise("fail").alias("grade"),
        F.coalesce(
            F.exists("_parts", lambda p: p["difference"]["kind"].isin("changed_fixed", "missing_fixed")), F.lit(False)
        ).alias("fixable"),
        F.array(*[
            F.struct(F.lit(d).alias("name"), F.col(f"_{d}_s").alias("satisfied"), F.col(f"_{d}_t").alias("total"),
                     _percent(F.col(f"_{d}_s"), F.col(f"_{d}_t")).alias("score"))
            for d in DIMENSIONS
        ]).alias("dimensions"),
        differences.alias("differences"),
        F.transform(filled, lambda n: n["s"]["name"]).alias("matched_fields"),
        F.transform(unfilled, lambda n: n["s"]["name"]).alias("missing_fields"),
        F.concat(F.transform(paired, _pair), _extra(F.col("tops"), F.col("pairs"), F.col("nodes"))).alias("alignment"),
    )


def actionable(reports: DataFrame) -> DataFrame:
    """Alignment rows somebody has to look at."""
    due = F.filter("alignment", lambda p: p["status"].isin("changed", "missing", "field_missing"))
    return reports.select("group_id", "doc_id", inlined(due)).withColumn(
        "highlight_left", X.norm_text("template_text")
    ).withColumn("highlight_right", X.norm_text("document_text"))


def inlined(rows: Column) -> Column:
    """The rows of an array.  Spark tests a plain column for emptiness first, below the
    projection that makes it, so a report would be made twice; it leaves expressions alone."""
    return F.inline(F.filter(rows, lambda r: r.isNotNull()))


def apply_verdicts(reports: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Merge a judge's verdicts ``(group_id, doc_id, index, severity, material,
    rationale)``, with an optional ``ord``, into the differences and add the
    ``semantic`` dimension; score and grade stay.

    Several verdicts on one difference are applied one after the other, by ``ord``
    (else by their values): the last valid severity holds, every rationale is
    appended, each counts as judged.  A report without differences is left alone."""
    ord_ = F.col("ord").cast("bigint") if "ord" in verdicts.columns else F.lit(0).cast("bigint")
    packed = verdicts.groupBy("group_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("index").cast("int").alias("index"), ord_.alias("ord"), "severity", "rationale", "material"))).alias("verdicts"))
    none = F.array().cast("array<struct<index:int,ord:bigint,severity:string,rationale:string,material:boolean>>")
    j = reports.join(packed, ["group_id", "doc_id"], "left").withColumn("verdicts", F.coalesce("verdicts", none))

    def merged(d: Column, i: Column) -> Column:
        own = F.filter("verdicts", lambda v: v["index"] == i)
        severities = F.filter(F.transform(own, lambda v: v["severity"]), lambda s: s.isin(*V.SEVERITIES))
        reasons = F.filter(F.transform(own, lambda v: v["rationale"]), lambda r: F.coalesce(r != "", F.lit(False)))
        return d.withField("severity", F.coalesce(F.try_element_at(severities, F.lit(-1)), d["severity"])).withField(
            "message", F.concat_ws(". ", F.nullif(d["message"], F.lit("")), F.nullif(F.array_join(reasons, ". "), F.lit(""))))

    n = F.size("differences")
    valid = F.filter("verdicts", lambda v: (v["index"] >= 0) & (v["index"] < n))
    judged = F.when(F.size(valid) > 0, F.size(valid)).otherwise(n).cast("double")
    material = F.size(F.filter(valid, lambda v: F.coalesce(v["material"], F.lit(False)))).cast("double")
    semantic = F.struct(F.lit("semantic").alias("name"), (judged - material).alias("satisfied"), judged.alias("total"),
                        F.round(100.0 * (1 - material / judged), 1).alias("score"))
    return j.withColumn(
        "dimensions", F.when(n > 0, F.concat("dimensions", F.array(semantic))).otherwise(F.col("dimensions"))
    ).withColumn("differences", F.transform("differences", merged)).drop("verdicts")


def fix_boilerplate(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """Documents with altered boilerplate replaced and missing boilerplate put
    back after the last paragraph lined up before it; ``n_fixed`` counts both.
    Nested elements stay with their tables."""
    compared = compare(documents, templates)

    def is_fixed(n: Column) -> Column:
        return (n["s"]["classification"] == "FIXED") & (n["s"]["expected"] != "")

    def is_par(e: Column) -> Column:
        return e.isNotNull() & (e["type"] != "table")

    indexed = F.arrays_zip(F.col("nodes").alias("n"), F.col("pairs").alias("oj"), F.col("anchors").alias("anchor"))
    lacking = F.filter(indexed, lambda z: is_fixed(z["n"]) & z["n"]["e"].isNull() & (z["anchor"] >= 0))
    inserts = F.transform(lacking, lambda z: F.struct(
        z["anchor"].alias("at"), z["n"]["s"]["ri"].cast("int").alias("seq"), F.lit("paragraph").alias("type"),
        z["n"]["s"]["expected"].alias("text")))
    altered = F.filter(indexed, lambda z: is_fixed(z["n"]) & is_par(z["n"]["e"]) & (z["n"]["sim"] < V.FIXED_MATCH))
    changes = F.transform(altered, lambda z: F.struct(
        z["oj"].alias("at"), F.lit(-1).alias("seq"), z["n"]["e"]["type"].alias("type"), z["n"]["s"]["expected"].alias("text")))
    step = compared.withColumn("_inserts", inserts).withColumn("_changes", changes)
    # What stays, what is replaced and what is put in, brought into order by one sort.
    every = F.when(F.size("tops") > 0, F.sequence(F.lit(0), F.size("tops") - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.transform(
        F.array_except(every, F.transform("_changes", lambda c: c["at"])),
        lambda i: F.struct(i.alias("at"), F.lit(-1).alias("seq"), F.get("tops", i)["type"].alias("type"), F.get("tops", i)["text"].alias("text")))
    blocks = F.array_sort(F.concat(kept, "_changes", "_inserts"))
    return step.select(
        "group_id", "doc_id", "doc_seq",
        F.transform(blocks, lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"))).alias("blocks"),
        (F.size("_inserts") + F.size("_changes")).alias("n_fixed"),
    )


def candidate_templates(documents: DataFrame, templates: DataFrame, share: float = 0.5, by_layout: bool = False) -> DataFrame:
    """``(group_id, doc_id, template_id, version, shared)``: the templates that have at
    least ``share`` of their distinct signatures in common with a document.  With
    ``by_layout`` each layout of a group stands for its documents (``layout`` instead of ``doc_id``).

    ``templates(template_id, version, rep_sigs, ...)``.  An inverted index: a template
    can only qualify through one of its rarest signatures (all but those that it may
    miss), so only these are listed, and a layout meets the templates listed under its
    own signatures, never all.  Common signatures are looked up last, in the row.
    Work grows with distinct layouts, not with documents.
    """
    laid_out = with_layout(documents).select("group_id", "doc_id", "layout", "sigs", "doc_seq")
    grouped = stage(layouts_of(laid_out).select("group_id", "layout", "sigs"), "candidate-layouts")
    layouts = grouped.groupBy("layout").agg(F.first("sigs").alias("sigs"))
    held = stage(templates.select("template_id", "version", F.array_distinct("rep_sigs").alias("t_sigs")).withColumn(
        "t_need", F.ceil(F.size("t_sigs") * F.lit(share)).cast("int")).where("size(t_sigs) > 0"), "candidate-templates")
    each = held.select("template_id", "version", "t_need", F.size("t_sigs").alias("n"), F.explode("t_sigs").alias("sig"))
    frequency = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("template_id", "version").orderBy("df", "sig"))
    listed = each.join(frequency, "sig").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.col("t_need") + 1)
    met = layouts.select("layout", F.explode(F.array_distinct("sigs")).alias("sig")).join(
        listed.select("sig", "template_id", "version"), "sig").select("layout", "template_id", "version").distinct()
    shared = F.size(F.array_intersect("sigs", "t_sigs"))
    found = met.join(layouts, "layout").join(held, ["template_id", "version"]).withColumn("shared", shared).where("shared >= t_need")
    found = stage(found.select("layout", "template_id", "version", "shared"), "candidates")
    if by_layout:
        return grouped.join(found, "layout").select("group_id", "layout", "template_id", "version", "shared")
    return laid_out.join(found, "layout").select("group_id", "doc_id", "template_id", "version", "shared")


def check_assigned(documents: DataFrame, templates: DataFrame, assignments: DataFrame) -> DataFrame:
    """The reports of :func:`check_compliance` for every assignment, with ``template_id``
    and ``version`` beside ``group_id`` and ``doc_id``.

    ``templates(template_id, version, rep_sigs, specs)``, ``assignments(group_id, doc_id,
    template_id, version)``: a document may have none, one or several.  Each distinct
    layout is aligned once with each template it is assigned to.  Assignments with a
    ``layout`` instead of ``doc_id`` hold for all documents of that layout, which then
    need not be shuffled to meet them."""
    key = F.to_json(F.struct(F.col("template_id").cast("string"), F.col("version").cast("string")))
    keyed = templates.select(key.alias("group_id"), "rep_sigs", "specs")
    if "layout" in assignments.columns:
        due = stage(assignments.select("group_id", "layout", "template_id", "version").distinct(), "assignments")
        given = _carrying_layout(documents).where("doc_id IS NOT NULL").join(due, ["group_id", "layout"])
    else:
        due = assignments.select("group_id", "doc_id", "template_id", "version").distinct()
        given = documents.join(due, ["group_id", "doc_id"])
    given = given.withColumn("doc_id", F.struct("group_id", "doc_id", "template_id", "version"))
    reports = check_compliance(given.withColumn("group_id", F.to_json(F.struct(
        F.col("template_id").cast("string"), F.col("version").cast("string")))).drop("template_id", "version"), keyed)
    return reports.select("doc_id.*", *[c for c in reports.columns if c not in ("group_id", "doc_id")])


def _carrying_layout(documents: DataFrame) -> DataFrame:
    """Documents with the columns of :data:`LAYOUT` beside their elements."""
    if set(LAYOUT) <= set(documents.columns):
        return documents
    return with_layout(documents.withColumn("_whole", F.col("elements"))).drop("tops").withColumnRenamed("_whole", "elements")
