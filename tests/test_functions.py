"""Literal cases of the value, name and text functions."""

from pyspark.sql import functions as F

from formloom.functions import jsontext as J
from formloom.functions import richtext as R
from formloom.functions import similarity as S
from formloom.functions import text as X
from formloom.functions import values as N
from formloom.functions.register import register_functions


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_dates(spark):
    texts = ["2026-06-01", "Report Date: 2026-06-01", "June 1, 2026", "hello world", None]
    assert column(spark, texts, X.detect_date) == [True, True, True, False, False]


def test_value_kinds(spark):
    texts = ["2026-06-01", "$2,300.00", " 42 ", "Jane Smith", "some free text here", "", "INVOICE", "50 %"]
    assert column(spark, texts, X.value_kind) == ["date", "number", "number", "person", "text", "text", "text", "number"]


def test_people(spark):
    texts = ["Jane Smith", "John D. Doe", "INVOICE", "the quick brown fox", "Jane Smith\n"]
    assert column(spark, texts, X.looks_like_person) == [True, True, False, False, True]


def test_slugs(spark):
    texts = ["Project Name:", "Total (USD)", "Report Date: 2026-06-01", "", "The An", "2nd the item", "one two three four five six"]
    assert column(spark, texts, X.slug) == [
        "project_name", "total_usd", "report_date", "field", "the_an", "f_2nd_item", "one_two_three_four_five"]


def test_hints_keep_order(spark):
    got = column(spark, ["TOTAL: $5 ON 2026-01-02:", "a@b.co", "  "], X.semantic_hints)
    assert got == [["label", "all_caps", "date", "currency"], ["email"], []]


def test_normalisers(spark):
    assert column(spark, ["June 1 2026", "no date"], lambda t: N.normalize_date(t)["iso"]) == ["2026-06-01", None]
    assert column(spark, ["$5,000.00", "no digits", "2.5 kg"], lambda t: N.normalize_number(t)["number"]) == ["5000", None, "2.5"]
    assert column(spark, ["$1,200.00", "1.2.3", "-", "n/a"], N.parse_number) == [1200.0, None, None, None]
    assert column(spark, ["01/06/2026", "June 1, 2026", "not a date", ""], N.is_valid_date) == [True, True, False, False]


def test_extract_value(spark):
    got = column(spark, ["Date: x", "date :  y", "DATE z", "other"], lambda t: X.extract_value(t, F.lit("Date: ")))
    assert got == ["x", "y", "z", "other"]


def test_similarity_is_order_sensitive_and_exact_for_equal_texts(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("x" * 300, "x" * 300), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(S.similarity("a", "b")).collect()] == [0.25, 0.5, 1.0, 1.0]
    assert [r[0] for r in df.select(S.similar_enough("a", "b", 0.5)).collect()] == [False, True, True, True]


def test_rich_text(spark):
    assert column(spark, ["plain", "a\nb", "- x", "5 * 4", "see *this*", ""], R.is_rich) == [False, True, True, False, True, False]
    blocks = column(spark, ["intro\n\n  - **b** item\n2. two"], R.blocks)[0]
    assert [(b.kind, b.level, b.marker, b.text) for b in blocks] == [
        ("paragraph", 0, "", "intro"), ("bullet", 1, "•", "**b** item"), ("number", 0, "2.", "two")]
    spans = column(spark, ["a **b** c *d*"], R.spans)[0]
    assert [(s.text, s.bold, s.italic) for s in spans] == [("a ", False, False), ("b", True, False), (" c ", False, False), ("d", False, True)]
    assert column(spark, ["1. **x** y"], R.strip_markers) == ["x y"]


def test_json_answers(spark):
    texts = [
        '{"a": 1}', '```json\n{"a": 2}\n```', '<think>{"no": 0}</think>{"a": 3}', 'Sure: {"a": 4} ok', '{"a": 5, "b": [1, 2',
        '{"a": [{"x": 1}, {"x": 2}, {"x"', "[1, 2, 3", "<think>never closed {", "no json here",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.js for r in J.extract_json(df, "t", "js").orderBy("i").collect()]
    assert got == ['{"a": 1}', '{"a": 2}', '{"a": 3}', '{"a": 4}', '{"a": 5, "b": [1]}', '{"a": [{"x": 1}, {"x": 2}]}', "[1, 2]", None, None]


def test_lenient_rows(spark):
    df = spark.createDataFrame([(1, '{"id": "n1", "tags": null}'), (2, '{"tags": ["x"]}'), (3, "broken")], "k int, js string")
    rows, rejects = J.lenient(df, "js", "id string, note string, tags array<string>", "id")
    assert [(r.k, r.id, r.note, r.tags) for r in rows.collect()] == [(1, "n1", "", [])]
    assert sorted(r.k for r in rejects.collect()) == [2, 3]


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT value_kind('$5'), slugify_field('Total (USD)'), detect_date('June 1, 2026'), parse_number('$1,200.50'), similarity('tide', 'diet')").first()
    assert tuple(row) == ("number", "total_usd", True, 1200.5, 0.25)
