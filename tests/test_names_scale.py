"""Joins by name at size: merged, and only over lengths that occur."""

from formloom.operators import naming as N


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()

def test_names_are_joined_without_broadcast(spark):
    names = [("t", f"name {c}{c}{c}") for c in "abcdef"]
    residue = spark.createDataFrame([(t, n + "x") for t, n in names], "template_id string, slug string")
    keys = spark.createDataFrame([(t, n, n, i) for i, (t, n) in enumerate(names)], "template_id string, key string, field_name string, rank int")
    assert "Broadcast" not in plan(N.near_pairs(residue, keys, 0.8))
    assert "Broadcast" not in plan(N.closest_keys(residue, keys, 0.8))
    assert {(r.slug, r.near) for r in N.closest_keys(residue, keys, 0.8).collect()} >= {(n + "x", n) for _, n in names}
    fields = spark.createDataFrame([("t", "first_name", 1, None), ("t", "other", 2, None)], "template_id string, field_name string, field_order int, section_key string")
    sections = spark.createDataFrame([("t", "s1", 1, ["first_nam"])], "template_id string, section_key string, section_order int, field_names array<string>")
    found = N.resolve_section_keys(fields, sections)
    assert "Broadcast" not in plan(found)
    assert {(r.field_name, r.section_key) for r in found.collect()} == {("first_name", "s1"), ("other", "s1")}
