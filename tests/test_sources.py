"""Files, packages, JSON columns and streams on small inputs."""

import pytest
from pyspark.sql import functions as F

from formloom.sources import files as FL
from formloom.sources import jsoncols as JC
from formloom.sources import packages as PK
from formloom.streaming import jobs as ST


def test_files(spark, tmp_path):
    box = tmp_path / "uploads" / "incoming" / "u1"
    other = tmp_path / "x" / "uploads" / "incoming" / "u1"
    for folder in (box, other):
        folder.mkdir(parents=True)
    (box / "good.DOCX").write_bytes(b"abc")
    (other / "note.txt").write_text("x")
    (other / "far.docx").write_bytes(b"x")
    reasons = {r.key.rsplit("/", 1)[1]: r.reason for r in FL.reject_report(spark, str(tmp_path)).collect()}
    assert reasons == {"note.txt": "Only .docx files are supported"}
    got = FL.read_accepted(spark, str(tmp_path))
    assert sorted((r.filename, r.size) for r in got.collect()) == [("far.docx", 1), ("good.DOCX", 3)]
    assert [r.filename for r in FL.claim_incoming(got, "u1", str(tmp_path)).collect()] == ["good.DOCX"]
    assert FL.stat_files(spark, str(tmp_path)).count() == 3


def test_upload_checks(spark):
    rows = [("a.docx", 5), ("a.DOCX", 0), ("a.doc", 5), ("big.docx", 26 * 1024 * 1024)]
    df = spark.createDataFrame(rows, "filename string, size bigint").withColumn("why", FL.upload_problem())
    assert [r.why for r in df.collect()] == [
        None, "Uploaded file is empty", "Only .docx files are supported", "File exceeds the 25 MB upload limit"]


def test_packages(spark, tmp_path):
    base = str(tmp_path)
    fields = spark.createDataFrame([("a", "text")], "field_name string, field_type string")
    assert PK.publish_version(spark, base, "t1", {"fields": fields}, name="T")[0] == 1
    v, audit = PK.publish_version(spark, base, "t1", {"fields": fields.union(spark.createDataFrame([("b", "date")], fields.schema))}, name="T")
    PK.publish_version(spark, base, "t2", {"fields": fields}, name="U")
    assert v == 2 and "v2 with 2 field(s)" in audit.first().summary
    assert [r.version for r in PK.list_versions(spark, base, "t1").collect()] == [1, 2]
    assert PK.read_package(spark, base, "fields", "t1").count() == 2
    with pytest.raises(FileExistsError):
        PK.write_package({"fields": fields}, base, "t1", 2)
    assert PK.read_package(spark, base, "fields", "t1", 1).count() == 1
    assert PK.read_package(spark, base, "fields").count() == 3


def test_json_columns(spark):
    df = spark.createDataFrame([('{"k": 3}',), ("oops",)], "props string")
    assert [r.k for r in JC.json_member(df, "props", "$.k", "int", "k").collect()] == [3, None]
    back = JC.close_json(JC.open_json(df, "props", "k int"), "props")
    assert back.first().props == '{"k":3}'


def test_streams(spark, tmp_path):
    src = tmp_path / "calls"
    spark.createDataFrame([("2026-01-01 00:10:00", "u", "gpt-4o-x", 1000000, 0), ("2026-01-01 00:20:00", "u", "gpt-4o-x", 0, 1000000)],
                          "ts string, owner_id string, model string, in_tokens bigint, out_tokens bigint").write.parquet(str(src))
    calls = spark.readStream.schema("ts string, owner_id string, model string, in_tokens bigint, out_tokens bigint").parquet(str(src)).withColumn("ts", F.col("ts").cast("timestamp"))
    q = ST.usage_stream(calls).writeStream.outputMode("update").format("memory").queryName("used").option(
        "checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    row = spark.table("used").first()
    assert (row.calls, row.cost_usd) == (2, 12.5)
