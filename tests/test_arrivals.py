"""Streams that stop, fail, start again and see a file twice."""

import os

import pytest
from pyspark.sql import functions as F

from formloom.operators import compliance as K
from formloom.operators.elements import content_hash, explode_documents
from formloom.plans.analyze import analyze
from formloom.schemas import DOCUMENT_DDL
from formloom.sources.text import documents_from_text
from formloom.streaming import jobs as ST

from test_templates import reports


def arrive(spark, folder, rows, ddl="doc_id bigint, lang string, text string"):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)


def test_replayed_files_add_nothing(spark, tmp_path):
    inbox, out, progress = (str(tmp_path / n) for n in ("inbox", "out", "progress"))

    def run():
        raw = ST.arriving(spark, inbox, files_per_batch=1)
        docs = documents_from_text(raw, group="lang", key="doc_id", keep=["arrived"])
        once = ST.ingest_stream(docs).select("content_hash", F.inline("elements"))
        once.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(
            availableNow=True).start().awaitTermination()
        return sorted(r.text for r in spark.read.parquet(out).collect())

    first = [(1, "en", "TITLE\nbody"), (2, "en", "other"), (3, "en", "other"), (4, "en", None), (5, "en", " ")]
    arrive(spark, inbox, first)
    assert run() == ["TITLE", "body", "other"]
    arrive(spark, inbox, first)
    arrive(spark, inbox, [(9, "de", "TITLE\nbody"), (10, "en", "new")])
    assert run() == ["TITLE", "body", "new", "other"]
    assert run() == ["TITLE", "body", "new", "other"]


def test_reports_are_written_once(spark, tmp_path):
    docs = spark.createDataFrame(reports(), DOCUMENT_DDL)
    a = analyze(docs)
    specs = K.template_specs(a.representatives, a.classified, a.fields)
    inbox, out, progress = (str(tmp_path / n) for n in ("inbox", "out", "progress"))
    assert ST.streamed_reports(spark, specs, out).count() == 0
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    for part in (ids[:1], ids[1:]):
        docs.where(F.col("doc_id").isin(part)).coalesce(1).write.mode("append").parquet(inbox)
    write = ST.epoch_sink(out)

    def failing(batch, epoch):
        write(batch, epoch)
        if epoch == 1:
            raise RuntimeError("lost after the reports were written, before the batch was noted")

    arrivals = lambda: ST.arriving(spark, inbox, files_per_batch=1).drop("arrived")
    with pytest.raises(Exception, match="lost after"):
        ST.compliance_stream(arrivals(), specs, out, progress, failing).awaitTermination()
    assert sorted(os.listdir(out)) == ["epoch=0", "epoch=1"]
    ST.compliance_stream(arrivals(), specs, out, progress).awaitTermination()
    got = {r.doc_id: r.score for r in ST.streamed_reports(spark, specs, out).collect()}
    assert ST.streamed_reports(spark, specs, out).count() == len(ids)
    assert got == {r.doc_id: r.score for r in K.check_compliance(docs, specs).collect()}


def test_hash_tells_contents_apart(spark):
    docs = documents_from_text(spark.createDataFrame([(1, "a", "x\ny"), (2, "a", "x y"), (3, "b", "x\n\n y")], "doc_id bigint, lang string, text string"),
                               group="lang", key="doc_id")
    h = {r.doc_id: r.content_hash for r in content_hash(docs).collect()}
    assert h["1"] == h["3"] != h["2"]
    assert explode_documents(docs).count() == 5
