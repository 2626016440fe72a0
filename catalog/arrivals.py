"""Documents that arrive as a stream: taken in once, scored on arrival."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import common as C
from catalog import compliance as CC
from formloom.operators import compliance as K
from formloom.session import shared_dir
from formloom.sources import text as S
from formloom.streaming import jobs as ST

BIG = "bigint"


def _place(spark):
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def ingested_texts(spark, d):
    """Every content among the texts, taken in as a stream and stored once."""
    place = _place(spark)
    raw = ST.arriving(spark, f"{d}/documents.parquet")
    docs = S.documents_from_text(raw, group="lang", key="doc_id", keep=["arrived"])
    chars = F.aggregate("elements", F.lit(0).cast(BIG), lambda n, e: n + F.length(e["text"]))
    once = ST.ingest_stream(docs).select("content_hash", F.coalesce(F.size("elements"), F.lit(0)).cast(BIG).alias("n_elements"),
                                         F.coalesce(chars, F.lit(0).cast(BIG)).alias("chars"))
    once.writeStream.format("parquet").option("path", f"{place}/texts").option("checkpointLocation", f"{place}/progress").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/texts")


def arriving_compliance(spark, d):
    """Received forms scored as their orders arrive."""
    place = _place(spark)
    specs = CC.published(C.staged_forms(spark, d))["specs"]
    orders = ST.arriving(spark, f"{d}/orders.parquet")
    docs = CC.received(S.order_forms(orders, C.table(spark, d, "customer"), C.table(spark, d, "lineitem")))
    ST.compliance_stream(docs, specs, f"{place}/reports", f"{place}/progress").awaitTermination()
    r = ST.streamed_reports(spark, specs, f"{place}/reports")
    dims = {n: F.get(F.col("dimensions"), F.lit(i))["score"] for i, n in enumerate(K.DIMENSIONS)}
    return r.select("group_id", "doc_id", "score", "grade", "fixable", *[c.alias(n) for n, c in dims.items()],
                    F.array_join("matched_fields", ",").alias("matched"), F.array_join("missing_fields", ",").alias("missing"))


QUERIES = {f.__name__: f for f in (ingested_texts, arriving_compliance)}

ORACLES = {
    "ingested_texts": f"""WITH {C.LINES_SQL}, t AS (SELECT doc_id, pos, line,
        CASE WHEN upper(line) = line AND lower(line) <> line AND length(line) > 2 AND length(line) < 80 THEN 'heading'
             WHEN regexp_matches(line, '^(?:[-*•]|[0-9]+[.)])\\s') THEN 'list_item' ELSE 'paragraph' END AS type FROM lines)
        SELECT DISTINCT content_hash, n_elements, chars FROM (
          SELECT d.doc_id, sha256(coalesce(string_agg(type || ':' || line || chr(10), '' ORDER BY pos), '')) AS content_hash,
                 count(line) AS n_elements, coalesce(sum(length(line)), 0)::BIGINT AS chars
          FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id)""",
    # Scored on arrival or all at once, the reports are the same.
    "arriving_compliance": CC.ORACLES["form_compliance"],
}
