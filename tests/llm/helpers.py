"""Small tables for the operators' tests."""

from pyspark.sql import Row
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Names that operators might use themselves.
CLASHES = ("_key", "_text", "_doc", "_row", "rank", "node", "size", "lines", "rejected", "p", "copies", "shard", "digest", "piece")


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOCS)


def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(6000))
    return [
        (1, "one two three four five six seven eight nine ten", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"),
        (4, " \t\n\n ", "en", None), (5, long, "de", "b"), (6, "same\nsame\nother", "en", "a"), (6, "same\nsame\nother", "en", "a"),
        (6, "a different text under the same id", "fr", "c"), (None, "no id here", "en", None), (7, "Ünïcode 漢字 \U0001f600 x", "en", "a"),
        (8, "one two three four five six seven eight nine ten", None, "a"),
        (2**60 + 1, "far ids differ in their last digits only, so they must not become doubles", "en", "a"),
        (2**60 + 3, "ids that pandas would round beside a null one in the same batch of rows", "en", "a"),
    ]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in CLASHES if c not in df.columns})


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) if len(columns) > 1 else r[1] for r in df.select("doc_id", *columns).collect()}


def fixture_dir(spark, path, rows, labels=()):
    """A folder of Parquet tables, as the queries read them."""
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    kinds = "doc_id bigint, quality int, toxic int"
    spark.createDataFrame([Row(*x) for x in labels], kinds).write.parquet(f"{path}/labels.parquet")
    return str(path)
