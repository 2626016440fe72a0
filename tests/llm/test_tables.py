"""Every operator on odd and empty tables, with further columns under clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from formloom.llm import (
    html_extraction, line_dedup, merkle, minhash, mixing, packing, quality, sharding, token_counts, toxicity,
)

from .helpers import docs, odd_rows, with_clashes

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def chain(spark, d):
    return toxicity.train_chain(d, labels(spark), toxicity.label_categories())


OPERATORS = {
    "toxicity": lambda s, d: toxicity.classify(d, chain(s, d), reject=["toxic"]),
    "packing": lambda s, d: packing.pack(d, BYTES).where("piece = 0"),
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "quality": lambda s, d: quality.apply_rules(d, labels(s)),
    "mixing": lambda s, d: mixing.mix_sizes(d),
    "token_counts": lambda s, d: token_counts.count_tokens(d, WORDS, normalise=token_counts.collapsed),
    "merkle": lambda s, d: merkle.edited_fingerprints(d),
    "sharding": lambda s, d: sharding.shard(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = odd_rows()
    got = OPERATORS[name](spark, with_clashes(docs(spark, rows))).select("doc_id").collect()
    want = [i for i, *_ in rows]
    assert sorted(str(r[0]) for r in got) == sorted(map(str, want))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


def test_kept_columns(spark):
    d = with_clashes(docs(spark, odd_rows()))
    for made in (
        line_dedup.dedup_lines(d), mixing.mix(d),
        toxicity.classify(d, chain(spark, d), reject=["toxic"], keep=True).select(*d.columns),
    ):
        assert made.columns == d.columns
    assert {r._doc for r in line_dedup.dedup_lines(d).select("_doc").collect()} == {7}


def test_pages(spark):
    page = "<html><body><nav><a href=/>Menu</a></nav><article><p>A&amp;B &eacute;\n t</article><footer>end</footer>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<scr"), (5, "x", "<script>var a"), (None, "y", "<p>")]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = [(r.page_id, r.text, r.n_chars) for r in html_extraction.extract(d).collect()]
    assert got[:2] == [(1, "A&B é t", 7)] * 2
    assert [g[1:] for g in got[2:4]] == [("", 0)] * 2 and len(got) == 7 and got[5][1] == ""
    assert html_extraction.extract(d.limit(0)).collect() == []
