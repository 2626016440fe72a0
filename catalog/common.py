"""Loading the given tables, and SQL pieces the oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.operators.align import LAYOUT, with_layout
from formloom.session import spread, stage
from formloom.sources import text as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows need heavy per-row work, on all cores."""
    return spread(table(spark, sf_dir, name))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order form per order (documents), for a query that reads them once."""
    return S.forms_of(_order_rows(spark, sf_dir))


def staged_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for several passes.  The rows that forms are made from are written once,
    with their forms' layouts: else each pass joins the tables and makes signatures anew,
    and its shuffle files stay till the query ends."""
    return S.forms_of(staged_order_rows(spark, sf_dir), keep=LAYOUT)


def staged_order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`staged_forms`, for a query that makes other rows of them too."""
    return _staged_rows(_order_rows(spark, sf_dir))


def staged_forms_and(spark: SparkSession, sf_dir: str, change) -> tuple[DataFrame, DataFrame]:
    """:func:`staged_forms` and what ``change`` makes of them, each with its layouts."""
    rows = _staged_rows(_order_rows(spark, sf_dir), change)
    changed = change(S.forms_of(rows, keep=_CHANGED)).withColumnsRenamed(dict(zip(_CHANGED, LAYOUT)))
    return S.forms_of(rows, keep=LAYOUT), changed


_CHANGED = tuple(f"changed_{c}" for c in LAYOUT)


def _staged_rows(rows: DataFrame, change=None) -> DataFrame:
    """Order rows with their forms' layouts, and those of the changed forms."""
    given, told = rows.columns, [*rows.columns, *LAYOUT]
    laid_out = with_layout(S.forms_of(rows, keep=given).withColumn("_whole", F.col("elements")))
    if change is not None:
        back = change(laid_out.withColumnsRenamed(dict(zip(LAYOUT, ("_sigs", "_layout")))).withColumn("elements", F.col("_whole")).drop("tops"))
        laid_out = with_layout(back).withColumnsRenamed(dict(zip(LAYOUT, _CHANGED))).withColumnsRenamed(dict(zip(("_sigs", "_layout"), LAYOUT)))
        told += _CHANGED
    return stage(laid_out.select(*told), "order-rows", rows_per_file=25_000)


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.order_rows(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "lineitem")
    )


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per web page, grouped by the page's language."""
    return S.documents_from_html(
        wide(spark, sf_dir, "pages"), group=F.regexp_extract("html", '<html lang="([a-z]+)"', 1), key="page_id"
    )


# -- SQL pieces ------------------------------------------------------------------
#: Characters Python-style strip() removes, as a SQL expression.
BLANKS_SQL = (
    "(chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '"
    "||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)"
    "||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)"
    "||chr(8239)||chr(8287)||chr(12288))"
)


def strip_sql(x: str) -> str:
    return f"trim({x}, {BLANKS_SQL})"


#: documents.text as non-blank lines: (doc_id, lang, source, pos, line)
LINES_SQL = f"""
lines AS (
  SELECT doc_id, lang, source, pos, line FROM (
    SELECT doc_id, lang, source, unnest(range(len(parts))) AS pos, {strip_sql('unnest(parts)')} AS line
    FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents)
  ) WHERE line <> ''
)"""

MONTHS_SQL = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\\.?"


def has_date_sql(x: str) -> str:
    return (
        f"(regexp_matches({x}, '\\b\\d{{1,4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,4}}\\b') OR "
        f"regexp_matches({x}, '(?i)\\b(?:{MONTHS_SQL}\\s+\\d{{1,2}},?\\s+\\d{{2,4}}|\\d{{1,2}}\\s+{MONTHS_SQL}\\s+\\d{{2,4}})\\b'))"
    )


def has_currency_sql(x: str) -> str:
    return (
        f"regexp_matches({x}, '(?i)[$€£¥₹]\\s?\\d[\\d,]*(?:\\.\\d+)?|\\b\\d[\\d,]*(?:\\.\\d+)?\\s?(?:USD|EUR|GBP|AED|SAR|INR)\\b')"
    )


def has_percent_sql(x: str) -> str:
    return f"regexp_matches({x}, '\\b\\d+(?:\\.\\d+)?\\s?%')"


def is_number_sql(x: str) -> str:
    return f"regexp_full_match({x}, '[-+]?\\d[\\d,]*(?:\\.\\d+)?')"


def is_person_sql(x: str) -> str:
    return (
        f"(regexp_full_match({x}, '[A-Z][a-z]+(?:\\s+(?:[A-Z]\\.|[A-Z][a-z]+)){{1,2}}') "
        f"AND NOT (upper({x}) = {x} AND lower({x}) <> {x}))"
    )


def has_email_sql(x: str) -> str:
    return f"regexp_matches({x}, '[\\pL\\pN_.+-]+@[\\pL\\pN_-]+\\.[\\pL\\pN_.-]+')"


def kind_sql(x: str) -> str:
    return (
        f"CASE WHEN {has_date_sql(x)} THEN 'date' "
        f"WHEN {has_currency_sql(x)} OR {has_percent_sql(x)} OR {is_number_sql(x)} THEN 'number' "
        f"WHEN {is_person_sql(x)} THEN 'person' ELSE 'text' END"
    )


def slug_sql(x: str, fallback: str = "field", words: int = 5) -> str:
    """List-based slug, written independently of the engine's regex one."""
    head = f"string_split(lower(rtrim({strip_sql(x)}, ':')), ':')[1]"
    toks = f"list_filter(string_split_regex({head}, '[^a-z0-9]+'), lambda w: w <> '')"
    kept = f"list_filter({toks}, lambda w: w NOT IN ('the','a','an','and','or'))"
    chosen = f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {toks} END"
    joined = f"array_to_string(list_slice({chosen}, 1, {words}), '_')"
    return (
        f"CASE WHEN {joined} = '' THEN '{fallback}' "
        f"WHEN regexp_matches({joined}, '^[0-9]') THEN 'f_' || {joined} ELSE {joined} END"
    )


#: Order forms as element rows: els(group_id, doc_id, doc_seq, doc_order, type, subtype, text, headers, cells)
FORMS_SQL = f"""
line_rows AS (
  SELECT l_orderkey,
         list([l_partkey::VARCHAR, l_quantity::DECIMAL(18,0)::VARCHAR, l_extendedprice::DECIMAL(18,2)::VARCHAR]
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS cells
  FROM lineitem GROUP BY l_orderkey
), form_base AS (
  SELECT o.*, c_name, cells, o_totalprice > {S.CLAUSE_ABOVE} AS big
  FROM orders o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN line_rows ON l_orderkey = o_orderkey
), form_parts AS (
  SELECT *, list_filter([
    {{'type':'paragraph','text':'{S.FORM_TITLE}'}},
    {{'type':'paragraph','text':'Order Number: ' || o_orderkey}},
    {{'type':'paragraph','text':'Customer Name: ' || coalesce(c_name, '')}},
    {{'type':'paragraph','text':'Order Date: ' || strftime(o_orderdate, '%Y-%m-%d')}},
    {{'type':'paragraph','text':'Status: ' || o_orderstatus}},
    CASE WHEN big THEN {{'type':'paragraph','text':'{S.FORM_CLAUSE}'}} END,
    {{'type':'heading','text':'Line Items'}},
    {{'type':'table','text':''}},
    {{'type':'paragraph','text':'Total Due: $' || o_totalprice::DECIMAL(18,2)::VARCHAR}},
    {{'type':'heading','text':'Terms'}},
    {{'type':'paragraph','text':'{S.FORM_TERMS}'}}
  ], lambda x: x IS NOT NULL) AS parts FROM form_base
), els AS (
  SELECT o_orderpriority AS group_id, o_orderkey::VARCHAR AS doc_id, o_orderkey AS doc_seq,
         (i - 1)::INT AS doc_order, 'n' || lpad(i::VARCHAR, 4, '0') AS node_id,
         parts[i].type AS type, parts[i].text AS text, coalesce(len(cells), 0) AS n_lines, cells, big
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM form_parts)
)"""
