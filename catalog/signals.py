"""Text-signal, name and value functions over the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import common as C
from formloom.functions import jsontext as J
from formloom.functions import richtext as R
from formloom.functions import text as X
from formloom.functions import values as N


def _lines(spark, d):
    return C.wide(spark, d, "documents").select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "raw")
    ).select("doc_id", "lang", "source", "pos", X.strip("raw").alias("line")).where("line <> ''")


def text_lines(spark, d):
    return _lines(spark, d).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


def line_kinds(spark, d):
    return _lines(spark, d).groupBy("lang", X.value_kind("line").alias("kind")).agg(
        F.count(F.lit(1)).alias("n_lines")
    )


def line_signals(spark, d):
    line = F.col("line")
    return _lines(spark, d).groupBy("source").agg(
        F.count_if(X.detect_date(line)).alias("with_date"),
        F.count_if(X.detect_currency(line)).alias("with_currency"),
        F.count_if(X.detect_percent(line)).alias("with_percent"),
        F.count_if(X.detect_email(line)).alias("with_email"),
        F.count_if(X.is_pure_number(line)).alias("numbers"),
        F.count_if(X.looks_like_person(line)).alias("persons"),
        F.count_if(X.is_upper(line)).alias("all_caps"),
    )


def hint_counts(spark, d):
    hints = _lines(spark, d).select(F.explode(X.semantic_hints("line")).alias("hint"))
    return hints.groupBy("hint").agg(F.count(F.lit(1)).alias("n_lines"))


def line_slugs(spark, d):
    return _lines(spark, d).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), X.slug("line").alias("slug"),
        F.size(X.slug_tokens("line")).cast("bigint").alias("n_tokens"),
    )


def short_lines(spark, d):
    return _lines(spark, d).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"),
        X.shorten("line").alias("short"), X.redact("line").alias("redacted"),
        F.md5(X.norm_text("line")).alias("norm"),
        X.len_bucket(F.length("line")).cast("bigint").alias("bucket"),
    )


def part_columns(spark, d):
    p = C.table(spark, d, "part")
    return p.select(
        "p_partkey", X.column_type("p_name").alias("column_type"),
        X.label_is_personish("p_name").alias("personish"),
        X.include_field_name(F.lit(None).cast("string"), "p_name").alias("include_name"),
        X.section_toggle_name("p_type").alias("toggle"),
        X.safe_ident(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("ident"),
        X.safe_file_name(F.concat("p_brand", F.lit("/"), "p_name", F.lit("?.docx"))).alias("file_name"),
        X.output_name("p_name", F.concat(F.lit("request-"), F.col("p_partkey").cast("string"))).alias("output_name"),
        X.label_from(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(None).cast("string")).alias("label"),
        X.heading_subtype(F.concat(F.lit("Heading "), F.col("p_size").cast("string"))).alias("subtype"),
        X.cell_name("p_brand").alias("cell_name"),
        X.cell_row(F.concat(F.lit("r"), F.col("p_size").cast("string"), F.lit("c1"))).cast("bigint").alias("cell_row"),
    )


def extracted_values(spark, d):
    e = C.table(spark, d, "orders")
    text = F.concat(F.lit("order date:"), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" "))
    total = F.concat(F.lit("Total Due: $"), F.format_number("o_totalprice", 2))
    date = N.normalize_date(F.date_format("o_orderdate", "MMMM d, yyyy"))
    num = N.normalize_number(total)
    return e.select(
        "o_orderkey", X.extract_value(text, F.lit("Order Date: ")).alias("value"),
        N.is_valid_date(X.extract_value(text, F.lit("Order Date: "))).alias("date_ok"),
        date["iso"].alias("iso"), num["ok"].alias("number_ok"), num["number"].cast("double").alias("number"),
        N.parse_number(total).alias("parsed"),
    )


def rich_blocks(spark, d):
    texts = C.wide(spark, d, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("- **"), "role", F.lit("** says\n"), "text").alias("t")
    )
    return texts.select("conv_id", "turn", F.posexplode(R.blocks("t")).alias("pos", "b")).select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), F.col("b.kind").alias("kind"),
        F.col("b.level").cast("bigint").alias("level"), F.col("b.marker").alias("marker"),
        F.md5(R.without_emphasis(F.col("b.text"))).alias("text_md5"),
        F.size(R.spans(F.col("b.text"))).cast("bigint").alias("n_spans"),
    )


def answer_json(spark, d):
    """Model answers about events, some fenced, some after a thought, some cut."""
    e = C.table(spark, d, "events")
    body = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "kind": "'), "event_type",
                    F.lit('", "props": '), "props", F.lit("}"))
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("event_type") == "view", F.concat(F.lit("<think>hm {</think>"), body))
        .when(F.col("event_type") == "error", F.lit(""))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Sure: "), body, F.lit(" Done.")))
        .otherwise(F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "kind": "purchase", "props": '),
                            F.substring("props", 1, 4)))
    )
    answers = J.extract_json(e.select("event_id", text.alias("answer")), "answer", "js")
    return answers.select(
        "event_id", F.col("js").isNotNull().alias("parsed"),
        F.get_json_object("js", "$.user").cast("bigint").alias("user_id"),
        F.get_json_object("js", "$.kind").alias("kind"),
        F.get_json_object("js", "$.props.k").cast("bigint").alias("k"),
    )


QUERIES = {
    "text_lines": text_lines,
    "line_kinds": line_kinds,
    "line_signals": line_signals,
    "hint_counts": hint_counts,
    "line_slugs": line_slugs,
    "short_lines": short_lines,
    "part_columns": part_columns,
    "extracted_values": extracted_values,
    "rich_blocks": rich_blocks,
    "answer_json": answer_json,
}

_L = "line"
_CAPS = "(upper(line) = line AND lower(line) <> line)"
_ONE = f"trim(regexp_replace(line, '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+', ' ', 'g'))"
_SLUG_NAME = C.slug_sql("p_name", "section")

ORACLES = {
    "text_lines": f"WITH {C.LINES_SQL} SELECT doc_id, pos, line FROM lines",
    "line_kinds": f"WITH {C.LINES_SQL} SELECT lang, {C.kind_sql(_L)} AS kind, count(*) AS n_lines FROM lines GROUP BY ALL",
    "line_signals": f"""WITH {C.LINES_SQL} SELECT source,
        count(*) FILTER ({C.has_date_sql(_L)}) AS with_date, count(*) FILTER ({C.has_currency_sql(_L)}) AS with_currency,
        count(*) FILTER ({C.has_percent_sql(_L)}) AS with_percent, count(*) FILTER ({C.has_email_sql(_L)}) AS with_email,
        count(*) FILTER ({C.is_number_sql(_L)}) AS numbers, count(*) FILTER ({C.is_person_sql(_L)}) AS persons,
        count(*) FILTER ({_CAPS}) AS all_caps FROM lines GROUP BY source""",
    "hint_counts": f"""WITH {C.LINES_SQL}, h AS (SELECT unnest([
        CASE WHEN line LIKE '%:' THEN 'label' END, CASE WHEN {_CAPS} AND length(line) > 2 THEN 'all_caps' END,
        CASE WHEN {C.has_date_sql(_L)} THEN 'date' END, CASE WHEN {C.has_currency_sql(_L)} THEN 'currency' END,
        CASE WHEN {C.has_percent_sql(_L)} THEN 'percent' END, CASE WHEN {C.has_email_sql(_L)} THEN 'email' END,
        CASE WHEN {C.is_number_sql(_L)} THEN 'number' END, CASE WHEN {C.is_person_sql(_L)} THEN 'person' END
        ]) AS hint FROM lines) SELECT hint, count(*) AS n_lines FROM h WHERE hint IS NOT NULL GROUP BY hint""",
    "line_slugs": f"""WITH {C.LINES_SQL}, s AS (SELECT doc_id, pos, {C.slug_sql(_L)} AS slug, {C.slug_sql(_L, '')} AS bare FROM lines)
        SELECT doc_id, pos, slug,
        len(list_distinct(list_filter(string_split(bare, '_'), lambda w: w <> ''))) AS n_tokens FROM s""",
    "short_lines": f"""WITH {C.LINES_SQL}, f AS (SELECT *, {_ONE} AS flat FROM lines)
        SELECT doc_id, pos, CASE WHEN length(flat) <= 60 THEN flat ELSE rtrim(flat[1:60]) || '…' END AS short,
        CASE WHEN length(line) <= 12 THEN '…[redacted]' ELSE line[1:12] || '…[redacted ' || (length(line) - 12) || ' chars]' END AS redacted,
        md5(lower(flat)) AS norm,
        CASE WHEN length(line) < 1 THEN 0 WHEN length(line) < 20 THEN 1 WHEN length(line) < 80 THEN 2 WHEN length(line) < 200 THEN 3 ELSE 4 END::BIGINT AS bucket
        FROM f""",
    "part_columns": f"""SELECT p_partkey,
        CASE WHEN p_name LIKE '%date%' OR p_name LIKE '%due%' THEN 'date'
             WHEN regexp_matches(p_name, 'qty|quantity|amount|price|total|cost|count|rate|no\\.') THEN 'number' ELSE 'text' END AS column_type,
        regexp_matches(lower(p_name), 'by|author|prepared|auditor|manager|owner|contact|approver|reviewer|officer|lead|signed') AS personish,
        'include_' || {_SLUG_NAME} AS include_name,
        '_show_' || lower(p_type) AS toggle,
        replace(p_name, ' ', '_') AS ident,
        p_name || '.docx' AS file_name,
        {C.slug_sql('p_name', 'document')} || '-request-.docx' AS output_name,
        array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS label,
        p_size::VARCHAR AS subtype,
        {C.slug_sql('p_brand', 'cell')} AS cell_name,
        p_size::BIGINT AS cell_row FROM part""",
    "extracted_values": """SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS value, TRUE AS date_ok,
        strftime(o_orderdate, '%Y-%m-%d') AS iso, TRUE AS number_ok,
        o_totalprice::DECIMAL(18,2)::DOUBLE AS number, o_totalprice::DECIMAL(18,2)::DOUBLE AS parsed FROM orders""",
    "rich_blocks": f"""WITH raw AS (SELECT conv_id, turn, unnest(string_split('- **' || role || '** says' || chr(10) || text, chr(10))) AS line,
            unnest(range(len(string_split('- **' || role || '** says' || chr(10) || text, chr(10))))) AS n FROM conversations),
        kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) - 1 AS pos FROM raw WHERE {C.strip_sql('line')} <> ''),
        m AS (SELECT *, regexp_matches(line, '^[ \\t]*[-*•]\\s+') AS bullet, regexp_matches(line, '^[ \\t]*\\d+[.)]\\s+') AS num FROM kept),
        b AS (SELECT *, {C.strip_sql("CASE WHEN bullet THEN regexp_replace(line, '^[ \\t]*[-*•]\\s+', '') WHEN num THEN regexp_replace(line, '^[ \\t]*\\d+[.)]\\s+', '') ELSE line END")} AS txt FROM m)
        SELECT conv_id, turn, pos, CASE WHEN bullet THEN 'bullet' WHEN num THEN 'number' ELSE 'paragraph' END AS kind,
        0::BIGINT AS level, CASE WHEN bullet THEN '•' WHEN num THEN regexp_extract(line, '(\\d+)', 1) || '.' ELSE '' END AS marker,
        md5(CASE WHEN n = 0 THEN role_text ELSE txt END) AS text_md5, CASE WHEN n = 0 THEN 2 ELSE 1 END::BIGINT AS n_spans
        FROM (SELECT b.*, regexp_replace(txt, '^\\*\\*(.*)\\*\\* says$', '\\1 says') AS role_text FROM b)""",
    "answer_json": """SELECT event_id, event_type <> 'error' AS parsed,
        CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
        CASE WHEN event_type <> 'error' THEN event_type END AS kind,
        CASE WHEN event_type NOT IN ('error', 'purchase') THEN (props->>'$.k')::BIGINT END AS k FROM events""",
}
