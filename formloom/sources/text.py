"""Documents from table rows, plain text and web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions import text as X
from formloom.operators.elements import element, numbered, table_structure


def _documents(df: DataFrame, group_id: Column, doc_id: Column, doc_seq: Column, parts: Column, keep: list[str] = ()) -> DataFrame:
    return df.select(
        *keep,
        group_id.cast("string").alias("group_id"),
        doc_id.cast("string").alias("doc_id"),
        doc_seq.cast("bigint").alias("doc_seq"),
        numbered(parts).alias("elements"),
    )


# -- plain text ----------------------------------------------------------------
def documents_from_text(df: DataFrame, *, group: str, key: str, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """One element per non-blank line: a short all-caps line is a heading, a
    marked line a list item, the rest paragraphs.  Columns to ``keep`` go along."""
    def part(line: Column) -> Column:
        heading = X.is_upper(line) & (F.length(line) > 2) & (F.length(line) < 80)
        item = line.rlike(r"^(?:[-*•]|[0-9]+[.)])\s")
        ordered = line.rlike(r"^[0-9]")
        return element(
            type=F.when(heading, "heading").when(item, "list_item").otherwise("paragraph"),
            subtype=F.when(heading, "1").when(item & ordered, "ordered").when(item, "bullet"),
            style_name=F.when(heading, "Heading 1").otherwise("Normal"),
            text=line,
            section_index=F.lit(0),
        )

    return _documents(
        df, F.col(group), F.col(key), F.col(key), F.transform(X.lines(F.col(text)), part), keep
    )


# -- web pages -----------------------------------------------------------------
#: A whole table, or another block tag up to the next block boundary.
_BLOCK = (
    r"(?is)(<table\b[^>]*>.*?</table>|<(?:h[1-6]|li|p)\b[^>]*>.*?"
    r"(?=</?(?:h[1-6]|li|p|table|ul|ol|nav|footer|article|div|body|html)\b|\z))"
)
_HIDDEN = r"(?is)<!--.*?-->|<(script|style|title)\b.*?</\1>"
# The entities decoded, ampersand last so nothing decodes twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain_html(fragment: Column) -> Column:
    """Text of an HTML fragment: tags dropped, entities decoded, blanks collapsed."""
    out = F.regexp_replace(fragment, r"(?s)<[^>]*>", "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return X.one_line(out)


def documents_from_html(df: DataFrame, *, group: Column, key: str, html: str = "html") -> DataFrame:
    """h1-h6 become headings (level as subtype), li list items, p paragraphs and
    tables grids, in page order; hidden parts (scripts, comments) are skipped."""
    visible = F.regexp_replace(F.col(html), _HIDDEN, "")
    raw = F.regexp_extract_all(visible, F.lit(_BLOCK), 1)

    def cells(row: Column) -> Column:
        return F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)(?=</?t[hdr]\b|\z)"), 1), plain_html)

    def part(block: Column) -> Column:
        tag = F.lower(F.regexp_extract(block, r"(?i)^<([a-z0-9]+)", 1))
        heading = tag.rlike("^h[1-6]$")
        is_table = tag == "table"
        grid = F.transform(
            F.regexp_extract_all(block, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</?tr\b|\z)"), 1), cells
        )
        shown = plain_html(F.regexp_replace(block, r"(?s)^<[^>]*>", ""))
        return element(
            type=F.when(heading, "heading").when(tag == "li", "list_item").when(is_table, "table").otherwise("paragraph"),
            subtype=F.when(heading, F.substring(tag, 2, 1)).when(tag == "li", "bullet"),
            style_name=F.when(heading, F.concat(F.lit("Heading "), F.substring(tag, 2, 1)))
            .when(tag == "li", "List Bullet").otherwise("Normal"),
            text=F.when(is_table, "").otherwise(shown),
            section_index=F.lit(0),
            table_structure=F.when(
                is_table & (F.size(grid) > 0),
                table_structure(F.get(grid, F.lit(0)), F.slice(grid, 2, F.greatest(F.size(grid), F.lit(1)))),
            ),
        )

    kept = F.filter(F.transform(raw, part), lambda e: (e["type"] == "table") | (e["text"] != ""))
    return _documents(df, group, F.col(key), F.col(key), kept)


# -- table rows as labelled forms ----------------------------------------------
# Wording of the order form.
FORM_TITLE = "ORDER FORM"
FORM_CLAUSE = "Orders of this size are confirmed by telephone before dispatch."
FORM_TERMS = (
    "Goods remain the property of the seller until paid in full, and claims "
    "must reach the seller within thirty days of delivery."
)
FORM_HEADERS = ("Part", "Quantity", "Price")
CLAUSE_ABOVE = 400000


def money(amount: Column) -> Column:
    return amount.cast("decimal(18,2)").cast("string")


def line_item_rows(lineitem: DataFrame) -> DataFrame:
    """``(l_orderkey, data_rows)``: one order's lines as cell rows, in a fixed order."""
    ordered = F.sort_array(
        F.collect_list(
            F.struct(
                "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
            )
        )
    )
    return lineitem.groupBy("l_orderkey").agg(ordered.alias("_lines")).select(
        "l_orderkey",
        F.transform(
            "_lines",
            lambda r: F.array(
                r["l_partkey"].cast("string"),
                r["l_quantity"].cast("decimal(18,0)").cast("string"),
                money(r["l_extendedprice"]),
            ),
        ).alias("data_rows"),
    )


def order_rows(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    """What forms are made from: each order with its customer's name and its lines."""
    # Both sides of this join grow with the data: shuffle on the order key, which
    # also spreads the form building over the cluster.
    joined = orders.join(
        customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left"
    ).join(line_item_rows(lineitem).hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        "o_orderkey", "o_orderpriority", "o_orderdate", "o_orderstatus", "o_totalprice", "c_name", "data_rows"
    )


def order_forms(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One labelled form per order: title, four ``Label: value`` lines, a clause
    on large orders only, the line table, the total and the terms."""
    return forms_of(order_rows(orders, customer, lineitem))


def forms_of(rows: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The forms of :func:`order_rows`, row by row.  Columns to ``keep`` go along."""
    shift = (F.col("o_totalprice") > CLAUSE_ABOVE).cast("int")

    def placed(order: int, moved: bool, **given: Column) -> Column:
        at = F.lit(order) + shift if moved else F.lit(order)
        nid = F.when(shift == 1, _node_id(order + 1)).otherwise(_node_id(order)) if moved else _node_id(order)
        return element(
            doc_order=at, node_id=nid, position_index=at, section_index=F.lit(0), **given
        )

    def p(order: int, text: Column, moved: bool = False) -> Column:
        return placed(order, moved, type=F.lit("paragraph"), style_name=F.lit("Normal"), text=text)

    def h(order: int, text: str) -> Column:
        return placed(
            order, True, type=F.lit("heading"), subtype=F.lit("1"), style_name=F.lit("Heading 1"), text=F.lit(text)
        )

    headers = F.array(*[F.lit(x) for x in FORM_HEADERS])
    parts = F.array_compact(
        F.array(
            p(0, F.lit(FORM_TITLE)),
            p(1, F.concat(F.lit("Order Number: "), F.col("o_orderkey").cast("string"))),
            p(2, F.concat(F.lit("Customer Name: "), F.coalesce("c_name", F.lit("")))),
            p(3, F.concat(F.lit("Order Date: "), F.date_format("o_orderdate", "yyyy-MM-dd"))),
            p(4, F.concat(F.lit("Status: "), F.col("o_orderstatus"))),
            F.when(shift == 1, p(5, F.lit(FORM_CLAUSE))),
            h(5, "Line Items"),
            placed(
                6, True, type=F.lit("table"), text=F.lit(""),
                table_structure=table_structure(headers, F.col("data_rows")),
            ),
            p(7, F.concat(F.lit("Total Due: $"), money(F.col("o_totalprice"))), True),
            h(8, "Terms"),
            p(9, F.lit(FORM_TERMS), True),
        )
    )
    return rows.select(
        *keep,
        F.col("o_orderpriority").alias("group_id"),
        F.col("o_orderkey").cast("string").alias("doc_id"),
        F.col("o_orderkey").cast("bigint").alias("doc_seq"),
        parts.alias("elements"),
    )


def _node_id(order: int) -> Column:
    return F.lit(f"n{order + 1:04d}")
