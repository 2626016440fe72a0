"""Pieces several operators share: words, ``let`` bindings, row numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.session import stage

#: What separates words: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The runs of non-blank characters; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words; a bigint, 0 for null."""
    return F.size(words(text)).cast("bigint")


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def hash60(value: Column) -> Column:
    """60 evenly spread bits of a value's text form (MD5, so any engine can repeat it)."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def numbered(rows: DataFrame, order: list[str], out: str = "row_number") -> DataFrame:
    """``rows`` with gapless global numbers from 0 in the given order, nulls last.

    The rows are dealt out by range, counted per range, and numbered inside each
    range on top of the ranges' running totals, so no task sees more than its own
    range.  Rows equal in all of ``order`` are numbered in any order.  Meant for
    narrow rows: they are written to the shared folder twice.
    """
    tie, part, before = "_tie", "_part", "_before"
    keys = [F.col(c).asc_nulls_last() for c in order] + [F.col(tie).asc()]
    held = stage(rows.withColumn(tie, F.monotonically_increasing_id()), "unnumbered")
    dealt = stage(held.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))  # one row for each range
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*keys)) - 1
    return (
        dealt.withColumn("_inside", inside).join(F.broadcast(starts), part)
        .withColumn(out, (F.col(before) + F.col("_inside")).cast("bigint"))
        .drop(tie, part, before, "_inside")
    )


#: A presence table is 256 bitmaps of 32,768 bits, 1 MB whatever the data.
SLOTS, BUCKET = 1 << 23, 1 << 15


def presence(hashes: DataFrame, column: str) -> DataFrame:
    """A bounded summary of a bigint hash column for :func:`maybe_in`: at most 256
    rows of 4 KB.  Past a few million hashes it lets more and more rows through,
    so it may save work, never decide."""
    slot = F.pmod(F.col(column), F.lit(SLOTS))
    return (
        hashes.select(F.shiftright(slot, 15).cast("int").alias("_bucket"), (slot % BUCKET).cast("bigint").alias("_bit"))
        .groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )


def maybe_in(rows: DataFrame, column: str, summary: DataFrame, out: str) -> DataFrame:
    """``rows`` with a boolean ``out``: false only if ``column`` is not among the hashes."""
    slot = F.pmod(F.col(column), F.lit(SLOTS))
    at = (slot % BUCKET).cast("int")
    octet = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_octet, _at & 7) & 1")
    names = [F.col(f"`{c}`") for c in rows.columns]
    joined = rows.withColumn("_slot_bucket", F.shiftright(slot, 15).cast("int")).join(
        F.broadcast(summary), F.col("_slot_bucket") == F.col("_bucket"), "left"
    )
    tested = joined.select(*names, octet.alias("_octet"), at.alias("_at"))
    return tested.select(*names, F.coalesce(bit == 1, F.lit(False)).alias(out))


#: A key that holds more than one in so many rows counts as hot; so fewer keys than this are.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` joined to the one row of ``table`` for their non-null ``key``.

    ``weight`` says how many of ``rows`` each key has.  Keys with more than a
    thousandth of them, fewer than a thousand by arithmetic, are broadcast; the
    others are joined by a shuffle in which none of them can fill a task.
    """
    table = stage(table, "keyed")
    total = F.broadcast(table.agg(F.sum(weight).alias("_total")))  # one row
    split = table.crossJoin(total).withColumn("_hot", F.col(weight) * HOT_SHARE > F.col("_total")).drop("_total")
    hot, cold = split.where("_hot").drop("_hot", weight), split.where("not _hot").drop("_hot", weight)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))
