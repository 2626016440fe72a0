"""Names that must not collide, and names that must be found again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom import vocabulary as V
from formloom.functions import similarity as S
from formloom.functions import text as X
from formloom.session import stage


def free_name(base: str, used: set[str]) -> str:
    """``base``, or the first of ``base_2``, ``base_3``... not in use."""
    name, n = base or "field", 1
    while name in used:
        n += 1
        name = f"{base or 'field'}_{n}"
    return name


@F.pandas_udf(T.ArrayType(T.StringType()))
def _name_in_order(bases: pd.Series, taken: pd.Series) -> pd.Series:
    def one(names, used0):
        used = set(used0) if used0 is not None else set()
        out = []
        for base in names:
            if base is None:
                out.append(None)
                continue
            name = free_name(base, used)
            used.add(name)
            out.append(name)
        return out

    return pd.Series([None if b is None else one(b, t) for b, t in zip(bases, taken)])


#: Most names of a document that are numbered without Python; the count of equal
#: names before each is a pass over those before.
_FEW = 32


def _numbered(bases: Column, taken: Column) -> Column:
    """The same names without Python, or null where that can't tell: the k-th of equal
    bases ends in ``_k``, which is right when no two names meet and none is taken."""
    given = F.transform(bases, lambda b: F.when(b == "", "field").otherwise(b))

    def number(b: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(given, F.lit(1), i), lambda x: x == b))
        return F.when(before == 0, b).otherwise(F.concat(b, F.lit("_"), (before + 1).cast("string")))

    named = F.transform(given, number)
    free = F.size(F.array_except(F.array_compact(named), taken)) == F.size(F.array_compact(bases))
    return F.when((F.size(bases) <= _FEW) & free, named)


def unique_names(bases: Column, taken: Column | None = None) -> Column:
    """Free names for an ordered ``ARRAY<STRING>`` of wanted ones (null stays
    null), against names already ``taken``.  One document per row."""
    none = F.array().cast("array<string>")
    return _name_in_order.asNondeterministic()(bases, taken if taken is not None else none)


def with_names(packed: DataFrame, bases: Column, out: str, taken: Column | None = None) -> DataFrame:
    """Add ``out``: :func:`unique_names` of each row.  Only rows whose names are many or
    meet each other send them to Python."""
    used = F.coalesce(taken, F.array().cast("array<string>")) if taken is not None else F.array().cast("array<string>")
    easy = packed.withColumn("_bases", bases).withColumn("_used", used).withColumn("_easy", _numbered(F.col("_bases"), F.col("_used")))
    hard = F.col("_easy").isNull()
    return easy.withColumn(out, F.coalesce("_easy", unique_names(F.when(hard, F.col("_bases")), F.when(hard, F.col("_used"))))).drop(
        "_bases", "_used", "_easy")


def with_unique_names(
    df: DataFrame, keys: list[str], order: str, base: str, out: str, taken: DataFrame | None = None
) -> DataFrame:
    """Add ``out``: the free name of each row's ``base`` in ``order`` per document.

    Rows are packed per document (bounded) for the naming and unpacked again.
    ``taken`` optionally holds ``keys + taken ARRAY<STRING>``.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("_rows")
    )
    if taken is not None:
        packed = packed.join(taken, keys, "left")
    named = with_names(packed, F.transform("_rows", lambda r: r[base]), "_names", F.col("taken") if taken is not None else None)
    return named.select(
        *keys, F.inline(F.arrays_zip(F.col("_rows").alias("r"), F.col("_names").alias("n")))
    ).select(*keys, "r.*", F.col("n").alias(out)).select(*keys, *rest, out)


# -- resolving names -----------------------------------------------------------
def resolve_names(names: DataFrame, fields: DataFrame) -> DataFrame:
    """``(template_id, name)`` -> ``field_name``: exact, then slug of a field
    name, then slug of a label, then the closest spelling (>= 0.86), else null.

    Each step only sees what the earlier ones left, so spelling comparison runs
    on the residue, joined inside its template by a shared word or prefix-free
    length bound instead of a cross join.
    """
    wanted = names.select("template_id", "name").where(~X.is_blank("name")).distinct().withColumn(
        "slug", X.slug("name", "")
    )
    exact = fields.select("template_id", F.col("field_name").alias("name"), F.col("field_name").alias("exact"))
    keys = field_keys(fields)
    step = wanted.join(exact, ["template_id", "name"], "left").join(
        keys.select("template_id", F.col("key").alias("slug"), F.col("field_name").alias("by_slug")),
        ["template_id", "slug"], "left",
    )
    settled = F.coalesce("exact", "by_slug")
    residue = step.where(settled.isNull() & (F.col("slug") != "")).select("template_id", "slug").distinct()
    near = closest_keys(residue, keys)
    return step.join(near, ["template_id", "slug"], "left").select(
        "template_id", "name", F.coalesce(settled, F.col("near")).alias("field_name")
    )


def field_keys(fields: DataFrame) -> DataFrame:
    """Keys a field answers to, one owner each: its own slug first, then its
    label's; the earliest field wins a shared key."""
    own = fields.select("template_id", X.slug("field_name", "").alias("key"), "field_name",
                        F.lit(0).alias("kind"), "field_order")
    label = fields.where(F.coalesce("label", F.lit("")) != "").select(
        "template_id", X.slug("label", "").alias("key"), "field_name", F.lit(1).alias("kind"), "field_order"
    )
    return (
        own.unionByName(label).groupBy("template_id", "key")
        .agg(F.min_by("field_name", F.struct("kind", "field_order")).alias("field_name"),
             F.min(F.struct("kind", "field_order")).alias("rank"))
    )


def near_pairs(residue: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(template_id, slug, key, field_name, rank)`` that may reach ``threshold``.

    A ratio of at least t needs 2*min(la, lb)/(la+lb) >= t, so lengths must lie
    within a factor t/(2-t) of each other: candidates meet on equal length
    buckets (each name probes the lengths it could match that occur), never all pairs.  Then
    the letters that both hold must be enough of them."""
    ratio = threshold / (2 - threshold)
    by_len = keys.where(F.col("key") != "").withColumn("len", F.length("key")).withColumn("b", S.letter_counts("key"))
    lengths = by_len.groupBy("template_id").agg(F.collect_set("len").alias("lens"))  # lengths of names, few
    n = F.length("slug")
    near = F.filter("lens", lambda x: x.between(F.ceil(n * ratio), F.floor(n / ratio)))
    # Both sides grow with the data, and letter counts make rows far larger than Spark's
    # estimate from the files: the joins by name here are merged, never broadcast.
    probe = residue.join(lengths.hint("merge"), "template_id").select("template_id", "slug", F.explode(near).alias("len")).withColumn(
        "a", S.letter_counts("slug"))
    met = probe.join(by_len.hint("merge"), ["template_id", "len"]).where(S.letters_bound(F.col("a"), F.col("b")) >= threshold)
    return met.select("template_id", "slug", "key", "field_name", "rank")


def closest_keys(residue: DataFrame, keys: DataFrame, threshold: float = V.NAME_MATCH) -> DataFrame:
    """``(template_id, slug) -> near``: the best key at or above ``threshold``.

    Filter and verify: only pairs that lengths and letters leave open are compared, each
    pair of spellings once, whatever the number of templates that hold it."""
    met = stage(near_pairs(residue, keys, threshold), "near-pairs")
    scored = met.select("slug", "key").distinct().withColumn("score", S.similarity("slug", "key")).where(F.col("score") >= threshold)
    return met.join(scored.hint("merge"), ["slug", "key"]).groupBy("template_id", "slug").agg(
        F.min_by("field_name", F.struct((-F.col("score")).alias("s"), "rank")).alias("near")
    )


def resolve_section_keys(fields: DataFrame, sections: DataFrame) -> DataFrame:
    """Give each field a ``section_key``: kept, else the section naming its slug,
    else the section naming the closest slug (>= 0.8), else the previous
    field's section."""
    named = sections.select(
        "template_id", "section_key", "section_order", F.posexplode("field_names").alias("i", "fname")
    ).withColumn("key", X.slug("fname", ""))
    # A later section naming the same slug wins the exact step.
    exact = named.groupBy("template_id", "key").agg(
        F.max_by("section_key", F.struct("section_order", "i")).alias("by_slug")
    )
    f = fields.withColumn("slug", X.slug("field_name", "")).join(
        exact.withColumnRenamed("key", "slug").hint("merge"), ["template_id", "slug"], "left"
    )
    # The closest step takes the earliest section on equal scores.
    first = named.groupBy("template_id", "key").agg(
        F.min_by(F.col("section_key"), F.struct("section_order", "i")).alias("field_name"),
        F.min(F.struct("section_order", "i")).alias("rank"),
    )
    open_ = f.where(F.col("section_key").isNull() & F.col("by_slug").isNull()).select("template_id", "slug").distinct()
    near = closest_keys(open_, first, V.SECTION_NAME_MATCH)
    found = f.join(near.hint("merge"), ["template_id", "slug"], "left").withColumn(
        "_key", F.coalesce("section_key", "by_slug", "near")
    )
    w = Window.partitionBy("template_id").orderBy("field_order").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("section_key", F.last("_key", ignorenulls=True).over(w)).select(*fields.columns)
