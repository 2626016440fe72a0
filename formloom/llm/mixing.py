"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; each source's budget falls into one
bucket; only that bucket is summed again by the next bits of the hash, and so on.
What is left is one hash threshold for each source, and the mix is a filter: no
row is sorted or ranked.  Thresholds are nested, so a larger budget keeps
everything a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.llm.common import hash60, join_hot, n_words
from formloom.session import stage

HASH_BITS = 60
#: Bits of the hash each level looks at: 4,096 buckets for each source, three times.
LEVEL_BITS, LEVELS = 12, 3


def _source_key(source: Column) -> Column:
    """The source as a join key that keeps null apart from every name."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(totals: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """A target for each source of ``totals`` (source_key, source, source_size).

    Sources take ``weights`` in turn, by code point, null last, and share the sum
    of all sizes by weight; a target stops at ``cap`` times its source's size and
    the excess is reshared by weight until none is above.  That is one water level:
    sources are capped in the order of their caps for each unit of weight, up to
    the first that the level left by the earlier ones does not fill.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights))
    by_fill = Window.orderBy("_fill", "source_key")
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = totals.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("_fill", F.col("_cap") / F.col("_weight"))
    ranked = ranked.withColumns({
        "_at": F.row_number().over(by_fill),
        "_level": (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)))
        / F.sum("_weight").over(rest),
    })
    open_at = F.when(F.col("_level") <= F.col("_fill"), F.struct("_at", "_level"))
    ranked = ranked.withColumn("_first", F.min(open_at).over(everything))
    capped = F.col("_first").isNull() | (F.col("_at") < F.col("_first._at"))
    return ranked.select(
        "source_key", "source_size",
        F.when(capped, F.col("_cap")).otherwise(F.col("_first._level") * F.col("_weight")).alias("target"),
    )


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source: full copies of every row, and the hash cell below which rows
    are taken once more.

    ``sizes``: source_key, size, cell (the hash); ``goals``: see :func:`targets`.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    budget = goals.withColumn("copies", copies.cast("bigint")).withColumn(
        "_left", F.col("target") - F.col("copies") * F.col("source_size")
    )
    # The boundary so far: every cell whose leading bits are below _path is taken.
    bound = None
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        keys = sizes.select(
            "source_key", F.shiftright("cell", shift + LEVEL_BITS).alias("_path"),
            F.shiftright("cell", shift).alias("_next"), "size",
        )
        if bound is None:  # all rows count: summed task by task, then the sums meet the budgets
            sums = keys.groupBy("source_key", "_next").agg(F.sum("size").alias("_sum")).join(
                budget.select("source_key", "_left"), "source_key")
        else:  # only rows of the boundary bucket, and no bucket holds many
            sums = (
                keys.join(bound, ["source_key", "_path"])
                .groupBy("source_key", "_next").agg(F.sum("size").alias("_sum"), F.first("_left").alias("_left"))
            )
        upto = Window.partitionBy("source_key").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("_run", F.sum("_sum").over(upto)).where(F.col("_run") > F.col("_left"))
        edge = run.groupBy("source_key").agg(F.min_by(F.struct("_left", "_run", "_sum", "_next"), "_next").alias("e"))
        bound = edge.select(
            "source_key", (F.col("e._left") - (F.col("e._run") - F.col("e._sum"))).alias("_left"),
            F.col("e._next").alias("_path"), F.col("e._sum").alias("_sum"),
        )
    # The last cell (one key, barring hash ties) is taken if that comes nearer.
    cut = bound.select("source_key", (F.col("_path") + (F.col("_left") * 2 > F.col("_sum")).cast("bigint")).alias("cut"))
    return budget.join(cut, "source_key", "left").select(
        "source_key", "source_size", "target", "copies", F.coalesce("cut", F.lit(0)).cast("bigint").alias("cut")
    )


def _cell(key: str) -> Column:
    return hash60(F.col(key))


def plan_mix(
    docs: DataFrame, *, key: str, text: str, source: str, weights: tuple[float, ...], cap: float
) -> tuple[DataFrame, DataFrame]:
    """The rows' sizes (key, source, source_key, size, cell) and the cuts of their sources,
    with their numbers of rows (_rows)."""
    sizes = stage(
        docs.select(
            F.col(key).alias(key), _source_key(F.col(source)).alias("source_key"), F.col(source).alias("source"),
            n_words(F.col(text)).alias("size"), _cell(key).alias("cell"),
        ),
        "mix-sizes",
    )
    totals = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    totals = stage(totals, "mix-totals")
    cuts = thresholds(sizes, targets(totals, weights, cap))
    return sizes, cuts.join(totals.select("source_key", "_rows"), "source_key")


def _times() -> Column:
    below = F.shiftright("cell", HASH_BITS - LEVELS * LEVEL_BITS) < F.col("cut")
    return F.col("copies") + below.cast("bigint")


def mix_sizes(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), cap: float = 3,
) -> DataFrame:
    """What the mix takes of every row: key, source, size, source_size, target, taken.

    Each row is taken whole, ``floor(target / source_size)`` times and once more if
    its key's hash is below the source's threshold, so no row exceeds ``cap`` times
    its size and each source comes within half its boundary row of the target.

    A null text has size 0; null sources are one source, the last; rows that share
    a key share their fate; an empty table gives an empty result; sources without a
    word take nothing; further columns are ignored.
    """
    sizes, cuts = plan_mix(docs, key=key, text=text, source=source, weights=weights, cap=cap)
    return join_hot(sizes, cuts, "source_key", "_rows").select(
        key, "source", "size", "source_size", "target", (F.col("size") * _times()).alias("taken")
    )


def mix(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1), cap: float = 3,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    The columns are those of ``docs``; see :func:`mix_sizes` for the rules.
    """
    _, cuts = plan_mix(docs, key=key, text=text, source=source, weights=weights, cap=cap)
    # The row travels as one column, so its names can't clash with those used here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _source_key(F.col(source)).alias("source_key"),
        _cell(key).alias("cell"),
    )
    taken = join_hot(rows, cuts, "source_key", "_rows").withColumn("times", _times()).where("times > 0")
    taken = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                                         lambda w: w <> '')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS cell
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), fills AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS fill FROM totals
), levels AS (
  SELECT *, row_number() OVER o AS pos,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM fills WINDOW o AS (ORDER BY fill, source)
), goals AS (
  SELECT source, source_size, CASE WHEN f.pos IS NULL OR l.pos < f.pos THEN cap ELSE f.lvl * weight END AS target
  FROM levels l LEFT JOIN (SELECT pos, lvl FROM levels WHERE lvl <= fill ORDER BY pos LIMIT 1) f ON true
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies,
         target - copies * source_size AS budget
  FROM goals
), cells AS (
  SELECT s.source, cell, sum(size) AS in_cell FROM sized s GROUP BY s.source, cell
), runs AS (
  SELECT *, sum(in_cell) OVER (PARTITION BY source ORDER BY cell ROWS UNBOUNDED PRECEDING) AS run FROM cells
), edge AS (
  SELECT p.source, min_by(r.cell + CASE WHEN 2 * (p.budget - (r.run - r.in_cell)) > r.in_cell THEN 1 ELSE 0 END, r.cell) AS cut
  FROM runs r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source WHERE r.run > p.budget GROUP BY p.source
)
SELECT s.doc_id, s.source, s.size, p.source_size, p.target,
       s.size * (p.copies + (s.cell < coalesce(e.cut, 0))::BIGINT) AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN edge e ON e.source IS NOT DISTINCT FROM p.source"""
