"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than the node goes to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    ).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: bigint, in any order): the
    component is its least node.

    Each round rewires the edges by a large and a small star; what a round leaves
    is written to the shared folder, so lineage stays short and lost executors cost
    a re-read.  Rounds go on until nothing changes, a few for the star-shaped
    graphs that deduplication gives, about the logarithm of the size otherwise.
    """
    now = stage(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = None
    while True:
        now = stage(_small_star(_large_star(now)).distinct(), "stars")
        told = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 31)).alias("s")
        ).first()  # two numbers
        if (told.n, told.s) == state:
            break
        state = (told.n, told.s)
    # Stars only now: each node with its least; the centres stand for themselves.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
