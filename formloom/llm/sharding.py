"""A reproducible shuffle into shards: a Feistel permutation with cycle walking.

Row number ``r`` of ``n`` goes to place ``p = permute(r)``, shard ``p mod shards``
and slot ``p div shards``.  The permutation is a balanced-as-possible alternating
Feistel network over the smallest power of two that holds ``n``; numbers that fall
outside ``n`` are permuted again until they fall inside (cycle walking), which
keeps it one-to-one on ``0 .. n-1``.  Shard and slot follow from the row number,
the seed and ``n`` alone, so any row's place can be computed without the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import numbered, text_of

ROUNDS = 6
#: The domain is under twice the rows, so a walk goes on with a chance of at most
#: a half: none of 2**63 rows is expected to need more than this many steps.
WALK = 192


def bits_for(n: int) -> tuple[int, int]:
    """Bits of the left and right half of the smallest domain that holds ``n`` rows."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    return bits - bits // 2, bits // 2


def round_bits(half: Column, key: Column) -> Column:
    """32 pseudo-random bits of one half and a round key."""
    joined = F.concat_ws(":", key, half.cast("string"))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("bigint")


def permute_once(x: Column, n: int, seed: str) -> Column:
    """One pass through the network; a permutation of the whole domain."""
    left, right = bits_for(n)
    low, high = (1 << right) - 1, (1 << left) - 1
    keys = F.array(*[F.struct(F.lit(f"{seed}-{i}").alias("key"), F.lit(i % 2 == 0).alias("even")) for i in range(ROUNDS)])
    start = F.struct(F.shiftright(x, right).alias("l"), x.bitwiseAND(F.lit(low)).alias("r"))

    def step(s: Column, k: Column) -> Column:
        new_l = s["l"].bitwiseXOR(round_bits(s["r"], k["key"]).bitwiseAND(F.lit(high)))
        new_r = s["r"].bitwiseXOR(round_bits(s["l"], k["key"]).bitwiseAND(F.lit(low)))
        return F.when(k["even"], F.struct(new_l.alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), new_r.alias("r"))
        )

    return F.aggregate(keys, start, step, lambda s: F.shiftleft(s["l"], right).bitwiseOR(s["r"]))


def permute(x: Column, n: int, seed: str) -> Column:
    """The place of row number ``x`` among ``n``: permuted until it is below ``n``."""
    walk = F.sequence(F.lit(1), F.lit(WALK))
    return F.aggregate(
        walk, permute_once(x, n, seed), lambda at, _: F.when(at < n, at).otherwise(permute_once(at, n, seed))
    )


def shard(
    docs: DataFrame, *, shards: int = 8, key: str = "doc_id", text: str = "text", seed: str = "shard-1"
) -> DataFrame:
    """Every row's shard and slot under the law ``rows``: counts at most one apart.

    Returns key, size (UTF-8 bytes of the text plus 1), text_crc32, law,
    row_number, shard, slot (gapless from 0 in each shard), grown_shard (null: the
    law gives no promise about another shard count).

    Rows are numbered by key, then text hash.  A null text is empty (size 1); null
    keys come last; repeated rows each get a place of their own; an empty table
    gives an empty result; further columns are ignored.
    """
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(text_of(text)) + 1).cast("bigint").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(text_of(text)).alias("_text_hash"),
    )
    placed = numbered(rows, [key, "_text_hash"])
    n = placed.count()
    at = permute(F.col("row_number"), n, seed)
    return placed.withColumn("_place", at).select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), "row_number",
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

