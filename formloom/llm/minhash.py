"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document is the set of its word shingles.  Its sketch has a fixed number of bins.
In each round every shingle is thrown into one bin by that round's hash, and bins
that are still empty keep the least value thrown into them; once the rounds equal
the bins, a round fills one bin from all shingles.  So every bin is filled, short
documents included, sketches agree in a bin with the Jaccard similarity's chance,
and the share of agreeing bins is as concentrated as with independent hashes, for
little more than one pass over the set.

Bins are cut into bands; documents that share a band are candidates.  Bands are as
many as keep the chance to miss a pair at the threshold below ``MISS``.  Equal sets are
one node.  Whatever a band's bucket holds, each member is verified against the
bucket's first node only; what is then still unlinked inside a bucket is
verified within blocks of bounded size, by postings, and only links that join two
components leave the task.  No pair list of a group is ever made.  Links are
confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import maybe_in, numbered, presence, text_of
from formloom.llm.components import components
from formloom.session import stage

#: Bins in a band, and the chance to miss a pair that just meets the threshold.
ROWS, MISS = 4, 1e-7
#: Shingles in a block of the exact step: 8 MB of hashes.
BLOCK = 1_000_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads any input evenly."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles.

    Words are runs of non-blank characters, A-Z in lower case; a text of fewer words is
    one shingle, a text without words none.
    """
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxh3_64_intdigest(w) for w in words], np.uint64)
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _GOLD + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes."""
    out, empty = np.zeros(bins, np.uint64), np.ones(bins, bool)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(2 * bins):
        thrown = mix(items + np.uint64((i + 1) * int(_GOLD) % 2**64))
        if i < bins:
            into = ((thrown >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            least = np.full(bins, top)
            np.minimum.at(least, into.astype(np.int64), mix(thrown))
            hit = np.zeros(bins, bool)
            hit[into.astype(np.int64)] = True
            hit &= empty
            out[hit] = least[hit]
            empty &= ~hit
        elif empty[i - bins]:
            out[i - bins] = mix(thrown).min()
            empty[i - bins] = False
        if not empty.any():
            break
    return out


def band_keys(sketched: np.ndarray, bands: int) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in sketched.reshape(bands, ROWS).T:
        keys = mix(keys * _GOLD + column)
    return keys.astype(np.int64)


def _sketcher(size: int, bands: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            n, digests, keys = [], [], []
            for text in batch["_text"]:
                items = shingle_set(text, size)
                n.append(len(items))
                digests.append(xxh3_128_digest(items.tobytes()) if len(items) else None)
                keys.append(band_keys(sketch(items, bands * ROWS), bands) if len(items) else None)
            yield pd.DataFrame({"_key": batch["_key"], "n": pd.Series(n, dtype="int64"), "digest": digests, "bands": keys})

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            nodes, items = [], []
            for node, digest, text in zip(batch["node"], batch["digest"], batch["_text"], strict=True):
                held = shingle_set(text, size).tobytes()
                if xxh3_128_digest(held) == bytes(digest):
                    nodes.append(node)
                    items.append(held)
            yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "items": items})

    return run


def linked(both: int, a: int, b: int, part: int, whole: int) -> bool:
    return whole * both >= part * (a + b - both)


def _verify(part: int, whole: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["items"], batch["pivot_items"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
                    keep.append(False)
                    continue
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(linked(both, len(a), len(b), part, whole))
            yield batch.loc[keep, ["pivot", "node"]].rename(columns={"pivot": "u", "node": "v"})

    return run


def block_links(nodes, groups, turns, sets, part: int, whole: int) -> list[tuple[int, int]]:
    """Links between nodes of different groups, as a forest: each joins two components.

    ``turns`` marks the nodes that are held against all others.  Postings give all of
    a node's intersections at once; shingles that occur once here can't be shared.
    """
    sizes = np.array([len(s) for s in sets])
    all_items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(all_items, kind="stable")
    all_items, owner = all_items[order], owner[order]
    starts = np.flatnonzero(np.r_[True, all_items[1:] != all_items[:-1]])
    ends = np.r_[starts[1:], len(all_items)]
    often = ends - starts > 1
    of_node: list[list[tuple[int, int]]] = [[] for _ in sets]
    for s, e in zip(starts[often], ends[often], strict=True):
        for i in owner[s:e]:
            of_node[i].append((s, e))
    up = {g: g for g in groups}

    def top(g):
        while up[g] != g:
            up[g] = up[up[g]]
            g = up[g]
        return g

    out = []
    for i in range(len(sets)):
        if not turns[i] or whole * len(of_node[i]) < part * sizes[i]:
            continue
        both = np.bincount(np.concatenate([owner[s:e] for s, e in of_node[i]]), minlength=len(sets))
        near = whole * both >= part * (sizes[i] + sizes - both)
        near[i] = False
        for j in np.flatnonzero(near):
            a, b = top(groups[i]), top(groups[j])
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _blocks(part: int, whole: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("node")
        found = block_links(
            block["node"].tolist(), block["component"].tolist(), block["turn"].tolist(),
            [np.frombuffer(x, np.uint64) for x in block["items"]], part, whole,
        )
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return run


def _residual_links(members: DataFrame, groups: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Links inside buckets whose non-first nodes are still in several components."""
    rest = members.where("node <> pivot").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = stage(rest.select("band", "node", "component", "n"), "rest")
    open_bands = rest.groupBy("band").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.min("node").alias("head")
    ).where("a < b").select("band", "head")
    held = stage(rest.join(open_bands, "band").select("node", "component", "n", "head").distinct(), "open-members")
    # Buckets that share nodes are one region; its nodes are compared once.
    regions = components(held.select(F.col("node").alias("u"), F.col("head").alias("v")))
    nodes = held.select("node", "component", "n").distinct().join(regions.withColumnRenamed("component", "region"), "node")
    nodes = stage(nodes, "regions")
    by_part = nodes.groupBy("region", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = by_part.groupBy("region").agg(F.max_by("component", F.struct("c", "component")).alias("largest"))
    placed = nodes.join(largest, "region").withColumn("turn", F.col("component") != F.col("largest"))
    placed = stage(placed, "turns")
    sizes = placed.groupBy("region").agg(
        F.ceil(F.coalesce(F.sum(F.when(F.col("turn"), F.col("n"))), F.lit(0)) / BLOCK).cast("int").alias("a"),
        F.ceil(F.coalesce(F.sum(F.when(~F.col("turn"), F.col("n"))), F.lit(0)) / BLOCK).cast("int").alias("b"),
    )
    # Nodes in turn meet each other and the largest component's nodes, block by block;
    # the largest component's nodes need not meet each other.
    spread = F.pmod(F.xxhash64("node"), F.when(F.col("turn"), F.col("a")).otherwise(F.col("b"))).cast("int")
    at = placed.join(sizes, "region").withColumn("block", F.when(F.col("turn"), spread).otherwise(F.col("a") + spread))
    others = F.sequence(F.lit(0), F.col("a") + F.col("b") - 1)
    meets = F.when(F.col("turn"), others).otherwise(F.sequence(F.lit(0), F.col("a") - 1))
    dealt = at.where("a > 0").withColumn("_other", F.explode(meets)).select(
        "region", "node", "component", "turn",
        F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"),
    )
    return (
        dealt.join(sets, "node").groupBy("region", "i", "j").applyInPandas(_blocks(part, whole), "u bigint, v bigint")
    )


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, part: int = 80, whole: int = 100
) -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles, component_id, kept.

    Two documents are linked if ``whole`` times their shingle sets' intersection is at
    least ``part`` times the union; component_id is the least key that links reach,
    kept marks the row whose key that is.

    A null or wordless text has an empty set and is linked with nothing; a null key
    takes no part either (component_id null, kept true); rows that share a key and a
    set share their component; an empty table gives an empty result; further
    columns are ignored.  Keys are bigints.
    """
    bands = bands_for(part / whole)
    texts = docs.select(F.col(key).cast("bigint").alias("_key"), text_of(text).alias("_text"))
    # Keys travel as text: pandas would turn bigints beside a null into doubles.
    told = texts.withColumn("_key", F.col("_key").cast("string")).mapInPandas(
        _sketcher(shingle, bands), "_key string, n bigint, digest binary, bands array<bigint>"
    )
    sketched = stage(told.withColumn("_key", F.col("_key").cast("bigint")), "sketches")
    classes = sketched.where("n > 0 and _key is not null").groupBy("digest").agg(
        F.min("_key").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    nodes = stage(numbered(classes, ["rep", "digest"], "node"), "nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = stage(banded.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("band", "pivot"), "buckets")
    members = maybe_in(banded, "band", presence(shared, "band"), "maybe").where("maybe").drop("maybe")
    members = stage(members.join(shared, "band"), "members")

    wanted = members.select("node").distinct().join(nodes.select("node", "rep", "digest"), "node")
    wanted = stage(wanted.withColumn("_rep_hash", F.xxhash64("rep")), "wanted")
    held = maybe_in(
        texts.withColumn("_hash", F.xxhash64("_key")), "_hash", presence(wanted, "_rep_hash"), "maybe"
    ).where("maybe").select("_key", "_text")
    held = held.join(wanted, F.col("_key") == F.col("rep")).select("node", "digest", "_text")
    sets = stage(held.mapInPandas(_sets(shingle), "node bigint, items binary"), "sets")

    pairs = members.where("node <> pivot").select("pivot", "node").distinct()
    of_pivot = sets.select(F.col("node").alias("pivot"), F.col("items").alias("pivot_items"))
    checked = pairs.join(sets, "node").join(of_pivot, "pivot")
    links = stage(checked.mapInPandas(_verify(part, whole), "u bigint, v bigint"), "links")
    more = _residual_links(members, components(links), sets, part, whole)
    found = components(links.unionByName(stage(more, "more-links")))

    reps = nodes.select(F.col("node").alias("component"), F.col("rep").alias("component_id"))
    of_class = nodes.select("node", "digest").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    ).join(reps, "component").select(F.col("digest").alias("_digest"), "component_id")
    named = sketched.join(of_class, F.col("digest") == F.col("_digest"), "left")
    known = F.when(F.col("_key").isNotNull(), F.coalesce("component_id", "_key"))
    return named.select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"), known.alias("component_id"),
        (known.isNull() | (known == F.col("_key"))).alias("kept"),
    )


def oracle(shingle: int = 3, part: int = 85, whole: int = 100) -> str:
    """The same result in SQL: every pair that shares a shingle is compared, links are
    followed by recursion."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    window = " || ' ' || ".join(f"ws[i + {k}]" for k in range(shingle))
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'),
                             lambda w: w <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {shingle} THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - {shingle - 2}), lambda i: {window}) END) AS items FROM split
), items AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {whole} * count(*) >= {part} * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(doc_id, least) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT b, least FROM reach JOIN links ON a = doc_id WHERE least < b
)
SELECT doc_id, len(items) AS n_shingles, min(least) AS component_id, min(least) = doc_id AS kept
FROM sets JOIN reach USING (doc_id) GROUP BY doc_id, items"""
