"""Line deduplication by a deletion-neighbourhood join.

Two lines are duplicates if their words are equal or, from ``NEAR_WORDS`` words on,
one edit apart (a word put in, left out or replaced).  Of duplicates the earliest
line, by document key and line number, stays; a line goes if any earlier line lies
within the bound.

Near lines are found by their deletion neighbourhood: every variant of a line with
one word left out is a hashed key, the line itself is one more.  Lines whose
variants agree at the same place differ by a replaced word; a line that agrees with
another's variant lacks its word.  Whatever the size of a family of lines, each
member is held only against the family's earliest, and the pair's edit distance is
verified on the words.

An edit leaves the first or the last words of a line alone, so only lines that share
those with a different line can have a near partner, and only variants beyond the
shared words are emitted.  That keeps the neighbourhood to a small part of the lines
and loses no pair.  Bounded presence tables keep texts that nothing can concern
out of the shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import BLANKS, let, maybe_in, numbered, presence, text_of
from formloom.session import stage

#: Shorter lines must be equal; longer ones may differ by one word.
NEAR_WORDS = 8
_PREFIX, _SUFFIX = 1, 2


def _shared(n: Column) -> Column:
    """Words at each end that two near lines may share: a power of two of about a
    quarter to a half of the line, so lines of n and n + 1 words mostly agree on it."""
    return F.call_function("shiftleft", F.lit(1), F.length(F.bin(n)) - 2)


def _is_power(n: Column) -> Column:
    return n.bitwiseAND(n - 1) == 0


def _told(line: Column) -> Column:
    """A line as its words with one blank between."""
    irregular = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for blank in "\t\x0b\f\r":
        irregular = irregular | line.contains(blank)
    return F.when(irregular, F.trim(F.regexp_replace(line, BLANKS, " "))).otherwise(line)


def _n_words(told: Column) -> Column:
    blanks = F.octet_length(told) - F.octet_length(F.replace(told, F.lit(" "), F.lit("")))
    return F.when(told == "", F.lit(0)).otherwise(blanks + 1)


def _hashes(told: Column) -> list[Column]:
    """128 bits of a line, as two columns."""
    return [F.xxhash64(told).alias("h1"), F.xxhash64(told, F.lit(1)).alias("h2")]


def _keys(told: Column, n: Column) -> Column:
    """The keys of a line's two ends; none for lines that must be equal."""
    def ends(m: Column) -> list[Column]:
        def key(side: int, words: Column) -> Column:
            return F.struct(F.xxhash64(F.lit(side), m, words).alias("k"), F.lit(side).alias("side"))

        def end(count: Column) -> Column:
            return F.call_function("substring_index", told, F.lit(" "), count)

        return [key(_PREFIX, end(m)), key(_SUFFIX, end(-m))]

    m = _shared(n)
    none = F.array().cast("array<struct<k:bigint,side:int>>")
    # A power of two also meets lines of one word less, which go by half as many words.
    return F.when(n < NEAR_WORDS, none).when(
        _is_power(n) & (n > NEAR_WORDS), F.array(*ends(m), *ends(F.shiftright(m, 1)))
    ).otherwise(F.array(*ends(m)))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every line with a word: _key, _doc (hash of the text), _line, told, n."""
    # Told and counted before the lines are dealt out to rows, so that it is done once.
    lines = F.transform(F.split("_text", "\n"), lambda line: let(
        _told(line), lambda told: F.struct(told.alias("told"), _n_words(told).alias("n"))
    ))
    return (
        docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"))
        .select("_key", F.xxhash64("_text").alias("_doc"), F.posexplode(lines).alias("_line", "x"))
        .where("x.n > 0").select("_key", "_doc", "_line", "x.told", "x.n")
    )


def _place() -> Column:
    """Where a line stands, in order: null keys come last."""
    return F.struct(F.col("_key").isNull().alias("null_key"), F.col("_key"), F.col("_doc"), F.col("_line"))


def _variants(ws: Column, n: Column, sides: Column) -> Column:
    """(v, at) for each word left out beyond the ends the line shares with others.

    A sequence's hash is the XOR of its words' hashes with their places, so moving
    the gap by one word changes two terms.
    """
    here = F.transform(ws, lambda w, i: F.xxhash64(w, i))
    closed = F.transform(ws, lambda w, i: F.xxhash64(w, i - 1))
    m = F.when(_is_power(n) & (n > NEAR_WORDS), F.shiftright(_shared(n), 1)).otherwise(_shared(n))

    def walk(both: Column) -> Column:
        first = F.aggregate(F.slice(both["closed"], 2, n), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))

        def move(s: Column, j: Column) -> Column:
            # From the gap at j to the gap at j + 1 (places from 0).
            v = s["v"].bitwiseXOR(F.get(both["here"], j)).bitwiseXOR(F.get(both["closed"], j + 1))
            return F.struct(v.alias("v"), F.array_append(s["all"], v).alias("all"))

        start = let(first, lambda v: F.struct(v.alias("v"), F.array(v).alias("all")))
        return F.aggregate(F.sequence(F.lit(0), n - 2), start, move, lambda s: s["all"])

    all_of = let(F.struct(here.alias("here"), closed.alias("closed")), walk)
    marked = F.transform(all_of, lambda v, j: F.struct(v.alias("v"), (j + 1).alias("at")))
    after = sides.bitwiseAND(F.lit(_PREFIX)) != 0
    before = sides.bitwiseAND(F.lit(_SUFFIX)) != 0
    return F.filter(marked, lambda x: (after & (x["at"] > m)) | (before & (x["at"] <= n - m)))


def _whole(ws: Column) -> Column:
    return F.aggregate(
        F.transform(ws, lambda w, i: F.xxhash64(w, i)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x)
    )


def within_one_word(a: Column, b: Column) -> Column:
    """Whether two word lists are at most one edit apart: what they share at both ends
    leaves at most one word of the longer one."""
    def shared(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))),
            F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")),
            lambda s, same: F.struct((s["on"] & same).alias("on"), (s["n"] + (s["on"] & same).cast("int")).alias("n")),
            lambda s: s["n"],
        )

    return shared(a, b) + shared(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def _near(docs: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """h1, h2 of the different lines that have an earlier line one edit away."""
    long_lines = lines.where(F.col("n") >= NEAR_WORDS).select("h1", F.explode("keys").alias("e")).select("h1", "e.k", "e.side")
    shared = long_lines.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b")
    possible = maybe_in(long_lines, "k", presence(shared, "k"), "maybe").where("maybe")
    sides = stage(possible.groupBy("h1").agg(F.bit_or("side").alias("sides")), "line-sides")
    texts = _lines(docs, key, text).where(F.col("n") >= NEAR_WORDS)
    texts = texts.select(_place().alias("place"), "told", "n", *_hashes(F.col("told")))
    texts = maybe_in(texts, "h1", presence(sides, "h1"), "maybe").where("maybe").drop("maybe").join(sides, "h1")
    found = stage(
        texts.groupBy("h1", "h2").agg(
            F.min("place").alias("place"), F.first("n").alias("n"), F.first("sides").alias("sides"), F.split(F.first("told"), " ").alias("ws")
        ),
        "near-lines",
    )
    places = found.select("h1", "h2", "place.null_key", "place._key", "place._doc", "place._line")
    ranked = numbered(places, ["null_key", "_key", "_doc", "_line", "h1", "h2"], "rank").select("h1", "h2", "rank")
    ranked = stage(found.drop("place").join(ranked, ["h1", "h2"]), "ranked-lines")
    variants = ranked.select("rank", F.explode(_variants(F.col("ws"), F.col("n"), F.col("sides"))).alias("x"))
    variants = stage(variants.select("rank", "x.v", "x.at"), "line-variants")
    heads = variants.groupBy("v", "at").agg(F.min("rank").alias("head"), F.max("rank").alias("last")).where("head < last")
    replaced = variants.join(heads, ["v", "at"]).where("rank > head").select("rank", F.col("head").alias("witness"))
    wholes = ranked.select(_whole(F.col("ws")).alias("v"), F.col("rank").alias("shorter"))
    lacking = variants.join(wholes, "v").where("rank <> shorter").select(
        F.greatest("rank", "shorter").alias("rank"), F.least("rank", "shorter").alias("witness")
    )
    pairs = replaced.unionByName(lacking).groupBy("rank").agg(F.min("witness").alias("witness"))
    earlier = ranked.select(F.col("rank").alias("witness"), F.col("ws").alias("earlier_ws"))
    checked = pairs.join(ranked, "rank").join(earlier, "witness").where(within_one_word(F.col("ws"), F.col("earlier_ws")))
    return checked.select("h1", "h2")


def removals(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The lines to remove: _key, _doc (hash of the text), lines (numbers from 0)."""
    told, n = F.col("told"), F.col("n")
    lines = stage(
        _lines(docs, key, text).select("_key", "_doc", "_line", "n", *_hashes(told), _keys(told, n).alias("keys")), "lines"
    )
    repeated = lines.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    near = _near(docs, lines, key, text).withColumn("near", F.lit(True))
    named = stage(repeated.select("h1", "h2", "first").join(near, ["h1", "h2"], "full_outer"), "named-lines")
    concerned = maybe_in(lines.drop("keys", "n"), "h1", presence(named, "h1"), "maybe").where("maybe").drop("maybe")
    gone = concerned.join(named, ["h1", "h2"]).where(
        F.coalesce("near", F.lit(False)) | ~_place().eqNullSafe(F.coalesce("first", _place()))
    )
    # At most the lines of one text.
    return gone.groupBy("_key", "_doc").agg(F.collect_set("_line").alias("lines"))


def dedup_lines(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", report: bool = False
) -> DataFrame:
    """``docs`` with each text freed of the lines that an earlier line repeats.

    The columns stay as they are; ``report`` adds (or replaces) n_lines (\\n-split lines,
    blank ones included) and n_removed.

    Lines without a word are never duplicates and always stay.  A null text is left
    null, with one (empty) line; rows with null keys come last; rows equal in key and
    text are one document met several times and all keep the same lines; an empty
    table gives an empty result.
    """
    gone = stage(removals(docs, key=key, text=text), "removed-lines")
    # The row travels as one column, so its names can't clash with those used here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").alias("_row_key"),
        F.xxhash64(text_of(text)).alias("_row_doc"),
    )
    rows = maybe_in(rows, "_row_doc", presence(gone, "_doc"), "_maybe")
    of_row = F.col("_row_key").eqNullSafe(F.col("_key")) & (F.col("_row_doc") == F.col("_doc"))
    concerned = rows.where("_maybe").join(gone, of_row, "left").select("_row", "lines")
    rows = rows.where("not _maybe").select("_row", F.lit(None).cast("array<int>").alias("lines")).unionByName(concerned)

    column = F.col("_row")[text]
    all_lines = F.split(column, "\n")
    left = F.array_join(F.filter(all_lines, lambda _, i: ~F.array_contains(F.col("lines"), i)), "\n")
    left = F.when(F.col("lines").isNull(), column).otherwise(left)
    out = {c: left if c == text else F.col("_row")[c] for c in docs.columns}
    if report:
        out["n_lines"] = F.coalesce(F.size(all_lines), F.lit(1)).cast("bigint")
        out["n_removed"] = F.coalesce(F.size("lines"), F.lit(0)).cast("bigint")
    return rows.select(*[c.alias(name) for name, c in out.items()])


ORACLE = f"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, ln, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM (SELECT doc_id, unnest(range(len(ls))) AS ln, unnest(ls) AS line FROM parts)
), told AS (
  SELECT doc_id, ln, array_to_string(ws, ' ') AS norm, len(ws) AS n, ws FROM lines WHERE len(ws) > 0
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, ln) AS pos FROM told
), firsts AS (
  SELECT norm, min(pos) AS pos, any_value(ws) AS ws, any_value(n) AS n FROM ordered GROUP BY norm
), longs AS (SELECT * FROM firsts WHERE n >= {NEAR_WORDS}
), gaps AS (
  SELECT pos, gap, array_to_string(ws[:gap - 1] || ws[gap + 1:], ' ') AS v
  FROM (SELECT pos, ws, unnest(range(1, n + 1)) AS gap FROM longs)
), heads AS (SELECT v, gap, min(pos) AS head FROM gaps GROUP BY v, gap
), near AS (
  SELECT g.pos FROM gaps g JOIN heads h ON g.v = h.v AND g.gap = h.gap WHERE g.pos > h.head
  UNION SELECT greatest(g.pos, l.pos) FROM gaps g JOIN longs l ON g.v = l.norm
), gone AS (
  SELECT o.doc_id, o.ln FROM ordered o JOIN firsts f USING (norm)
  WHERE o.pos <> f.pos OR f.pos IN (SELECT pos FROM near)
), lists AS (SELECT doc_id, list(ln) AS ln FROM gone GROUP BY doc_id)
SELECT p.doc_id,
       array_to_string(list_filter(ls, lambda x, i: NOT coalesce(list_contains(ln, i - 1), false)), chr(10)) AS text,
       len(ls) AS n_lines, coalesce(len(ln), 0) AS n_removed
FROM parts p LEFT JOIN lists USING (doc_id)"""
