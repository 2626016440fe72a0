"""Quality rules with risk-controlled thresholds.

Counts of each whole text give a few scores, higher for worse.  A rule rejects what
scores above its cutoff.  The cutoffs come from labelled documents, stratum by
stratum: from the mildest cutoff down, each is tested with the exact binomial bound
on how many good documents it rejects, and the strictest one before the first
failure is taken.  Testing in that fixed order needs no correction among cutoffs;
the level is divided among all strata and rules, and a stratum's risk among its
rules.  So, with the stated confidence, in every stratum at once, the rules
together reject no more than the stated share of good documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.llm.common import BLANKS, let, text_of, words
from formloom.session import stage

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Cutoffs each rule may take, tested from the mildest (last) down.
CUTOFFS = (0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
#: Share of good documents that all rules together may reject in a stratum, and the
#: chance that this fails in any stratum.
RISK, LEVEL = 0.05, 0.05


def _repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the list."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(ws) - 3),
        lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)),
    )

    def covered(hashes: Column) -> Column:
        marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(marked, lambda m: F.transform(
            F.filter(m, lambda x, j: (F.get(m, j - 1)["h"] == x["h"]) | (F.get(m, j + 1)["h"] == x["h"])),
            lambda x: x["i"],
        ))
        return let(F.array_sort(repeated), lambda at: F.aggregate(
            at, F.struct(F.lit(-1).alias("end"), F.lit(0).cast("bigint").alias("n")),
            lambda s, i: F.struct(
                (i + 2).alias("end"), (s["n"] + (i + 2 - F.greatest(s["end"], i - 1))).cast("bigint").alias("n")
            ),
            lambda s: s["n"],
        ))

    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(ws) >= 4, some).otherwise(F.lit(0)).cast("bigint")


def counts(text: Column) -> Column:
    """What the rules look at, as a struct of bigints: words, code points in words,
    symbols, lines with a word, those equal to an earlier one, words in repeated
    3-word windows, capital A-Z."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    capitals = without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("bigint").alias("n_words"), _repeat_words(ws).alias("n_repeat_words"))

    def of_lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).cast("bigint").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
        )

    return F.struct(
        let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"),
        F.char_length(F.regexp_replace(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        without(SYMBOLS).cast("bigint").alias("n_symbols"), capitals.cast("bigint").alias("n_capitals"),
    )


def measure(docs: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The counts of every row: key, stratum, n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, n_capitals.  A null text has none."""
    c = docs.select(F.col(key).alias(key), F.col(stratum).alias("stratum"), counts(text_of(text)).alias("c"))
    return c.select(
        key, "stratum", F.col("c.w.n_words"), F.col("c.word_chars"), F.col("c.n_symbols"), F.col("c.l.n_lines"),
        F.col("c.l.n_dup_lines"), F.col("c.w.n_repeat_words"), F.col("c.n_capitals"),
    )


def scores() -> dict[str, Column]:
    """The rules: a share each, higher for worse."""
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
    }


def log_binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """ln P(X <= k) for X binomial of n draws with chance p, summed term by term."""
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p / (1 - p)))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(s["sum"], term), F.least(s["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), add, lambda s: s["sum"])


def cutoffs(measured: DataFrame, labels: DataFrame, *, key: str = "doc_id", good: str = "quality",
            risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The cutoff of each stratum and rule: stratum, rule, cutoff; none where even the
    mildest cutoff can't be shown to be safe.

    ``measured``: rows that passed the base rules; ``labels``: key and 1 for good, 0 for
    bad.  A key labelled twice counts once, as good if any label says so.
    """
    rules = scores()
    marked = labels.where(F.col(good).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(good).alias("_good"))
    held = measured.join(marked, F.col(key) == F.col("_key")).where("_good = 1")
    grid = F.array(*[F.lit(c) for c in CUTOFFS])

    def exceeded(score: Column) -> Column:
        return F.size(F.filter(grid, lambda c: score > c))

    # How many cutoffs of the grid a score exceeds: a row falls into one cell for each rule.
    cells = held.select("stratum", F.explode(F.create_map(*[
        x for r, s in rules.items() for x in (F.lit(r), exceeded(s))
    ])).alias("rule", "exceeds")).groupBy("stratum", "rule", "exceeds").agg(F.count(F.lit(1)).alias("_n"))
    totals = cells.groupBy("stratum", "rule").agg(
        F.sum("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("exceeds", "_n"))).alias("at")
    )  # at most one entry for each cutoff
    strata = totals.select(F.count_distinct(F.coalesce(F.concat(F.lit("s"), F.col("stratum")), F.lit("n"))).alias("_strata"))
    tests = totals.crossJoin(F.broadcast(strata)).select(
        "stratum", "rule", "n", "_strata",
        F.posexplode(F.transform(grid, lambda c, i: F.struct(
            c.alias("cutoff"),
            F.aggregate(
                F.map_values(F.map_filter("at", lambda e, _: e > i)), F.lit(0).cast("bigint"), lambda a, x: a + x
            ).alias("k"),
        ))).alias("i", "c"),
    )
    share = risk / len(rules)
    safe = (F.col("c.k") < F.col("n") * share) & (
        log_binomial_cdf(F.col("n"), F.when(F.col("c.k") < F.col("n") * share, F.col("c.k")).otherwise(F.lit(0)), share)
        <= F.log(F.lit(level) / (F.col("_strata") * len(rules)))
    )
    down = Window.partitionBy("stratum", "rule").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    held_so_far = F.min(safe.cast("int")).over(down)
    return (
        tests.withColumn("_safe", held_so_far).where("_safe = 1")
        .groupBy("stratum", "rule").agg(F.min("c.cutoff").alias("cutoff"))
    )


def apply_rules(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang",
    good: str = "quality", risk: float = RISK, level: float = LEVEL,
) -> DataFrame:
    """Every row's counts and verdict: key, stratum, the counts, base_failed, kept.

    The base rules turn away texts of under 50 words and those of which over half the
    words lie in repeated 3-word windows; the rest is for the cutoffs.

    A null text has no words and fails; null strata are one stratum; repeated rows each
    get a row; without labels no cutoff holds and only the base rules reject; an
    empty table gives an empty result; further columns are ignored.
    """
    measured = stage(measure(docs, key=key, text=text, stratum=stratum), "quality")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measured.withColumn("base_failed", base_failed)
    cuts = cutoffs(measured.where(~F.col("base_failed")), labels, key=key, good=good, risk=risk, level=level)
    cuts = cuts.groupBy(F.col("stratum").alias("_stratum")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cuts")
    )  # at most one entry for each rule
    over = F.lit(False)
    for rule, score in scores().items():
        over = over | F.coalesce(score > F.col("_cuts")[rule], F.lit(False))
    return (
        measured.join(cuts, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
        .withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", "_cuts")
    )


ORACLE = f"""
WITH split AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), grams AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM (
    SELECT doc_id, i, unnest([0, 1, 2]) AS o, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams
  ) WHERE c > 1 GROUP BY doc_id
), measured AS (
  SELECT doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
  FROM split LEFT JOIN repeated USING (doc_id)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), scored AS (
  SELECT doc_id, stratum, base_failed, unnest([
    {{'rule': 'symbols', 's': n_symbols / greatest(word_chars, 1)}},
    {{'rule': 'dup_lines', 's': n_dup_lines / greatest(n_lines, 1)}},
    {{'rule': 'repeats', 's': n_repeat_words / greatest(n_words, 1)}},
    {{'rule': 'capitals', 's': n_capitals / greatest(word_chars, 1)}}], recursive := true)
  FROM based
), tests AS (
  SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE s > cutoff) AS k
  FROM scored JOIN labels USING (doc_id) CROSS JOIN (SELECT unnest([{', '.join(map(str, CUTOFFS))}]::DOUBLE[]) AS cutoff)
  WHERE NOT base_failed AND quality = 1 GROUP BY ALL
), tails AS (
  SELECT t.*, (SELECT count(DISTINCT stratum) FROM tests) AS strata,
         (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
                         + i * ln({RISK / 4}) + (n - i) * ln(1 - {RISK / 4})))
          FROM (SELECT unnest(range(0, k + 1)) AS i)) AS cdf
  FROM tests t
), safe AS (
  SELECT stratum, rule, cutoff,
         min((k < n * {RISK / 4} AND cdf <= {LEVEL} / (strata * 4))::INT) OVER
           (PARTITION BY stratum, rule ORDER BY cutoff DESC ROWS UNBOUNDED PRECEDING) AS ok
  FROM tails
), cuts AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM safe WHERE ok = 1 GROUP BY ALL
), over AS (
  SELECT doc_id, bool_or(coalesce(s > cutoff, false)) AS rejected
  FROM scored LEFT JOIN cuts USING (stratum, rule) GROUP BY doc_id
)
SELECT b.doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals,
       base_failed, NOT base_failed AND NOT rejected AS kept
FROM based b JOIN over USING (doc_id)"""
