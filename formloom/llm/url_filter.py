"""URL filters: fixed rules first, the host's reputation for the rest.

A reputation is the share of bad pages among a host's labelled ones, shrunk by
beta-binomial priors down a chain: all pages, suffix (``com``), registered domain
(``example.com``), host.  Each level's prior mean is its parent's posterior mean
without the child's own pages; how tightly children keep to their parents is
estimated from the data, level by level, by moments.  A host is blocked where its
posterior puts at least ``confidence`` on a share of bad pages above ``limit``: a few
bad pages do not condemn a host, and a host without labels stands as its domain.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import join_hot, let
from formloom.session import stage

#: Rules of the registered query: a verdict for a host with its subdomains and a path prefix.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Second-level names under which country domains register names of their own.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
LIMIT, CONFIDENCE = 0.5, 0.95
#: Correlation of pages within a group, as estimated, is held to this range (priors
#: worth 999 down to 1 pages).
RHO = (0.001, 0.5)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #``, A-Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def item_of(path: Column) -> Column:
    """The number that ends a path (``/en/825``, ``/en/825/``, ``/en/825.html``): the
    labelled item that the page shows.  Null where there is none."""
    return F.regexp_extract(path, r"/([0-9]{1,18})(\.html)?/?$", 1).try_cast("bigint")


def site(host: Column) -> Column:
    """A host's suffix and registered domain, as a struct.  Ports and a final dot are
    left aside; an address or a single name is its own domain and has no suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")

    def of(parts: Column) -> Column:
        n = F.size(parts)
        country = (n >= 3) & (F.length(F.get(parts, n - 1)) == 2) & F.get(parts, n - 2).isin(*SECOND_LEVEL)
        k = F.when(country, 2).otherwise(1)
        plain = (n == 1) | bare.rlike(r"^[0-9.]+$") | bare.contains(":")
        last = lambda m: F.array_join(F.slice(parts, F.greatest(n - m + 1, F.lit(1)), m), ".")
        return F.struct(
            F.when(plain, F.lit("")).otherwise(last(k)).alias("suffix"),
            F.when(plain, bare).otherwise(last(k + 1)).alias("domain"),
        )

    return let(F.split(bare, r"\."), of)


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0, by Stirling's series from x + 8."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    below = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - below


def beta_cdf(x: float, a: Column, b: Column) -> Column:
    """P(share <= x) under a beta distribution, by its continued fraction (the number of
    steps grows with the root of ``a + b``)."""

    def near(v: Column) -> Column:  # keeps a step from dividing by zero
        return F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def of(s: Column) -> Column:
        p, q, y = s["p"], s["q"], s["y"]

        def half(state: Column, part: Column) -> Column:
            d, c = 1 / near(1 + part * state["d"]), near(1 + part / state["c"])
            return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

        def step(state: Column, m: Column) -> Column:
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return let(half(state, even), lambda t: half(t, odd))

        d = 1 / near(1 - (p + q) * y / (p + 1))
        steps = F.sequence(F.lit(1), (60 + 4 * F.sqrt(p + q)).cast("int"))
        h = F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")), step, lambda t: t["h"])
        front = _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * F.log(y) + q * F.log(1 - y)
        tail = F.exp(front) * h / p
        return F.when(s["turned"], 1 - tail).otherwise(tail)

    turned = F.lit(x) >= (a + 1) / (a + b + 2)
    return let(F.struct(
        F.when(turned, b).otherwise(a).alias("p"), F.when(turned, a).otherwise(b).alias("q"),
        F.when(turned, F.lit(1 - x)).otherwise(F.lit(x)).alias("y"), turned.alias("turned"),
    ), of)


def _prior_size(rows: DataFrame, n: str, bad: str, mean: str, out: str) -> DataFrame:
    """One row: what the prior of this level is worth in pages, by the method of moments
    for beta-binomial counts."""
    spread = F.col(mean) * (1 - F.col(mean))
    over = F.sum(F.pow(F.col(bad) - F.col(n) * F.col(mean), F.lit(2.0)) - F.col(n) * spread)
    rho = F.try_divide(over, F.sum(F.col(n) * (F.col(n) - 1) * spread))
    held = F.least(F.greatest(F.coalesce(rho, F.lit(RHO[1])), F.lit(RHO[0])), F.lit(RHO[1]))
    return rows.agg(held.alias("_rho")).select((1 / F.col("_rho") - 1).alias(out))


def _shrunk(size: str, mean: str, n: Column, bad: Column) -> Column:
    return (F.col(mean) * F.col(size) + bad) / (F.col(size) + n)


def reputations(counts: DataFrame) -> DataFrame:
    """The posterior of every host: host, pages, labelled, bad, a, b.

    ``counts``: one row for each host: host, pages (rows of the table), labelled, bad.
    ``a`` and ``b`` are the beta posterior's; its mean is the host's reputation.
    """
    hosts = stage(counts.withColumn("site", site(F.col("host"))).select(
        "host", "pages", "labelled", "bad", "site.domain", "site.suffix"
    ), "hosts")
    both = lambda n: (F.sum("labelled").alias(f"n{n}"), F.sum("bad").alias(f"bad{n}"))
    domains = stage(hosts.groupBy("suffix", "domain").agg(*both(2), F.count(F.lit(1)).alias("hosts")), "domains")
    suffixes = domains.groupBy("suffix").agg(
        F.sum("n2").alias("n1"), F.sum("bad2").alias("bad1"), F.count(F.lit(1)).alias("domains")
    )
    every = domains.agg(F.coalesce(F.sum("n2"), F.lit(0)).alias("n0"), F.coalesce(F.sum("bad2"), F.lit(0)).alias("bad0"))

    # Suffix against all others.
    suffixes = suffixes.crossJoin(F.broadcast(every))  # one row
    outside = (F.col("bad0") - F.col("bad1") + 1) / (F.col("n0") - F.col("n1") + 2)
    suffixes = stage(suffixes.withColumn("mean1", outside), "suffixes")
    suffixes = suffixes.crossJoin(F.broadcast(_prior_size(suffixes, "n1", "bad1", "mean1", "size1")))
    # Domain against the rest of its suffix.
    domains = join_hot(domains, suffixes.select("suffix", "n1", "bad1", "mean1", "size1", "domains"), "suffix", "domains")
    domains = stage(domains.withColumn(
        "mean2", _shrunk("size1", "mean1", F.col("n1") - F.col("n2"), F.col("bad1") - F.col("bad2"))
    ), "domain-means")
    domains = domains.crossJoin(F.broadcast(_prior_size(domains, "n2", "bad2", "mean2", "size2")))
    # Host against the rest of its domain.
    hosts = join_hot(hosts, domains.select("domain", "n2", "bad2", "mean2", "size2", "hosts"), "domain", "hosts")
    hosts = stage(hosts.withColumn(
        "mean", _shrunk("size2", "mean2", F.col("n2") - F.col("labelled"), F.col("bad2") - F.col("bad"))
    ), "host-means")
    hosts = hosts.crossJoin(F.broadcast(_prior_size(hosts, "labelled", "bad", "mean", "size")))
    return hosts.select(
        "host", "pages", "labelled", "bad", (F.col("mean") * F.col("size") + F.col("bad")).alias("a"),
        ((1 - F.col("mean")) * F.col("size") + F.col("labelled") - F.col("bad")).alias("b"),
    )


def fitting_rules(host: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The rules for a host or a domain above it, longest first: structs of path, rule
    and verdict.  Of equal rules with both verdicts, block comes first."""
    ranked = sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0] != "block"))

    def told(verdict: str, rule: str) -> tuple[Column, Column]:
        name, slash, path = rule.partition("/")
        entry = F.struct(F.lit(slash + path).alias("path"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        return (host == name) | F.endswith(host, F.lit(f".{name}")), entry

    if not ranked:
        return F.array().cast("array<struct<path:string,rule:string,verdict:string>>")
    return F.array_compact(F.array(*[F.when(fits, entry) for fits, entry in (told(*r) for r in ranked)]))


def host_counts(pages: DataFrame, labels: DataFrame, *, url: str, item: str, bad: Column) -> DataFrame:
    """host, pages, labelled, bad for every host; an item counts once for a host."""
    marked = labels.select(F.col(item).alias("item"), bad.cast("int").alias("bad")).where("item is not null and bad is not null")
    marked = marked.groupBy("item").agg(F.max("bad").alias("bad"))
    seen = pages.select(host_of(F.col(url)).alias("host"), item_of(path_of(F.col(url))).alias("item"))
    seen = seen.groupBy("host", "item").agg(F.count(F.lit(1)).alias("rows"))
    return seen.join(marked, "item", "left").groupBy("host").agg(
        F.sum("rows").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )


def judge(
    pages: DataFrame, labels: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id",
    url: str = "url", item: str = "doc_id", bad: Column | None = None, limit: float = LIMIT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """A verdict for every row: key, host, path, rule, verdict, labelled, bad, reputation.

    ``labels`` tells outcomes by ``item``, the number that ends a page's path; ``bad`` is
    its condition (by default: quality 0 or toxic 1).  An item labelled twice is bad if
    any label says so.  ``rules``: (verdict, host and path prefix); a rule fits its host
    and all subdomains, the longest wins, and pages that no rule fits go by reputation:
    block where P(share of bad pages > ``limit``) >= ``confidence``.

    A null url, or one without ``://``, has an empty host and path, and the empty host
    a reputation as any other; null keys and repeated rows each get a row; without
    labels every host stands at even odds and is allowed; an empty table gives an empty
    result; further columns are ignored.
    """
    if bad is None:
        bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = reputations(host_counts(pages, labels, url=url, item=item, bad=bad))
    judged = known.select(
        "host", "pages", "labelled", "bad", fitting_rules(F.col("host"), rules).alias("rules"),
        F.round(F.col("a") / (F.col("a") + F.col("b")), 6).alias("reputation"),
        (1 - beta_cdf(limit, F.col("a"), F.col("b")) >= confidence).alias("blocked"),
    )
    rows = pages.select(
        F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return join_hot(rows, judged, "host", "pages").withColumn("first", first).select(
        key, "host", "path", F.col("first.rule").alias("rule"),
        F.coalesce("first.verdict", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "labelled", "bad", "reputation",
    )


def _sql_level(name: str, rows: str, n: str, bad: str, mean: str) -> str:
    """The size of a level's prior, as a scalar subquery by name."""
    spread = f"{mean} * (1 - {mean})"
    return f"""{name} AS (
  SELECT 1 / least(greatest(coalesce(sum(pow({bad} - {n} * {mean}, 2) - {n} * {spread})
    / nullif(sum({n} * ({n} - 1) * {spread}), 0), {RHO[1]}), {RHO[0]}), {RHO[1]}) - 1 AS size FROM {rows}
)"""


def _sql_rules() -> str:
    return ", ".join("('{}', '{}', '{}')".format(v, *r.split("/", 1)) for v, r in RULES)


#: For the registered query: RULES, LIMIT and CONFIDENCE as above, labels by ``doc_id``.
ORACLE = f"""
WITH split AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), items AS (
  SELECT DISTINCT host, try_cast(regexp_extract(path, '/([0-9]{{1,18}})([.]html)?/?$', 1) AS BIGINT) AS item FROM parsed
), outcomes AS (
  SELECT doc_id AS item, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels
  WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id
), counts AS (
  SELECT host, count(bad) AS labelled, coalesce(sum(bad), 0)::BIGINT AS bad FROM items LEFT JOIN outcomes USING (item) GROUP BY host
), bare AS (
  SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '[.]?(:[0-9]*)?$', '') AS name FROM counts
), parts AS (
  SELECT *, string_split(name, '.') AS p,
         CASE WHEN len(string_split(name, '.')) >= 3 AND length(string_split(name, '.')[-1]) = 2
               AND string_split(name, '.')[-2] IN ({", ".join(f"'{s}'" for s in SECOND_LEVEL)}) THEN 2 ELSE 1 END AS k,
         len(string_split(name, '.')) = 1 OR regexp_matches(name, '^[0-9.]+$') OR contains(name, ':') AS plain
  FROM bare
), hosts AS (
  SELECT host, labelled, bad, CASE WHEN plain THEN '' ELSE array_to_string(p[greatest(len(p) - k + 1, 1):], '.') END AS suffix,
         CASE WHEN plain THEN name ELSE array_to_string(p[greatest(len(p) - k, 1):], '.') END AS domain
  FROM parts
), every AS (SELECT sum(labelled) AS n0, sum(bad) AS bad0 FROM hosts),
domain_counts AS (SELECT suffix, domain, sum(labelled) AS n2, sum(bad) AS bad2 FROM hosts GROUP BY ALL),
suffixes AS (
  SELECT suffix, n1, bad1, (bad0 - bad1 + 1) / (n0 - n1 + 2) AS mean1
  FROM (SELECT suffix, sum(n2) AS n1, sum(bad2) AS bad1 FROM domain_counts GROUP BY suffix), every
), {_sql_level("k1", "suffixes", "n1", "bad1", "mean1")},
domains AS (
  SELECT *, (mean1 * size + bad1 - bad2) / (size + n1 - n2) AS mean2 FROM domain_counts JOIN suffixes USING (suffix), k1
), {_sql_level("k2", "domains", "n2", "bad2", "mean2")},
placed AS (
  SELECT host, labelled, bad, (mean2 * k2.size + bad2 - bad) / (k2.size + n2 - labelled) AS mean
  FROM hosts JOIN domains USING (suffix, domain), k2
), {_sql_level("k3", "placed", "labelled", "bad", "mean")},
posteriors AS (
  SELECT host, labelled, bad, mean * size + bad AS a, (1 - mean) * size + labelled - bad AS b FROM placed, k3
), terms AS (
  SELECT *, unnest(range(0, 2000 + 8 * (a + b)::BIGINT)) AS i FROM posteriors
), judged AS (
  SELECT host, labelled, bad, round(a / (a + b), 6) AS reputation,
         exp(lgamma(a + b) - lgamma(a) - lgamma(b) + b * ln({1 - LIMIT}) + a * ln({LIMIT})) / b
         * sum(exp(lgamma(a + b + i) - lgamma(a + b) - lgamma(b + 1 + i) + lgamma(b + 1) + i * ln({1 - LIMIT}))) AS above
  FROM terms GROUP BY host, labelled, bad, a, b
), rules AS (SELECT * FROM (VALUES {_sql_rules()}) AS r(verdict, name, start)),
fits AS (
  SELECT page_id, host, path, max_by(name || '/' || start, length(name) + length(start)) AS rule,
         max_by(verdict, length(name) + length(start)) AS verdict
  FROM (SELECT DISTINCT host, path, page_id FROM parsed) JOIN rules
    ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, '/' || start)
  GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN above >= {CONFIDENCE} THEN 'block' ELSE 'allow' END) AS verdict, labelled, bad, reputation
FROM parsed p JOIN judged j USING (host)
LEFT JOIN fits f ON f.page_id IS NOT DISTINCT FROM p.page_id AND f.host = p.host AND f.path = p.path"""
