"""Turn repair, whitening and host reputations against brute force."""

import hashlib
import heapq
import itertools
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import turn_repair, url_filter, whitening
from formloom.llm.common import join_hot

TURNS = "conv_id bigint, turn bigint, role string, text string"
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(turns):
    """(cost, audit) by shortest path over (turns read, state), least audit first."""
    heap, done = [(0, "", 0, "")], {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done or cost > 4 * len(turns) + 9:
            continue
        done[i, state] = cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, AFTER[state]))
        if i == len(turns):
            continue
        initial, fault = turns[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
        if fault in ("blank", "duplicate"):
            continue
        more = 3 if fault == "truncated" else 0
        want = AFTER[state]
        heapq.heappush(heap, (cost + more + (0 if initial == want else 3), audit + ("K" if initial == want else "R"), i + 1, want))
        if (state, initial) == ("", "s"):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, "s"))
    return min(done[len(turns), s] for s in ("", "a") if (len(turns), s) in done)


def plainly(rows):
    """The contract's columns of one conversation, from its (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        faults.append(
            "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = cheapest(list(zip(initials, faults, strict=True)))
    lines, i, state = [], 0, ""
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role = rows[i][1] if edit == "K" else {"u": "user", "a": "assistant"}[AFTER[state]]
        lines.append(role + ":" + ("" if edit == "I" else rows[i][2]))
        i += edit != "I"
        state = role[0]
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    count = Counter(faults)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (
        gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def conversations():
    dice = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(dice.randint(1, 14)):
            rows.append((
                conv, dice.choice([turn, turn, turn, turn + 3, None]), dice.choice(["user", "assistant"] * 3 + ["system", "tool", "", None]),
                dice.choice(["Yes.", "No", f"Turn {turn}!", f"Turn {turn}?\n", " \t", "", None, "Ünïcode 漢."]),
            ))
    return rows + [(None, 1, "user", "no id."), (None, None, "user", "no id."), (2**60 + 1, 2**61, "system", "far."), (2**60 + 3, 0, "assistant", "x.")]


def test_repair_is_the_cheapest(spark):
    rows = conversations()
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {conv: plainly(g) for conv, g in groups.items()}
    df = spark.createDataFrame(rows, TURNS).withColumns({"key": F.lit("x"), "audit": F.lit(1), "live": F.lit(0)})
    for block in (turn_repair.BLOCK, 1, 3):
        got = {r[0]: tuple(r[1:]) for r in turn_repair.repair(df, block=block).collect()}
        assert got == want


def test_repaired_turns_hash_to_the_report(spark):
    df = spark.createDataFrame(conversations(), TURNS)
    report = {r.conv_id: r for r in turn_repair.repair(df).collect()}
    edits = {}
    for r in turn_repair.repaired_turns(df).orderBy("conv_id", "position").collect():
        edits.setdefault(r.conv_id, []).append(r)
    for conv, r in report.items():
        mine = edits.get(conv, [])
        assert "".join(e.edit for e in mine) == r.audit
        lines = "\n".join(f"{e.role}:{e.text}" for e in mine if e.edit != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == r.repaired_sha256


def test_dropped_and_empty_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")], TURNS)
    got = {r[0]: tuple(r[1:]) for r in turn_repair.repair(df, live=F.col("conv_id") > 1).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2][-2] == "KK"
    assert turn_repair.repair(df.limit(0)).collect() == []


def test_long_conversation(spark):
    """One conversation of many turns goes block by block, at the cost of the whole."""
    dice = random.Random(8)
    rows = [(7, i, dice.choice("ua") if dice.random() < 0.2 else "ua"[i % 2], f"Turn {i}.") for i in range(3000)]
    rows = [(c, i, {"u": "user", "a": "assistant"}[r], t) for c, i, r, t in rows]
    got = turn_repair.repair(spark.createDataFrame(rows, TURNS), block=24).collect()
    want = plainly([(i, r, t) for _, i, r, t in rows])
    assert [tuple(r[1:]) for r in got] == [want]


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    got = Counter(tuple(r) for r in turn_repair.damaged(spark.createDataFrame(rows, TURNS)).collect())
    want = Counter()
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if fate == 1 else text.translate({ord(x): None for x in ".!?"}) if fate == 2 else text
        want[c, t, "user" if fate == 4 else role, text, fate != 0] += 2 if fate == 3 else 1
    assert got == want


# Whitening ------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int"


def as_table(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in vectors], VECTORS).withColumns({"key": F.lit(1), "whitened": F.lit(2)})


def integers(vectors):
    return np.floor(1024 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 100_000


def test_whitening(spark):
    dice = np.random.default_rng(4)
    base = (dice.normal(size=(300, 12)) @ dice.normal(size=(12, 12))).astype(np.float32).tolist()
    odd = [(1000, None), (1001, [1.0] * 11 + [float("nan")]), (1002, [1.0] * 11 + [None]), (1003, [float("inf")] * 12), (1004, []), (1005, [1.0, 2.0])]
    ids = [2**60 + 1 + i for i in range(299)] + [None]
    table = as_table(spark, list(zip(ids, base, strict=True)) + odd)
    got = whitening.whiten(table).collect()
    x = integers(base)
    n = len(x)
    cov = np.cov(x.T, bias=True)
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1][:8], axes[:, ::-1][:, :8]
    want = (x - x.mean(axis=0)) @ axes / np.sqrt(e)
    seen = {}
    for r in got:
        seen.setdefault(r.vec_id, {})[r.component] = r
    assert set(seen) == set(ids) and all(sorted(c) == list(range(1, 9)) for c in seen.values())
    mine = np.array([[seen[i][c].whitened for c in range(1, 9)] for i in ids])
    signs = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine - want * signs).max() < 1e-9
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert [seen[i][1].deviation for i in ids] == deviation.tolist()
    assert {r.n for r in got} == {n}
    assert np.allclose([seen[ids[0]][c].explained for c in range(1, 9)], e / np.trace(cov), rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_of_poor_tables(spark):
    same = as_table(spark, [(i, [1.0, 2.0]) for i in range(3)])
    assert whitening.whiten(same).collect() == [] and whitening.whiten(same.limit(0)).collect() == []
    # One direction only: one component; equal variances: two that are orthogonal.
    line = whitening.whiten(as_table(spark, [(i, [float(i), float(i), 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 5
    cross = whitening.whiten(as_table(spark, [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0])])).collect()
    assert {r.component for r in cross} == {1, 2} and max(r.identity_error for r in cross) < 1e-12


def test_huge_entries(spark):
    rows = [(0, [1e30, 5.0]), (1, [-1e30, 1.0]), (2, [3.0, 2.0])]
    got = whitening.whiten(as_table(spark, rows)).collect()
    assert {r.n for r in got} == {3}
    # The far rows' deviations are beyond a bigint.
    assert {(r.vec_id, r.deviation) for r in got} == {(0, None), (1, None), (2, 6144**2 + 2048**2)}


def test_characteristic_polynomial(spark):
    for d in (1, 2, 5, 9):
        y = np.random.default_rng(d).integers(-40, 40, (30, d))
        matrix = [[int(v) for v in row] for row in y.T @ y]
        # Faddeev-LeVerrier in exact integers.
        want, m = [0] * d + [1], [[0] * d for _ in range(d)]
        for k in range(1, d + 1):
            m = [[sum(matrix[i][t] * m[t][j] for t in range(d)) + (want[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
            want[d - k] = -sum(matrix[i][t] * m[t][i] for i in range(d) for t in range(d)) // k
        assert whitening.characteristic_polynomial(spark, matrix) == want


def test_close_and_equal_roots():
    poly = [1]
    for root in (7, 7, 1000, 1001, 0):
        poly = [(poly[k - 1] if k else 0) - root * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    roots, s = whitening.largest_roots(poly, 8)
    assert [round(Decimal(r + 1) / (1 << s), 9) for r in roots] == [1001, 1000, 7, 7]
    assert [Decimal(r + 1) / (1 << s) for r in roots] == [1001, 1000, 7, 7]


# Host reputations -----------------------------------------------------------------

PAGES, LABELS = "page_id bigint, url string, html string", "doc_id bigint, quality int, toxic int"


def pages_of(spark, urls):
    rows = [(i, u, None) for i, u in urls]
    return spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit(1), "bad": F.lit(2), "rows": F.lit(3), "item": F.lit(4)})


def judged(spark, urls, labels=(), **more):
    got = url_filter.judge(pages_of(spark, urls), spark.createDataFrame(list(labels), LABELS), **more)
    return {r.page_id: r for r in got.collect()}


def test_rules_and_parsing(spark):
    urls = {
        1: "http://Blog.Example.COM/en/5?x=/net/", 2: "https://www.example.com/en/1", 3: "https://a.www.example.com/en/#t",
        4: "http://x.net/es/", 5: "http://x.net/es", 6: "http://com", 7: "http://com/", 8: "nothing", 9: None,
        10: "a://b://c/d", 11: "http://examplexcom/en/", 12: "http://notexample.com/en/", 13: "http://ÀB.net/fr/é?q", 14: "x://?a", 15: "",
    }
    got = judged(spark, urls.items())
    told = {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()}
    assert told == {
        1: ("blog.example.com", "/en/5", "example.com/en/", "block"), 2: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        3: ("a.www.example.com", "/en/", "www.example.com/en/", "allow"), 4: ("x.net", "/es/", "net/es/", "block"),
        5: ("x.net", "/es", None, "allow"), 6: ("com", "", None, "allow"), 7: ("com", "/", "com/", "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("b:", "//c/d", None, "allow"),
        11: ("examplexcom", "/en/", None, "allow"), 12: ("notexample.com", "/en/", "com/", "allow"),
        13: ("Àb.net", "/fr/é", "net/fr/", "block"), 14: ("", "", None, "allow"), 15: ("", "", None, "allow"),
    }


def test_reputation_shrinks_and_blocks(spark):
    urls, labels, item = [], [], 0

    def host(name, good, bad):
        nonlocal item
        for outcome in [1] * good + [0] * bad:
            urls.append((item, f"http://{name}/p/{item}.html"))
            labels.append((item, outcome, 0))
            item += 1

    host("farm.bad.org", 2, 60)  # clearly bad
    host("one.fine.org", 0, 1)  # a single bad page
    host("two.fine.org", 80, 4)
    host("a.mixed.org", 30, 30)
    urls += [(9001, "http://new.bad.org/"), (9002, "http://new.fine.org/"), (None, "http://farm.bad.org/x"), (9001, "http://new.bad.org/")]
    labels += [(0, 0, 0), (None, 0, 0), (5, None, None)]
    rows = url_filter.judge(pages_of(spark, urls), spark.createDataFrame(labels, LABELS), rules=()).collect()
    by_host = {r.host: r for r in rows}
    assert len(rows) == len(urls)
    assert {h for h, r in by_host.items() if r.verdict == "block"} == {"farm.bad.org", "new.bad.org"}  # a new host stands as its domain
    # One bad page of one: between its domain's share and all bad, and no ground to block.
    assert by_host["new.fine.org"].reputation < by_host["one.fine.org"].reputation < by_host["new.bad.org"].reputation < 1
    assert (by_host["farm.bad.org"].labelled, by_host["farm.bad.org"].bad) == (62, 61)  # label 0 says bad as well


def test_empty_tables(spark):
    assert judged(spark, []) == {}
    assert url_filter.judge(pages_of(spark, [(1, "http://a.org/1")]), spark.createDataFrame([], LABELS)).first().verdict == "allow"


def test_sites(spark):
    names = {
        "a.b.example.com": ("com", "example.com"), "shop.co.uk": ("co.uk", "shop.co.uk"), "x.shop.co.uk:80": ("co.uk", "shop.co.uk"),
        "co.uk": ("uk", "co.uk"), "localhost": ("", "localhost"), "10.0.0.1": ("", "10.0.0.1"), "com.": ("", "com"), "": ("", ""),
        "user@a.example.org": ("org", "example.org"),
    }
    df = spark.createDataFrame([(n,) for n in names], "h string")
    got = {r.h: (r.s.suffix, r.s.domain) for r in df.select("h", url_filter.site(F.col("h")).alias("s")).collect()}
    assert got == names


@pytest.mark.parametrize(("x", "a", "b", "want"), [
    (0.5, 3.5, 2.25, 0.28641490), (0.3, 30.5, 120.25, 0.99704143), (0.5, 50100.0, 50000.0, 0.37597427), (0.25, 1.0, 1.0, 0.25),
])
def test_beta_cdf(spark, x, a, b, want):
    got = spark.range(1).select(url_filter.beta_cdf(x, F.lit(a), F.lit(b)).alias("p")).first().p
    assert abs(got - want) < 1e-6


def test_join_hot(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(1200)] + [(None, 5)], "k string, v int")
    table = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.min("v").alias("least"))
    got = sorted((r.k, r.v, r.least) for r in join_hot(rows, table, "k", "w").collect())
    assert got == sorted([("hot", i, 0) for i in range(500)] + [(f"k{i}", i, i) for i in range(1200)])


def test_oracles(spark, tmp_path):
    """The registered queries against their SQL, on a table with odd rows."""
    import duckdb

    from formloom.llm import queries

    spark.createDataFrame(conversations(), TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    hosts = ["a.bad.org", "b.bad.org", "fine.net", "www.shop.co.uk", "Example.COM", "x.example.com"]
    dice = random.Random(2)
    urls = [(i, f"http://{dice.choice(hosts)}/{dice.choice(['en', 'es', 'p'])}/{dice.randint(0, 400)}", None) for i in range(300)]
    spark.createDataFrame([*urls, (901, None, None), (902, "plain", None), (None, "http://fine.net/fr/1", None)], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(300)] + [(3, None, None), (None, 0, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("conversations", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("op11_turn_repair", "op13_host_reputation"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        mine = Counter(tuple(r) for r in df.select(*columns).collect())
        theirs = Counter(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall())
        assert mine == theirs
