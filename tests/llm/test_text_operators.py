"""Extraction, toxicity, line deduplication, quality: brute force and held-out rows."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from formloom.llm import html_extraction, line_dedup, quality, toxicity
from formloom.llm.queries import op4_line_dedup

from .helpers import by_id, docs, fixture_dir

FILL = "the road was long and the night was cold but nobody wanted to stop before the sun came up".split()


# -- html ----------------------------------------------------------------------
def test_tree_learns_its_table_and_new_pages():
    x, y = html_extraction.labelled_blocks()
    tree = html_extraction.grow(x, y)
    assert sum((html_extraction.score(tree, r) >= 0.5) == bool(v) for r, v in zip(x, y)) >= 0.95 * len(y)
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><p>Site name and its long motto
    for all who come by here.</p></header><ul class="menu"><li><a href=/>Home</a><li><a href=/b>Blog</a></ul><main><h1>The
    <i>wet</i> summer</h1><p>It rained for <a href=/r>forty days</a>&nbsp;and the fields stood under water.<br>Then it stopped.<p>The
    crop was lost.</p><pre>a  b</pre><table><tr><td>May<td>12</tr></table><form><p>Write us a long letter about the weather where you
    live and win a prize.</p></form></main><div id="sidebar"><p>A long text about the author who likes the rain and the sea.</p></div>
    <div class="comments"><p>I had the same here, it rained and rained and never stopped at all.</p></div><script>if (a<b) { x("</p>") }
    </script><footer>&copy; us</footer></body></html>"""
    text = html_extraction.main_text(page, tree)
    assert text.split("\n\n") == [
        "The wet summer", "It rained for forty days and the fields stood under water. Then it stopped.", "The crop was lost.", "a b", "May", "12",
    ]


def test_extraction_of_the_given_pages(spark):
    """Against a plain reading of the pages' one layout."""
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def test_unclosed_elements_hide_no_article():
    """A head may go without its end tag; other hidden elements may lack theirs."""
    tree = html_extraction.grow(*html_extraction.labelled_blocks())
    story = [
        "Salt and snow", "The road over the pass was closed for nine days, and the people of the valley walked to the mill for flour.",
        "Nobody complained, for everyone had a sledge and most of them had a neighbour with a horse.",
    ]
    article = "<article><h1>{}</h1><p>{}</p><p>{}</p></article>".format(*story)
    whole = [
        f"<html><head><title>T</title><body>{article}", f"<html><head><title>T</title>{article}</html>",
        f"<head><title>T<body>{article}</body>", f"<head><style>p{{}}</style><noscript><img src=x><body>{article}</body>",
        f"<head><title>T</title></head><body>{article}<script>var x = '<p>never shown</p>'",
        f"<body><svg><title>never shown</title><path/></svg>{article}<noscript><p>never shown</p></noscript></body>",
    ]
    for tag in ("object", "template", "canvas", "iframe", "svg", "video", "noscript"):
        whole += [
            f"<body><div><{tag} id=x></div>{article}</body>", f"<body><{tag} id=x>{article}</body>", f"<{tag}>{article}",
            f"<body><div><{tag}><p>never shown</p></p></{tag}></div>{article}<{tag}>never shown</{tag}></body>",
            f"<body><{tag}>{article}<div><{tag}>never shown</{tag}></div></body>",
        ]
    for page in whole:
        assert html_extraction.main_text(page, tree).split("\n\n") == story, page
    assert html_extraction.main_text("<html><head><title>T</title><script>x", tree) == ""


def test_names_of_wrappers_and_of_asides():
    """A class that tells a state or a layout makes no aside; neither does any name of what holds the text."""
    tree = html_extraction.grow(*html_extraction.labelled_blocks())
    story = [
        "Salt and snow", "The road over the pass was closed for nine days, and the people of the valley walked to the mill for flour.",
        "Nobody complained, for everyone had a sledge and most of them had a neighbour with a horse.",
    ]
    inner = "<h1>{}</h1><p>{}</p><p>{}</p>".format(*story)
    talk = "<p>I was there as a child and I remember how the flour came down on a sledge in the night.</p>"
    article = f"<article>{inner}</article>"
    for page in (
        f"<div id='page' class='has-sidebar'>{article}</div>", f"<div class='layout header-fixed'>{article}</div>",
        f"<article class='post comments-open tag-alert'>{inner}</article>", f"<div class='share-enabled'>{article}</div>",
        f"<div class='wrap search'>{article}</div>", f"<main><div class='sidebar'>{article}</div></main>",
        f"<article class='post share'>{inner}</article>",
    ):
        for beside in (
            "", f"<div class='comments-area'>{talk}</div>", f"<div id='comments'><article>{talk}</article></div>",
            f"<div class='site-footer'>{talk}</div>", f"<ol class='comment-list'><li><article class='comment-body'>{talk}</article></ol>",
        ):
            assert html_extraction.main_text(f"<body>{page}{beside}</body>", tree).split("\n\n") == story, page + beside
            plain = html_extraction.main_text(f"<body><div>{inner}</div>{beside}</body>", tree)
            for name in ("sidebar", "layout--with-sidebar", "header-fixed"):
                assert html_extraction.main_text(f"<body><div class='{name}'>{inner}</div>{beside}</body>", tree) == plain and story[1] in plain
    long_talk = f"<div id='comments'>{talk * 6}</div>"
    assert html_extraction.main_text(f"<body><div class='post'>{inner}</div>{long_talk}</body>", tree).split("\n\n") == story


# -- toxicity ------------------------------------------------------------------
def test_chain_on_held_out_rows(spark):
    """Two categories, the second mostly where the first is; inflected words; a label twice."""
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(900):
        insult, threat = rng.random() < 0.25, False
        words = [rng.choice(FILL) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 80))]
        if insult:
            threat = rng.random() < 0.5
            words[3:3] = [rng.choice(["blockhe", "numskull"]) + rng.choice(["ads", "ish", "s"])] * 2
        if threat:
            words[9:9] = ["punchyou" + rng.choice(["all", "now"])]
        rows.append((i, " ".join(words), "en", "a"))
        marks.append((i, int(insult), int(threat)))
    d = docs(spark, rows)
    known = spark.createDataFrame(marks[:600] + marks[:3], "doc_id bigint, insult int, threat int")
    chain = toxicity.train_chain(d, known, {"insult": F.col("insult"), "threat": F.col("threat")}, max_rows=500)
    assert "<p insult>" in chain.rest[1] and "<p insult>" not in chain.rest[0]
    got = by_id(toxicity.classify(d, chain, reject=["insult", "threat"]), "p_insult", "p_threat", "rejected")
    held = marks[600:]
    assert sum(got[i][2] == bool(a or b) for i, a, b in held) >= 0.97 * len(held)
    assert sum((got[i][1] > chain.threshold("threat")) == bool(b) for i, _, b in held) >= 0.95 * len(held)
    again = toxicity.train_chain(d, known, {"insult": F.col("insult"), "threat": F.col("threat")}, max_rows=500)
    assert again.rest == chain.rest


def test_one_class_rejects_nothing(spark):
    d = docs(spark, [(i, " ".join(FILL), "en", "a") for i in range(20)])
    known = spark.createDataFrame([(i, 1, 1) for i in range(20)], "doc_id bigint, quality int, toxic int")
    chain = toxicity.train_chain(d, known, toxicity.label_categories())
    got = toxicity.classify(d, chain, reject=["toxic"]).collect()
    assert not any(r.rejected for r in got) and all(r.p_toxic > 0.99 for r in got)


# -- line dedup ----------------------------------------------------------------
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows):
    seen, out = [], {}
    for i, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            ws = [w for w in re.split("[\x20\x09-\x0d]+", line) if w]
            near = any(
                ws == s or min(len(ws), len(s)) >= line_dedup.NEAR_WORDS and abs(len(ws) - len(s)) <= 1 and distance(ws, s) <= 1
                for s in seen
            )
            if ws and near:
                seen.append(ws)
                continue
            if ws:
                seen.append(ws)
            kept.append(line)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_brute_force(spark, seed, tmp_path):
    rng = random.Random(seed)
    pool = [[rng.choice("abcd") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33]))] for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 6)):
            ws = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(ws) + 1)
                ws[at : at + rng.choice([0, 1])] = rng.choice([[], [rng.choice("abcx")]])
            lines.append(rng.choice([" ", "\t", "  "]).join(ws) + rng.choice(["", " ", "\r"]))
        rows.append((i, "\n".join(lines)))
    sf_dir = fixture_dir(spark, tmp_path / "t", [(i, t, "en", "a") for i, t in rows])
    assert by_id(op4_line_dedup(spark, sf_dir), "text") == brute_lines(rows)


# -- quality -------------------------------------------------------------------
def brute_counts(text):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    symbols = sum(map(text.count, quality.SYMBOLS))
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(inside)


def test_counts_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["", "a", "a a a", "a a a a a", "a b c a b c", "x\ny\nx\n\n \nx", "漢 字 漢 字 漢 # <b> $\x0b%"]
    texts += [rng.choice([" ", "\n"]).join(rng.choice("abcde#$") * rng.randint(1, 3) for _ in range(n)) for n in range(3, 60)]
    got = by_id(
        quality.measure(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    )
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    cases = [(1000, 5, 0.0125), (40, 0, 0.05), (300, 12, 0.0125), (50, 50, 0.3), (7, 3, 0.5)]
    for n, k, p in cases:
        df = spark.createDataFrame([(n, k)], "n bigint, k bigint")
        got = df.select(F.exp(quality.log_binomial_cdf(F.col("n"), F.col("k"), p)).alias("x")).first().x
        assert got == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_cutoffs_are_safe_and_take_effect(spark):
    """Good rows seldom have symbols, bad ones mostly: the rule must catch them, stratum by
    stratum, and only where the labels are enough."""
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(1600):
        lang = "en" if i % 8 else "xx"
        bad = rng.random() < 0.3
        words = [f"{rng.choice(FILL)}{rng.randrange(99)}" + ("$$$" if bad and rng.random() < 0.8 else "") for _ in range(70)]
        rows.append((i, " ".join(words), lang, "a"))
        marks.append((i, int(not bad), 0))
    d, known = docs(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = by_id(quality.apply_rules(d, known), "kept", "base_failed")
    english = [(i, q) for i, q, _ in marks if rows[i][2] == "en"]
    assert all(got[i][0] == bool(q) for i, q in english)
    assert all(got[i][0] for i in got if rows[i][2] == "xx")  # 200 labels prove nothing at 1.25 %
    assert not any(f for _, f in got.values())
