"""Near-duplicates, packing, mixing, counts, fingerprints, shards: brute force and round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from formloom.llm import components, merkle, minhash, mixing, packing, sharding, token_counts, tokenization
from formloom.llm.common import numbered
from formloom.llm.queries import op3_bin_completion, op5_minhash_near_dedup, op8_token_counts, op9_merkle_prints, op10_feistel_shards

from .helpers import by_id, docs, fixture_dir

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a\x1cb c", "  two  spaces\n\n x", "don't  WON'T 12²³ ½x", "<|endoftext|> hi", "日本語 text    z", "tail \n ", "", "\n\n\n",
    "x" * 50 + " \t\ty", "ſs  É  ǅ", "İ Σας ΣΑΣ", "é   q", "a<|startoftext|>b", "'S 'Ll it'll", "​ z　y",
]


# -- near-duplicates -------------------------------------------------------------
def brute_components(rows, k, part):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        return i if up[i] == i else top(up[i])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= part * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def chains(rng, n):
    """Texts in chains of small edits, so links alone hold groups together."""
    rows, text = [], []
    for i in range(n):
        if i % 12 == 0:
            text = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 5, 40, 60, 150]))]
        text = list(text)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = f"w{rng.randrange(400)}"
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in text)))
    return rows + [(n, None), (n + 1, " \n"), (n + 2, "")]


def test_near_duplicates_against_brute_force(spark, tmp_path):
    rows = chains(random.Random(4), 240)
    sf_dir = fixture_dir(spark, tmp_path / "t", [(i, t, "en", "a") for i, t in rows])
    got = by_id(op5_minhash_near_dedup(spark, sf_dir), "n_shingles", "component_id", "kept")
    assert got == brute_components(rows, 3, 85)


def test_block_links_join_what_brute_force_joins():
    rng = random.Random(8)
    base = list(range(120))
    sets = []
    for i in range(60):
        s = set(base) - set(rng.sample(base, rng.choice([1, 3, 9, 15]))) | {1000 + 50 * i + j for j in range(rng.choice([0, 2, 9]))}
        sets.append(np.array(sorted(s), np.uint64))
    found = minhash.block_links(list(range(60)), list(range(60)), [True] * 60, sets, 85, 100)
    up = list(range(60))

    def top(i):
        return i if up[i] == i else top(up[i])

    for a, b in found:
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
        assert top(a) != top(b)  # a forest
        up[max(top(a), top(b))] = min(top(a), top(b))
    for a in range(60):
        for b in range(a):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b])):
                assert top(a) == top(b)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    bins, errors = 128, []
    assert (minhash.sketch(np.array([7], np.uint64), bins) != 0).all()
    for _ in range(60):
        items = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = minhash.sketch(items[:250], bins), minhash.sketch(items[50:], bins)
        errors.append((a == b).mean() - 200 / 300)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    up = {x: x for e in edges for x in e}

    def top(i):
        return i if up[i] == i else top(up[i])

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: top(i) for e in edges if e[0] != e[1] for i in e}


# -- tokens and packing ------------------------------------------------------------
@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_the_librarys(path):
    from tokenizers import Tokenizer

    library, encode = Tokenizer.from_file(path), tokenization.encoder(path)
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice(["a", "B", "é", " ", "  ", "\n", "'ll", "9", "?", "漢", "\t", "<|endoftext|>"]) for _ in range(40)) for _ in range(300)]
    texts += ["".join(rng.choice("aBé '\t\n\r  lls9?#ÿ") for _ in range(30)) for _ in range(2000)]
    texts += [blank * 20_000 + "end" for blank in (" ", "\n", " \t")] + ["x" * 20_000, "a " * 9000]
    for t in texts:
        assert encode(t) == library.encode(t, add_special_tokens=False).ids, t


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    d = docs(spark, [(i, t, "en", "a") for i, t in enumerate(ODD)])
    got = by_id(token_counts.count_tokens(d, path), "n_tokens")
    assert got == {i: len(pieces.encode(t)) for i, t in enumerate(ODD)}


def test_count_query_and_cache(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = [(i, t, "en", "a") for i, t in enumerate([*ODD, None, *ODD[:4], "word " * 3000])]
    got = by_id(op8_token_counts(spark, fixture_dir(spark, tmp_path / "t", rows)), "n_bytes", "n_tokens", "over_limit")
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048)
    # A second run of the query finds everything in the lasting store.
    store = token_counts.store_of(spark, str(tmp_path / "t"))
    stored = spark.read.parquet(store).count()
    again = by_id(op8_token_counts(spark, str(tmp_path / "t")), "n_bytes", "n_tokens", "over_limit")
    assert again == got and spark.read.parquet(store).count() == stored
    cache, d = str(tmp_path / "cache"), docs(spark, rows)
    token_counts.count_tokens(d, WORDS, cache=cache, normalise=token_counts.collapsed).collect()
    first = spark.read.parquet(cache).count()
    token_counts.count_tokens(d.union(docs(spark, [(99, "brand new", "en", "a")])), WORDS, cache=cache, normalise=token_counts.collapsed).collect()
    assert spark.read.parquet(cache).count() == first + 1  # only the miss was encoded
    token_counts.count_tokens(d, BYTES, cache=cache).collect()
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


def check_packed(pieces, texts, n_sequences=None):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    of_doc, of_sequence = {}, {}
    for p in pieces:
        of_doc.setdefault(p.doc_id, []).append(p)
        of_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(of_doc[i], key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(-(-len(ids) // 1024)))
        assert sum(p.length for p in own) == len(ids) and all(p.length == 1024 for p in own[1:])
        for p in own:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for own in of_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    return len(of_sequence), -(-sum(p.length for p in pieces) // 1024)


def test_packing_query(spark, tmp_path):
    rng = random.Random(11)
    texts = {i: " ".join(rng.choice(["alpha", "Beta", "c", "délta"]) for _ in range(rng.choice([0, 1, 40, 200, 400, 700, 2500]))) for i in range(150)}
    texts[150] = None
    sf_dir = fixture_dir(spark, tmp_path / "t", [(i, t, "en", "a") for i, t in texts.items()])
    pieces = op3_bin_completion(spark, sf_dir).collect()
    used, least = check_packed(pieces, texts)
    lengths = np.bincount([p.length for p in pieces], minlength=1025)
    assert least <= used <= packing.n_bins(packing.best_fit(lengths, 1024))


def least_bins(items, size):
    """The least number of bins, by trying everything."""
    best = len(items)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i, room in enumerate(bins):
            if room >= rest[0] and room not in bins[:i]:
                go(rest[1:], bins[:i] + [room - rest[0]] + bins[i + 1 :])
        go(rest[1:], [*bins, size - rest[0]])

    go(sorted(items, reverse=True), [])
    return best


def test_bin_completion_is_least():
    rng = random.Random(2)
    for _ in range(60):
        items = [rng.randint(5, 60) for _ in range(rng.randint(1, 12))]
        found = packing.complete_bins(np.bincount(items, minlength=101), 100)
        packed = Counter(x for b, n in found for x in b for _ in range(n))
        assert packed == Counter(items) and all(sum(b) <= 100 for b, _ in found)
        assert packing.n_bins(found) == least_bins(items, 100)


def test_fillings_beyond_the_greedy_ones():
    """Without small pieces: packings that waste nothing, of three and more pieces a sequence."""
    for least, items in (
        (5, [350, 331, 311, 291, 290, 284, 280, 277, 271, 249, 243, 231, 207, 192, 181, 171, 168, 167, 164, 155, 155, 152]),
        (6, [389, 366, 359, 341, 323, 315, 302, 294, 291, 291, 284, 273, 272, 237, 215, 211, 196, 179, 179, 177, 173, 165, 156, 156]),
    ):
        found = packing.complete_bins(np.bincount(items, minlength=1025), 1024)
        assert packing.n_bins(found) == least
        assert Counter(x for b, n in found for x in b for _ in range(n)) == Counter(items) and all(sum(b) <= 1024 for b, _ in found)


# -- mixing ----------------------------------------------------------------------
def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(sizes)
    left = sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 90), "en", rng.choice(["b", "a", "Z", None, "tiny", "ä"] if i % 40 else ["tiny"])) for i in range(900)]
    rows = [r for r in rows if r[3] != "tiny" or r[0] % 40 == 0]
    d = docs(spark, rows)
    got = mixing.mix_sizes(d).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    want, taken = brute_targets(dict(sizes)), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 90 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sizes(d.repartition(7)).collect()), key=str)
    times = Counter(r.doc_id for r in mixing.mix(d).select("doc_id").collect())
    assert {r.doc_id: r.taken for r in got if r.taken} == {i: n * len(rows_by[i].split()) for rows_by in [{r[0]: r[1] for r in rows}] for i, n in times.items() if rows_by[i].split()}


# -- fingerprints ------------------------------------------------------------------
def test_fingerprint_query(spark, tmp_path):
    rng = random.Random(12)
    texts = {i: "\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(9)) + "." for _ in range(rng.randint(1, 12))) for i in range(30)}
    texts |= {30: None, 31: "", 32: texts[0], 33: texts[0]}
    sf_dir = fixture_dir(spark, tmp_path / "t", [(i, t, "en", "a") for i, t in texts.items()])
    got = {r.doc_id: r for r in op9_merkle_prints(spark, sf_dir).collect()}
    for i, t in texts.items():
        t, follows = t or "", texts[(i + 1) % len(texts)] or ""
        n = len(t)
        edited = t[: n - n // 4] + follows[: n // 4]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (edited == t) and (r.near_next == 1) == (t == follows)
        if len(t.split("\n")) >= 4 and follows and follows != t:
            assert r.near_edited > 0.5 > r.near_next
    assert got[0].fingerprint == got[32].fingerprint == got[33].fingerprint != got[1].fingerprint


def test_differing_branches_locate_edits(spark):
    a = "One. Two.\nThree.\n\nFour five.\nSix.\n\nSeven."
    cases = {a: [], a.replace("Six", "Sax"): [(1, 1)], a.replace("One", "Ono"): [(0, 0)], a + " Eight.": [(2, 0)], "": []}
    df = spark.createDataFrame([(a, b) for b in cases], "a string, b string")
    prints = df.select("b", merkle.fingerprint(F.col("a")).alias("x"), merkle.fingerprint(F.col("b")).alias("y"))
    for r in prints.select("b", merkle.edits(F.col("x"), F.col("y")).alias("e")).collect():
        assert [(e.section, e.paragraph) for e in r.e] == cases[r.b]


# -- shards ------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 500])
def test_permutation(spark, n):
    at = [r.p for r in spark.range(n).select(sharding.permute(F.col("id"), n, "s").alias("p")).collect()]
    assert sorted(at) == list(range(n)) and (n < 100 or at != sorted(at))


def test_shard_query(spark, tmp_path):
    rows = [(i * 3, f"t{i}" * (i % 5) if i % 7 else None, "en", "a") for i in range(203)]
    got = op10_feistel_shards(spark, fixture_dir(spark, tmp_path / "t", rows)).collect()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        assert r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        assert r.law == "rows" and r.grown_shard is None and r.row_number == r.doc_id // 3
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(x == list(range(len(x))) for x in slots.values())
    assert {len(x) for x in slots.values()} == {25, 26}


def test_numbered_is_gapless_and_in_order(spark):
    rows = [(i % 11 if i % 5 else None, i) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "a bigint, b bigint"), ["a", "b"]).orderBy("row_number").collect()
    assert [r.row_number for r in got] == list(range(300))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_pipeline_against_its_parts(spark):
    """The pipeline's pieces are those of the documents that plain Python keeps, each as often."""
    import corpus_pipeline as pipeline
    from .test_text_operators import brute_lines

    sf_dir = "/root/testdata/sf0.001"
    docs_in = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = pipeline.drop_toxic(spark, docs_in, sf_dir)
    assert first.columns == docs_in.columns
    rows = {r.doc_id: r for r in first.collect()}
    assert len(rows) >= 0.8 * docs_in.count()
    lines = brute_lines([(i, r.text) for i, r in rows.items()])
    gone = {i for i, t in lines.items() if t != rows[i].text and not re.search(r"[^\x20\x09-\x0d]", t)}
    left = {i: t for i, t in lines.items() if i not in gone}
    groups = brute_components(list(left.items()), 5, 80)
    kept = {i: t for i, t in left.items() if groups[i][2]}
    d = docs(spark, [(i, t, rows[i].lang, rows[i].source) for i, t in kept.items()])
    times = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mix_sizes(d).collect()}
    pieces = pipeline.run(spark, sf_dir).collect()
    assert Counter(p.doc_id for p in pieces if p.piece == 0) == Counter({i: n for i, n in times.items() if n})
    assert sum(p.length for p in pieces) <= 1024 * len({p.sequence_id for p in pieces})


def test_pipeline_stages_on_odd_rows(spark):
    """Repeated, null and shared ids are rows like any other; clashing columns stay as they are."""
    import corpus_pipeline as pipeline

    from .helpers import with_clashes

    words = [f"word{i}" for i in range(40)]
    text, other = " ".join(words), " ".join(reversed(words))
    near = " ".join(words[:39] + ["changed"])
    rows = [(5, text, "en", "a"), (5, text, "en", "a"), (None, near, "en", "a"), (None, other, "en", "a"), (7, other, "en", "b"),
            (7, "a text of its own under the id of a copy", "en", "b"), (2**60 + 1, None, None, None), (2**60 + 3, "", None, None)]
    d = with_clashes(docs(spark, rows)).withColumns({"n_lines": F.lit(1), "n_removed": F.lit(2), "_row": F.lit(3), "_n": F.lit(4)})
    left = pipeline.dedup_documents(spark, d, "")
    assert left.columns == d.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([
        ("5", text), ("7", other), ("7", rows[5][1]), (str(2**60 + 1), None), (str(2**60 + 3), "")], key=lambda x: (x[0], x[1] or ""))
    lines = pipeline.dedup_lines(spark, d.drop("n_chars"), "")
    assert lines.columns == d.drop("n_chars").columns and {(r.n_lines, r.n_removed, r.rejected) for r in lines.collect()} == {(1, 2, 7)}
    assert pipeline.dedup_documents(spark, d.limit(0), "").collect() == []
