"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut after blank lines into sections and after every line end into
paragraphs; nothing is dropped, so the parts joined again are the text.  A
paragraph's hash is the SHA-256 of its text, a section's that of its paragraphs'
hashes, the root's that of its sections' hashes.  Equal roots mean equal texts; where
roots differ, the sections and paragraphs that differ hold the edit.  Below each
paragraph its pieces (at most 32 code points, cut anew at sentence ends) have short
hashes, so an edit inside a long paragraph is placed too, and the share of pieces
that two fingerprints have in common is their likeness.

A fingerprint is written as ``root|section:paragraph.piece.piece,paragraph.piece;section:...``
with 64, 16, 16 and 8 hexadecimal digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import let, numbered, text_of

_SECTION, _PARAGRAPH = r"(?<=\n\n)(?!\n)", r"(?<=\n)"
_PIECE = r"[^.!?\n]{1,32}(?:[.!?]+[ \t]*)?|[.!?\n]+[ \t]*"


def _parts(text: Column, at: str) -> Column:
    return F.filter(F.split(text, at), lambda p: p != "")


def _short(piece: Column) -> Column:
    return F.concat(F.lit("."), F.substring(F.lpad(F.lower(F.hex(F.xxhash64(piece))), 16, "0"), 9, 8))


def _node(children: Column, mark: str, between: str) -> Column:
    """A node over ``children`` (hash, told): its own hash and what is told of it."""
    digest = F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), "").cast("binary"), 256)
    told = F.array_join(F.transform(children, lambda c: c["told"]), between)
    return let(digest, lambda h: F.struct(h.alias("hash"), F.concat(F.substring(h, 1, 16), F.lit(mark), told).alias("told")))


def _paragraph(text: Column) -> Column:
    pieces = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), _short), "")
    return let(
        F.sha2(text.cast("binary"), 256),
        lambda h: F.struct(h.alias("hash"), F.concat(F.substring(h, 1, 16), pieces).alias("told")),
    )


def _section(text: Column) -> Column:
    return let(F.transform(_parts(text, _PARAGRAPH), _paragraph), lambda ps: _node(ps, ":", ","))


def fingerprint(text: Column) -> Column:
    """A text's fingerprint; the empty text has a root and no sections."""
    def tree(sections: Column) -> Column:
        hashes = F.array_join(F.transform(sections, lambda s: s["hash"]), "")
        told = F.array_join(F.transform(sections, lambda s: s["told"]), ";")
        return F.concat(F.sha2(hashes.cast("binary"), 256), F.lit("|"), told)

    return let(F.transform(_parts(text, _SECTION), _section), tree)


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 64)


def _pieces(print_: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(print_, F.lit(r"\.([0-9a-f]{8})"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, 0 to 1: the share of distinct pieces they have
    in common (twice the common over the sum); 1 exactly for equal roots only."""
    def share(ps: Column) -> Column:
        both = F.size(F.array_intersect(ps["a"], ps["b"])).cast("double")
        # Texts of the same pieces in another order are alike, but not equal.
        return F.least(2 * both / F.greatest(F.size(ps["a"]) + F.size(ps["b"]), F.lit(1)), F.lit(0.9999))

    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(
        let(F.struct(_pieces(a).alias("a"), _pieces(b).alias("b")), share)
    )


def edits(a: Column, b: Column) -> Column:
    """The paragraphs of fingerprint ``b`` that ``a`` lacks, as (section, paragraph)
    counted from 0: where ``b`` was edited.  Sections that ``a`` has are not entered."""
    def told(print_: Column) -> Column:
        return F.filter(F.split(F.substring_index(print_, "|", -1), ";"), lambda s: s != "")

    known = F.regexp_extract_all(a, F.lit(r"(?:^|[:,])([0-9a-f]{16})(?=[.,;]|$)"), F.lit(1))
    sections = F.transform(told(a), lambda s: F.substring(s, 1, 16))

    def changed(s: Column, i: Column) -> Column:
        hashes = F.transform(F.split(F.substring_index(s, ":", -1), ","), lambda p: F.substring(p, 1, 16))
        marked = F.transform(hashes, lambda h, j: F.struct(i.alias("section"), j.alias("paragraph"), h.alias("hash")))
        lacking = F.filter(marked, lambda m: ~F.array_contains(known, m["hash"]))
        return F.when(F.array_contains(sections, F.substring(s, 1, 16)), F.slice(marked, 1, 0)).otherwise(lacking)

    return F.flatten(F.transform(told(b), changed))


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint: key, n_chars, fingerprint.  A null text is empty."""
    return docs.select(
        F.col(key).alias(key), F.char_length(text_of(text)).cast("bigint").alias("n_chars"),
        fingerprint(text_of(text)).alias("fingerprint"),
    )


def edited_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited text has its last ``floor(n_chars / 4)`` code points replaced by the
    first as many (or all) of the next document, by ascending key; after the last
    comes the first.  Returns key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    A null text is empty; null keys come last; rows of one key are ordered by their
    text's hash, and rows equal in both are one document met several times: each
    gives the same row, and the next document is the next different one (itself, if
    there is no other).  An empty table gives an empty result; further columns are
    ignored.

    Texts cross the network once, by key: the order is found on narrow rows, each
    document sends only the beginning that its predecessor needs.
    """
    # A document is known by the hashes of its key and text: plain, never null, so the
    # shuffle by them serves the joins and the aggregate alike.
    texts = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")).withColumns(
        {"_key_hash": F.xxhash64("_key"), "_hash": F.xxhash64("_text")}
    )
    ids = texts.groupBy("_key", "_key_hash", "_hash").agg(F.max(F.char_length("_text")).cast("bigint").alias("n_chars"))
    order = numbered(ids, ["_key", "_hash"], "_at")
    n = max(order.count(), 1)
    prior = F.struct(F.col("_key").alias("key"), F.col("_key_hash").alias("key_hash"), F.col("_hash").alias("hash"), "n_chars").alias("_prior")
    before = order.select(((F.col("_at") + 1) % n).alias("_at"), prior)
    links = order.join(before, "_at").select("_key_hash", "_hash", "_prior")
    sent = (
        texts.join(links, ["_key_hash", "_hash"])
        .select(
            F.col("_prior.key_hash").alias("_key_hash"), F.col("_prior.hash").alias("_hash"),
            F.struct(  # the key comes back with it, so both joins read one shuffle of the same columns
                F.col("_prior.key").alias("key"),
                F.substring(F.col("_text"), F.lit(1), F.floor(F.col("_prior.n_chars") / 4).cast("int")).alias("head"),
                fingerprint(F.col("_text")).alias("print"),
            ).alias("_next"),
        )
        .groupBy("_key_hash", "_hash").agg(F.first("_next").alias("_next"))
    )
    length = F.char_length("_text")
    edited = F.concat(
        F.substring(F.col("_text"), F.lit(1), length - F.floor(length / 4).cast("int")), F.col("_next.head")
    )
    made = texts.join(sent, ["_key_hash", "_hash"]).select(
        F.col("_next.key").alias(key), length.cast("bigint").alias("n_chars"), F.col("_next.print").alias("_next_print"),
        fingerprint(F.col("_text")).alias("fingerprint"),
        let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), fingerprint(e).alias("print"))).alias("_e"),
    )
    return made.select(
        key, "n_chars", F.col("_e.sha").alias("edited_sha256"), "fingerprint",
        F.col("_e.print").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("_e.print")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next"),
    )
