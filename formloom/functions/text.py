"""Text signals as Column expressions (all JVM-side).

Every helper takes a Column (or a column name) and returns a Column; none of
them needs Python at run time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom import vocabulary as V

#: What counts as white space when trimming (Unicode blanks included).
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same characters as a set to trim.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Trim every kind of white space at both ends (only the ends are looked at)."""
    return F.btrim(as_col(text), F.lit(_BLANKS))


def rstrip(text: Column | str) -> Column:
    return F.rtrim(as_col(text), F.lit(_BLANKS))


def stripped(text: Column | str) -> Column:
    """:func:`strip`, with null read as the empty string."""
    return F.coalesce(strip(text), F.lit(""))


def is_blank(text: Column | str) -> Column:
    """Null, empty or only white space."""
    return ~F.coalesce(as_col(text).rlike(_BLANK.replace("[", "[^", 1)), F.lit(False))


def lines(text: Column | str) -> Column:
    """``ARRAY<STRING>`` of the non-blank lines, trimmed, in order."""
    parts = F.transform(F.split(as_col(text), LINE_BREAKS), strip)
    return F.filter(parts, lambda line: line != "")


def one_line(text: Column | str) -> Column:
    """White space runs collapsed to one blank, ends trimmed."""
    return strip(F.regexp_replace(as_col(text), r"(?U)[\s\x1c-\x1f]+", " "))


def is_upper(text: Column) -> Column:
    """At least one cased character and no lower-case one."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def starts_with_any(text: Column, heads: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(h) for h in heads])


def title_case(text: Column | str) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    parts = F.regexp_extract_all(
        F.lower(as_col(text)), F.lit(r"((?U)\p{Alpha}+|[^\p{Alpha}]+)"), 1
    )
    return F.array_join(F.transform(parts, F.initcap), "")


# -- what kind of value is this ---------------------------------------------
# Patterns are searched in place (blanks around a value do not change the answer),
# so no test trims its text first.
def _found(text: Column | str, pattern: str) -> Column:
    return F.coalesce(as_col(text).rlike(pattern), F.lit(False))


def _whole(pattern: str) -> str:
    """Pattern of a whole value with blanks allowed around it."""
    core = pattern.removeprefix("(?U)^").removesuffix(r"\z").removesuffix("$")
    return rf"(?U)^{_BLANK}*{core}{_BLANK}*\z"


def detect_date(text: Column | str) -> Column:
    return _found(text, V.DATE_DIGITS) | _found(text, V.DATE_WORDS)


def detect_currency(text: Column | str) -> Column:
    return _found(text, V.CURRENCY)


def detect_percent(text: Column | str) -> Column:
    return _found(text, V.PERCENT)


def detect_email(text: Column | str) -> Column:
    return _found(text, V.EMAIL)


def is_pure_number(text: Column | str) -> Column:
    return _found(text, _whole(V.NUMBER))


def looks_like_person(text: Column | str) -> Column:
    return _found(text, _whole(V.PERSON)) & ~is_upper(as_col(text))


def value_kind(text: Column | str) -> Column:
    """``date`` before ``number`` before ``person``; everything else is ``text``.
    Dates and numbers hold a digit, so prose skips their patterns."""
    t = as_col(text)
    digit = _found(t, r"(?U)\d")
    return (
        F.when(digit & detect_date(t), "date")
        .when(digit & (detect_currency(t) | detect_percent(t) | is_pure_number(t)), "number")
        .when(looks_like_person(t), "person")
        .otherwise("text")
    )


def is_all_caps(text: Column | str) -> Column:
    return is_upper(as_col(text)) & (F.length(stripped(text)) > 2)


def semantic_hints(text: Column | str) -> Column:
    """Ordered ``ARRAY<STRING>`` of the signals a text gives."""
    t = as_col(text)
    signals = (
        ("label", _found(t, rf":{_BLANK}*\z")),
        ("all_caps", is_all_caps(t)),
        ("date", detect_date(t)),
        ("currency", detect_currency(t)),
        ("percent", detect_percent(t)),
        ("email", detect_email(t)),
        ("number", is_pure_number(t)),
        ("person", looks_like_person(t)),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in signals]))


# -- names -------------------------------------------------------------------
def slug(text: Column | str, fallback: Column | str = "field", max_words: int = 5) -> Column:
    """snake_case identifier of a label: words before the first colon, filler
    words dropped (unless nothing else is left), at most ``max_words``."""
    stop = "|".join(V.SLUG_STOPWORDS)
    head = F.split_part(F.lower(F.rtrim(stripped(text), F.lit(":"))), F.lit(":"), F.lit(1))
    words = F.btrim(F.regexp_replace(head, "[^a-z0-9]+", "_"), F.lit("_"))
    kept = F.btrim(
        F.regexp_replace(words, rf"(?<![a-z0-9])(?:{stop})(?:_|$)", ""), F.lit("_")
    )
    named = F.regexp_extract(
        F.coalesce(F.nullif(kept, F.lit("")), words),
        rf"^(?:[a-z0-9]+_){{0,{max_words - 1}}}[a-z0-9]+",
        0,
    )
    valid = F.regexp_replace(named, "^(?=[0-9])", "f_")
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(F.nullif(valid, F.lit("")), other)


def slug_tokens(text: Column | str) -> Column:
    """Distinct words of the slug (empty array when there are none)."""
    words = F.split(slug(text, ""), "_")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def label_from(field_name: Column | str, static_prefix: Column | str) -> Column:
    """Prefix without its colon, else the field name as title-cased words."""
    prefix = strip(F.rtrim(stripped(static_prefix), F.lit(":")))
    return F.coalesce(
        F.nullif(prefix, F.lit("")),
        title_case(F.translate(as_col(field_name), "_", " ")),
    )


def column_type(header: Column | str) -> Column:
    h = F.lower(as_col(header))
    return (
        F.when(contains_any(h, V.DATE_HEADER_HINTS), "date")
        .when(contains_any(h, V.NUMBER_HEADER_HINTS), "number")
        .otherwise("text")
    )


def label_is_personish(label: Column | str) -> Column:
    return contains_any(F.lower(F.coalesce(as_col(label), F.lit(""))), V.PERSON_LABEL_HINTS)


def safe_ident(name: Column | str) -> Column:
    n = as_col(name)
    return F.when(n.rlike(V.IDENTIFIER), n)


def section_toggle_name(section_key: Column | str) -> Column:
    return F.concat(F.lit("_show_"), F.nullif(slug(section_key, ""), F.lit("")))


def include_field_name(field_name: Column | str, text: Column | str) -> Column:
    named = F.nullif(as_col(field_name), F.lit(""))
    return F.concat(F.lit("include_"), F.coalesce(named, slug(text, "section")))


def safe_file_name(name: Column | str) -> Column:
    """Base name reduced to letters, digits and ``-_. ()``."""
    base = F.substring_index(as_col(name), "/", -1)
    kept = strip(F.regexp_replace(base, r"[^\p{L}\p{N}\-_. ()]", ""))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("file"))


def output_name(template_name: Column | str, request_id: Column | str) -> Column:
    return F.concat(
        slug(template_name, "document"), F.lit("-"),
        F.substring(as_col(request_id), 1, 8), F.lit(".docx"),
    )


def cell_row(subtype: Column | str) -> Column:
    """Row index of a table-cell element (its subtype reads ``r0c1``)."""
    return F.nullif(F.regexp_extract(as_col(subtype), r"^r(\d+)c\d+", 1), F.lit("")).cast("int")


def cell_name(text: Column | str) -> Column:
    kind = value_kind(text)
    return F.when(kind != "text", kind).otherwise(slug(text, "cell"))


def heading_subtype(style_name: Column | str) -> Column:
    s = F.lower(as_col(style_name))
    digits = F.regexp_replace(s, r"(?U)\D", "")
    return F.when(s.startswith("heading"), F.coalesce(F.nullif(digits, F.lit("")), F.lit("1"))).when(
        s.isin("title", "subtitle"), s
    )


def len_bucket(n: Column) -> Column:
    """Which of <1, <20, <80, <200, longer a length falls in (0..4)."""
    return F.when(n < 1, 0).when(n < 20, 1).when(n < 80, 2).when(n < 200, 3).otherwise(4)


def norm_text(text: Column | str) -> Column:
    return F.lower(one_line(text))


def image_content_type(file_name: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(as_col(file_name), r"(\.[^.]*)$", 1))
    return F.try_element_at(
        F.create_map(*[F.lit(x) for kv in V.IMAGE_MEDIA_TYPES.items() for x in kv]), ext
    )


# -- wording -----------------------------------------------------------------
def cut(text: Column, limit: int, tail: str = "…") -> Column:
    """First ``limit`` characters plus an ellipsis, when longer than that."""
    return F.when(
        F.length(text) > limit, F.concat(rstrip(F.substring(text, 1, limit)), F.lit(tail))
    ).otherwise(text)


def shorten(text: Column | str, limit: int = 60) -> Column:
    return cut(one_line(text), limit)


def redact(text: Column | str, keep: int = 12) -> Column:
    """Keep the head of a value and count what is hidden."""
    t = F.coalesce(as_col(text), F.lit(""))
    hidden = (F.length(t) - keep).cast("string")
    return (
        F.when(t == "", "")
        .when(F.length(t) <= keep, "…[redacted]")
        .otherwise(
            F.concat(F.substring(t, 1, keep), F.lit("…[redacted "), hidden, F.lit(" chars]"))
        )
    )


def fallback_description(
    label: Column, classification: Column, static_prefix: Column, enum_values: Column,
    example: Column,
) -> Column:
    """A usable description for a field nobody described."""
    hints = F.create_map(*[F.lit(x) for kv in V.KIND_SENTENCES.items() for x in kv])
    lead = F.coalesce(F.try_element_at(hints, classification), F.lit("The value"))
    sample = cut(F.coalesce(one_line(example), F.lit("")), 120)
    prefix = F.nullif(static_prefix, F.lit(""))
    return F.concat_ws(
        " ",
        F.concat(lead, F.lit(' for "'), label, F.lit('".')),
        F.concat(
            F.lit('In the document it follows the label "'), strip(prefix), F.lit('".')
        ),
        F.when(
            F.size(enum_values) > 0,
            F.concat(F.lit("Allowed values: "), F.array_join(enum_values, ", "), F.lit(".")),
        ),
        F.when(sample != "", F.concat(F.lit("Original example: “"), sample, F.lit("”"))),
    )


def synth_description(section: Column, text: Column) -> Column:
    sample = cut(F.coalesce(one_line(text), F.lit("")), 120)
    where = F.when(
        F.coalesce(section, F.lit("")) != "", F.concat(F.lit('the "'), section, F.lit('" section'))
    ).otherwise("the document")
    return F.concat(
        F.lit("Content for "), where, F.lit(". Original example: “"), sample, F.lit("”")
    )


def neutralize_markers(text: Column | str) -> Column:
    """Break literal template delimiters with a zero-width space."""
    out = as_col(text)
    for first, second in ("{{", "}}", "{%", "%}"):
        out = F.replace(out, F.lit(first + second), F.lit(first + "\u200b" + second))
    return out


def extract_value(text: Column | str, label: Column | str) -> Column:
    """What follows a known label in a text, tolerating spacing differences."""
    t = F.coalesce(as_col(text), F.lit(""))
    lab = F.coalesce(as_col(label), F.lit(""))
    head = F.rtrim(rstrip(lab), F.lit(":"))
    loose = (head != "") & F.startswith(F.lower(t), F.lower(head))
    colon = F.instr(t, ":")
    return (
        F.when((lab != "") & F.startswith(t, lab), strip(F.substr(t, F.length(lab) + 1)))
        .when(loose & (colon > 0), strip(F.substr(t, colon + 1)))
        .when(loose, strip(F.substr(t, F.length(head) + 1)))
        .otherwise(strip(t))
    )
