"""Dates, numbers and value coercion as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formloom import vocabulary as V
from formloom.functions.text import LINE_BREAKS, as_col, is_blank, strip, stripped
from formloom.functions.richtext import strip_markers


# -- dates -------------------------------------------------------------------
def _try_date(text: Column, pattern: str) -> Column:
    return F.try_to_date(text, pattern)


#: A weekday before a date, and a time after it.
_WEEKDAY = r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+"
_CLOCK = r"(?i)(?<=[0-9])(?:T|,?\s+)[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?\s*(?:Z|[AP]M|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})?$"


def bare_date(text: Column) -> Column:
    """A date without its weekday and time of day."""
    return F.regexp_replace(F.regexp_replace(text, _WEEKDAY, ""), _CLOCK, "")


def parse_date(text: Column | str, patterns: tuple[str, ...]) -> Column:
    """First pattern that reads the whole text, as DATE; null when none does."""
    t = stripped(text)
    return F.coalesce(*[_try_date(t, p) for p in patterns])


def is_valid_date(text: Column | str, formats: Column | None = None) -> Column:
    """Whether the text is a date: one of the rule's formats (strptime spelling,
    an ``ARRAY<STRING>`` column) or one of the accepted free-form shapes, with or
    without a weekday before and a time behind it."""
    t = bare_date(stripped(text))
    digit = t.rlike("[0-9]")  # every pattern asks for one, and a failed reading is dear
    loose = parse_date(t, V.LOOSE_DATE_PATTERNS).isNotNull()
    iso = _try_date(t, V.DATE_PATTERNS["%Y-%m-%d"]).isNotNull()
    if formats is None:
        named = parse_date(t, tuple(V.DATE_PATTERNS.values())).isNotNull()
        return digit & (named | loose)
    allowed = F.coalesce(formats, F.array(F.lit("%Y-%m-%d")))
    named = iso
    for spelling, pattern in V.DATE_PATTERNS.items():
        named = named | (
            F.array_contains(allowed, spelling) & _try_date(t, pattern).isNotNull()
        )
    # The free-form reader also accepts month-first and day-first slashes.
    slashes = parse_date(t, ("M/d/yyyy", "d/M/yyyy", "MMMM d, yyyy")).isNotNull()
    return digit & (named | slashes | loose)


def normalize_date(text: Column | str) -> Column:
    """``STRUCT<ok, iso, reason>``: the date inside a text, as ISO."""
    t = stripped(text)
    span = F.coalesce(
        F.nullif(F.regexp_extract(t, f"({V.DATE_DIGITS})", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, f"({V.DATE_WORDS})", 1), F.lit("")),
        bare_date(t),
    )
    # A month may be cut to three letters and end in a dot.
    plain = F.regexp_replace(F.initcap(span), r"(?i)\b(sep)t\b|\.(?=\s)", "$1")
    found = parse_date(
        plain,
        ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "M-d-yyyy", "M.d.yyyy",
         "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "MMMM d, yyyy", "MMMM d yyyy",
         "MMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy"),
    )
    return F.struct(
        found.isNotNull().alias("ok"),
        found.cast("string").alias("iso"),
        F.when(t == "", "empty").when(found.isNull(), "unparseable").alias("reason"),
    )


# -- numbers -----------------------------------------------------------------
def parse_number(text: Column | str) -> Column:
    """Digits, dots and dashes kept, read as DOUBLE; null when that fails."""
    cleaned = F.regexp_replace(as_col(text), r"(?U)[^\d.\-]", "")
    return F.when(cleaned.rlike(r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), cleaned).try_cast("double")


def normalize_number(text: Column | str) -> Column:
    """``STRUCT<ok, number, reason>``: first number in a text, commas dropped."""
    t = stripped(text)
    raw = F.nullif(
        F.regexp_extract(F.replace(t, F.lit(",")), r"([-+]?[0-9]*\.?[0-9]+)", 1), F.lit("")
    )
    num = raw.try_cast("double")
    whole = (num == F.floor(num)) & (F.abs(num) < 1e18)
    shown = F.when(whole, num.cast("bigint").cast("string")).otherwise(num.cast("string"))
    return F.struct(
        num.isNotNull().alias("ok"),
        shown.alias("number"),
        F.when(t == "", "empty").when(num.isNull(), "no number found").alias("reason"),
    )


def clamp01(value: Column | str, default: float) -> Column:
    x = as_col(value).try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(
        F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    )


# -- coercion ----------------------------------------------------------------
def coerce_bool(value: Column | str) -> Column:
    v = as_col(value)
    return F.coalesce(~F.lower(strip(v)).isin(*V.FALSE_WORDS), F.lit(False))


def coerce_scalar(value: Column | str) -> Column:
    """Text for display: null is empty, a BOOLEAN reads Yes or No."""
    return F.coalesce(as_col(value).cast("string"), F.lit(""))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").when(~flag, "No").otherwise("")


def coerce_str_list(value: Column | str) -> Column:
    """Non-blank lines of a value with list and emphasis markers removed."""
    marked = F.transform(F.split(as_col(value), LINE_BREAKS), strip_markers)
    return F.coalesce(
        F.filter(marked, lambda line: ~is_blank(line)), F.array().cast("array<string>")
    )


def coerce_rows(rows: Column, columns: Column) -> Column:
    """Row maps reduced to the declared column names, missing cells ``""``.

    ``columns`` is an ``ARRAY<STRING>``; an empty one keeps the row as it is.
    """
    def keep(row: Column) -> Column:
        cells = F.transform(columns, lambda c: F.coalesce(F.try_element_at(row, c), F.lit("")))
        return F.when(F.size(columns) > 0, F.map_from_arrays(columns, cells)).otherwise(row)

    return F.coalesce(
        F.transform(rows, keep), F.array().cast("array<map<string,string>>")
    )


def rows_from_cells(grid: Column, columns: Column) -> Column:
    """Positional cell rows keyed by column name; extra cells are left out."""
    def keyed(cells: Column) -> Column:
        n = F.least(F.size(columns), F.size(cells))
        return F.map_from_arrays(F.slice(columns, 1, n), F.slice(cells, 1, n))

    return F.transform(grid, keyed)


def image_bytes(value: Column | str) -> Column:
    """Decoded picture of a base64 or data-URL text; null when it is neither."""
    v = stripped(value)
    body = F.when(v.startswith("data:") & v.contains(","), F.substr(v, F.instr(v, ",") + 1)).otherwise(v)
    return F.try_to_binary(F.nullif(body, F.lit("")), F.lit("base64"))


# -- answer vocabulary -------------------------------------------------------
def coerce_classification(value: Column | str) -> Column:
    v = as_col(value)
    return F.when(v.isin(*V.CLASSIFICATIONS), v).otherwise("UNKNOWN")


def coerce_field_type(value: Column | str) -> Column:
    v = as_col(value)
    return F.when(v.isin(*V.FIELD_TYPES), v)


def default_field_type(classification: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in V.DEFAULT_FIELD_TYPE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, as_col(classification)), F.lit("text"))
