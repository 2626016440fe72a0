"""Text similarity: twice the matched characters over the total length.

The ratio is the longest-matching-blocks measure of ``difflib``; it has no
Catalyst form, so it runs as an Arrow UDF.  It depends on argument order, and
``autojunk`` (on by default, as stored scores expect) ignores characters that
make up more than 1% of a second text of 200 or more.  Equal texts never reach
Python: callers go through :func:`similarity`, which answers those in the JVM.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.functions.text import as_col


def _ratio(a: str, b: str, autojunk: bool) -> float:
    return SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


def _pair_udf(autojunk: bool):
    @F.pandas_udf(T.DoubleType())
    def pair(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for a, b in zip(left, right):
            if a is None or b is None:
                out.append(None)
                continue
            if (a, b) not in known:
                known[(a, b)] = _ratio(a, b, autojunk)
            out.append(known[(a, b)])
        return pd.Series(out, dtype="float64")

    return pair


def _list_udf(autojunk: bool):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def pairs(left: pd.Series, right: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}

        def score(a, b):
            if a is None or b is None:
                return None
            if (a, b) not in known:
                known[(a, b)] = _ratio(a, b, autojunk)
            return known[(a, b)]

        return pd.Series(
            [
                None if xs is None else [score(a, b) for a, b in zip(xs, ys)]
                for xs, ys in zip(left, right)
            ]
        )

    # Kept apart from the expressions around it: a UDF cannot run inside a lambda.
    return pairs.asNondeterministic()


def similarity(a: Column | str, b: Column | str, *, autojunk: bool = True) -> Column:
    """Ratio in [0, 1]; equal texts (two empty ones too) score 1 without Python."""
    left, right = as_col(a), as_col(b)
    differ = left != right
    scored = _pair_udf(autojunk)(F.when(differ, left), F.when(differ, right))
    return F.when(left == right, F.lit(1.0)).otherwise(scored)


def similarity_lists(a: Column, b: Column, *, autojunk: bool = True) -> Column:
    """Element-wise ratios of two ``ARRAY<STRING>`` columns (null where equal is
    already known: callers null out those entries)."""
    return _list_udf(autojunk)(a, b)


def upper_bound(a: Column, b: Column) -> Column:
    """No ratio can exceed this; lets a threshold test skip hopeless pairs."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, 1.0).otherwise(2.0 * F.least(la, lb) / (la + lb))


#: Letters of slugs; others count as none, which only loosens the bound below.
SLUG_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_"


def letter_counts(text: Column | str) -> Column:
    """How often each of :data:`SLUG_LETTERS` occurs, then how many other characters."""
    t = as_col(text)
    return F.concat(
        F.array(*[F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in SLUG_LETTERS]),
        F.array(F.length(F.translate(t, SLUG_LETTERS, ""))),
    )


def letters_bound(a: Column, b: Column) -> Column:
    """No ratio of two texts with these :func:`letter_counts` can exceed this: matched
    characters are shared characters."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda n, v: n + v)
    both = total(F.zip_with(a, b, lambda x, y: F.least(x, y)))
    return F.when(total(a) + total(b) == 0, 1.0).otherwise(2.0 * both / (total(a) + total(b)))


def similar_enough(a: Column | str, b: Column | str, threshold: float, *, autojunk: bool = True) -> Column:
    """``similarity(a, b) >= threshold`` with hopeless pairs decided in the JVM."""
    left, right = as_col(a), as_col(b)
    open_case = (left != right) & (upper_bound(left, right) >= threshold)
    scored = _pair_udf(autojunk)(F.when(open_case, left), F.when(open_case, right))
    return (left == right) | F.coalesce(scored >= threshold, F.lit(False))
