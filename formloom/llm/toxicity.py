"""Toxicity by a classifier chain.

One linear model for each category, in order; each model also reads the earlier
categories' probabilities.  For training those are out-of-fold: every document's
earlier probabilities come from models that have not seen it, as they will for new
documents.  The features are a document's distinct words and word beginnings (4 to 6
letters, so inflected forms share them) and a few shares that describe its form.

Models are fitted on a bounded sample of the labelled rows (``max_rows``), in one task
and to the same result each time; scoring runs over every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import text_of

#: Labelled rows the models are fitted on at most; half of them with a category set,
#: if there are as many.
MAX_ROWS = 8000
#: Features a model may use, of those in at least MIN_ROWS training rows whose share
#: among positive rows differs by at least MIN_Z standard errors.
MAX_FEATURES, MIN_ROWS, MIN_Z = 300, 5, 5.0
FOLDS, STEPS, RIDGE = 4, 300, 0.3
#: Share of the rows turned away that should be rightly so, where the threshold is set.
PRECISION = 0.98

_WORD = re.compile(r"[^\W\d_]+")
FORM = ("distinct", "capitals", "symbols", "length")


def form_of(text: str, words: list[str]) -> list[float]:
    n = max(1, len(words))
    return [
        len(set(words)) / n, sum(map(str.isupper, words)) / n,
        min(1.0, sum(map(text.count, "#*$%&|<>!")) / n), min(1.0, np.log10(1 + len(words)) / 5),
    ]


def features(words: set[str]) -> set[str]:
    """Words, and beginnings of longer ones (marked by a dash)."""
    out = set(words)
    for w in words:
        for k in (4, 5, 6):
            if len(w) > k:
                out.add(w[:k] + "-")
    return out


# -- linear models, in one task ---------------------------------------------------
class Rows:
    """Sparse 0/1 rows (feature numbers) with a few dense columns."""

    def __init__(self, lists: list[np.ndarray], dense: np.ndarray, width: int):
        self.cols = np.concatenate(lists) if lists else np.empty(0, np.int64)
        self.rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.dense, self.width, self.n = dense, width, len(lists)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n) + self.dense @ w[self.width :]

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.cols, r[self.rows], self.width), self.dense.T @ r])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(x: Rows, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps with adaptive scales."""
    w, mean, square = np.zeros(x.width + x.dense.shape[1]), 0.0, 0.0
    total = weight.sum()
    free = np.ones_like(w)
    free[-1] = 0.0  # the intercept
    for step in range(1, STEPS + 1):
        slope = (x.transposed_times(weight * (sigmoid(x.times(w)) - y)) + RIDGE * free * w) / total
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w = w - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p)) / 5


def choose(lists: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    """The features whose share differs most between positive and other rows."""
    positive = np.bincount(np.concatenate([lists[i] for i in np.flatnonzero(y == 1)] or [np.empty(0, int)]).astype(int), minlength=width)
    negative = np.bincount(np.concatenate([lists[i] for i in np.flatnonzero(y == 0)] or [np.empty(0, int)]).astype(int), minlength=width)
    a, b = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    p = (positive + negative + 1) / (a + b + 2)
    z = np.abs(positive / a - negative / b) / np.sqrt(p * (1 - p) * (1 / a + 1 / b))
    z[positive + negative < MIN_ROWS] = 0
    best = np.lexsort((np.arange(width), -z))[:MAX_FEATURES]
    return np.sort(best[z[best] >= MIN_Z])


def restricted(lists: list[np.ndarray], chosen: np.ndarray, width: int) -> list[np.ndarray]:
    to = np.full(width, -1)
    to[chosen] = np.arange(len(chosen))
    return [x[x >= 0] for x in (to[c] for c in lists)]


def train(table: pd.DataFrame, categories: list[str], folds: int = FOLDS) -> pd.DataFrame:
    """The chain's weights: category, feature, weight; features named ``<...>`` are the
    form, earlier probabilities, the intercept and the threshold."""
    table = table.sort_values("fold").reset_index(drop=True)
    vocabulary = sorted(set().union(*table["features"])) if len(table) else []
    number = {f: i for i, f in enumerate(vocabulary)}
    lists = [np.array(sorted(number[f] for f in row), int) for row in table["features"]]
    dense = np.array(table["form"].tolist(), float).reshape(-1, len(FORM))
    weight = table["weight"].to_numpy(float)
    fold = np.arange(len(table)) % folds
    out, earlier = [], []
    for category in categories:
        y = table[category].to_numpy(float)
        extra = np.column_stack([dense, *[logit(p) for p in earlier], np.ones(len(table))])
        oof = np.full(len(table), (weight * y).sum() / max(weight.sum(), 1e-9))
        if 0 < y.sum() < len(y):
            for k in range(folds):
                known = fold != k
                if not 0 < y[known].sum() < known.sum() or known.all():
                    continue
                chosen = choose([lists[i] for i in np.flatnonzero(known)], y[known], len(vocabulary))
                of_all = restricted(lists, chosen, len(vocabulary))
                model = fit(Rows([of_all[i] for i in np.flatnonzero(known)], extra[known], len(chosen)), y[known], weight[known])
                oof[~known] = sigmoid(Rows([of_all[i] for i in np.flatnonzero(~known)], extra[~known], len(chosen)).times(model))
            chosen = choose(lists, y, len(vocabulary))
            model = fit(Rows(restricted(lists, chosen, len(vocabulary)), extra, len(chosen)), y, weight)
            order = np.argsort(-oof, kind="stable")
            hits, taken = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
            good = np.flatnonzero(hits / taken >= PRECISION)
            # Between the last row taken and the next.
            last = good[-1] if len(good) else None
            cut = 1.0 if last is None else (oof[order[last]] + oof[order[min(last + 1, len(order) - 1)]]) / 2
        else:  # one class only: the share, and nothing is turned away
            chosen, cut = np.empty(0, int), 1.0
            model = np.zeros(extra.shape[1])
            share = np.clip(oof[0] if len(oof) else 0.0, 1e-6, 1 - 1e-6)
            model[-1] = np.log(share / (1 - share))
        names = [vocabulary[i] for i in chosen] + [f"<{f}>" for f in FORM]
        names += [f"<p {c}>" for c in categories[: len(earlier)]] + ["<intercept>"]
        out += [(category, f, float(v)) for f, v in zip(names, model, strict=True)] + [(category, "<threshold>", float(cut))]
        earlier.append(oof)
    return pd.DataFrame(out, columns=["category", "feature", "value"])


class Chain:
    """The fitted chain, applied to a text."""

    def __init__(self, weights: list[tuple[str, str, float]], categories: list[str]):
        self.categories = categories
        self.of_word: dict[str, np.ndarray] = {}
        self.rest: list[dict[str, float]] = [{} for _ in categories]
        for category, feature, value in weights:
            i = categories.index(category)
            if feature.startswith("<"):
                self.rest[i][feature] = value
            else:
                self.of_word.setdefault(feature, np.zeros(len(categories)))[i] = value

    def __call__(self, text: str) -> list[float]:
        words = _WORD.findall(text)
        found = features(set(map(str.lower, words))) & self.of_word.keys()
        linear = sum((self.of_word[f] for f in sorted(found)), np.zeros(len(self.categories)))
        form, out = form_of(text, words), []
        for i, rest in enumerate(self.rest):
            x = linear[i] + sum(rest.get(f"<{f}>", 0.0) * v for f, v in zip(FORM, form, strict=True))
            x += sum(rest.get(f"<p {c}>", 0.0) * float(logit(np.array(p))) for c, p in zip(self.categories, out, strict=False))
            out.append(float(sigmoid(np.array(x + rest.get("<intercept>", 0.0)))))
        return out

    def threshold(self, category: str) -> float:
        return self.rest[self.categories.index(category)].get("<threshold>", 1.0)


# -- on tables -------------------------------------------------------------------
def _featurise(categories: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [_WORD.findall(t) for t in batch["_text"]]
            yield batch[["fold", "weight", *categories]].assign(
                features=[sorted(features(set(map(str.lower, w)))) for w in words],
                form=[form_of(t, w) for t, w in zip(batch["_text"], words, strict=True)],
            )

    return run


def sample(labels: DataFrame, categories: dict[str, Column], key: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled keys, half of them with a category set, chosen by
    their hash, each weighted by the rows it stands for."""
    marks = [F.max(F.coalesce(c.cast("int"), F.lit(0))).alias(name) for name, c in categories.items()]
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(*marks)
    known = known.withColumn("_any", F.greatest(*[F.col(c) for c in categories], F.lit(0)) > 0)
    parts = []
    for is_set in (True, False):
        part = known.where(F.col("_any") == is_set)
        n = part.count()
        kept = part.orderBy(F.xxhash64("_key"), "_key").limit(max_rows // 2)
        parts.append(kept.withColumn("weight", F.lit(float(max(1, n)) / max(1, min(n, max_rows // 2)))))
    return parts[0].unionByName(parts[1]).drop("_any").withColumn("fold", F.xxhash64("_key", F.lit(7)))


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, key: str = "doc_id", text: str = "text",
    max_rows: int = MAX_ROWS,
) -> Chain:
    """Fits the chain on a bounded sample of the labelled documents.

    ``categories``: name to a 0/1 column of ``labels``, in chain order.  A key labelled
    twice has a category if any of its labels says so; null labels count as 0.
    """
    names = list(categories)
    chosen = sample(labels, categories, key, max_rows)
    texts = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_key").dropDuplicates(["_key"]).drop("_key")  # max_rows small rows
    kinds = ", ".join(f"{c} int" for c in names)
    table = rows.mapInPandas(
        _featurise(names), f"fold bigint, weight double, {kinds}, features array<string>, form array<double>"
    )
    fitted = table.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
        lambda t: train(t, names), "category string, feature string, value double"
    )  # the bounded sample, one task
    weights = [tuple(r) for r in fitted.collect()]  # at most MAX_FEATURES and a few for each category
    return Chain(weights, names)


def classify(
    docs: DataFrame, chain: Chain, *, reject: list[str], key: str = "doc_id", text: str = "text", keep: bool = False
) -> DataFrame:
    """Each row's probabilities and verdict: key, p_<category> ..., rejected.

    ``rejected``: a category of ``reject`` lies above its threshold, which was set on the
    out-of-fold probabilities.  ``keep`` returns the columns of ``docs`` with
    ``rejected`` instead.

    A null text is empty; repeated rows each get a row; with no labelled rows, or one
    class only, the probability is the share and nothing is rejected; an empty table
    gives an empty result; clashing column names don't matter.
    """
    names = chain.categories
    cuts = [(names.index(c), chain.threshold(c)) for c in reject]

    @F.pandas_udf("array<double>")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: chain(t or ""))

    others = [c for c in docs.columns if c != "rejected"] if keep else []
    judged = docs.select(
        F.struct(*([F.col(f"`{c}`") for c in others] or [F.col(key).alias("_key")])).alias("row"),
        probabilities(F.col(f"`{text}`").cast("string")).alias("p"),
    )
    over = F.lit(False)
    for i, cut in cuts:
        over = over | (F.get("p", F.lit(i)) > cut)
    if keep:
        return judged.select(*[F.col("row")[c].alias(c) for c in others], over.alias("rejected"))
    shares = [F.get("p", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(names)]
    return judged.select(F.col("row._key").alias(key), *shares, over.alias("rejected"))


#: The chain over the given labels: low quality first, then toxic.
def label_categories() -> dict[str, Column]:
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
