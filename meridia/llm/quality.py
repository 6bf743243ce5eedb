"""Quality: a generalised additive model with pairwise interactions.

Features are cut into at most BINS bins at quantiles of the training rows. Boosting goes round
the features: each turn fits a tree of at most four leaves to the gradients by bin and adds
a small part of it to the feature's lookup table. Then the pairs of features whose coarse grid
explains most of what is left get tables of their own, by the same rule with a split on each
feature. Rounds stop where the loss on fold 3 was least. A score is the logistic of the intercept
and the sum of table entries, looked up for whole batches.

Fitted on a sample of at most about MAX_ROWS labelled rows, whose features alone reach the driver.

Null and empty texts have no words: all features 0 and the score these give. With labels of one class
or none the score is the share of label 1, 1 without any, so that nothing is rejected. Repeated rows and
equal or null doc_ids each give a row. Columns other than doc_id and text are left out of quality_scores();
accepted_documents() keeps the columns of the input.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, fold
from .labelled import HELD_OUT, MAX_ROWS, training_rows
from .text_features import CLASSES, byte_classes

BINS = 48
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
RATE = 0.1
FEATURES = (
    "capitals", "digits", "bangs", "symbols", "bars", "points", "others", "spaces",
    "log_words", "word_length", "long_words", "distinct", "top_word", "same_as_last", "line_repeats", "words_per_line",
)


def features(text: str) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    c = dict(zip(CLASSES, byte_classes(raw)))
    n, size = len(words), len(raw)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    return [
        c["upper"] / (c["upper"] + c["lower"] + 1),
        c["digit"] / size,
        c["bang"] / n,
        c["symbol"] / n,
        c["bar"] / n,
        c["point"] / n,
        c["other"] / size,
        c["space"] / size,
        math.log1p(n),
        size / n,
        sum(1 for w in words if len(w) > 12) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
    ]


def feature_matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t or "") for t in texts], float).reshape(len(texts), len(FEATURES))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of ordered bins; place 0 is none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
    gain[(left_h < 1) | (all_h - left_h < 1)] = 0
    if not len(gain) or gain.max() <= 1e-12:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree with at most four leaves."""
    parts = [(0, len(g))]
    for _ in range(2):
        cuts = [(_best_cut(g[a:b], h[a:b])[1], a, b) for a, b in parts]
        parts = [p for k, a, b in cuts for p in (((a, a + k), (a + k, b)) if k else ((a, b),))]
    values = np.zeros(len(g))
    for a, b in parts:
        values[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return values


def _shallow_grid(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts one axis of a grid, then the other in each half."""
    best, values = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for k in range(1, len(a)):
            gain, v = 0.0, np.zeros_like(a)
            for rows in (slice(0, k), slice(k, len(a))):
                gs, hs = a[rows].sum(axis=0), b[rows].sum(axis=0)
                _, cut = _best_cut(gs, hs)
                for cols in (slice(0, cut), slice(cut, len(gs))) if cut else (slice(0, len(gs)),):
                    leaf = gs[cols].sum() / (hs[cols].sum() + 1)
                    gain += gs[cols].sum() * leaf
                    v[rows, cols] = leaf
            if gain > best:
                best, values = gain, v.T if turned else v
    return best, values


class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, intercept: float = 0.0):
        self.intercept, self.edges, self.tables, self.pair_edges, self.pairs = intercept, [], [], [], {}

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.tables:
            bins = self._bins(x, self.edges)
            for j, table in enumerate(self.tables):
                total += table[bins[:, j]]
        if self.pairs:
            coarse = self._bins(x, self.pair_edges)
            for (i, j), table in self.pairs.items():
                total += table[coarse[:, i], coarse[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> "AdditiveModel":
        """held: rows that say where to stop."""
        xt, yt, xv, yv = x[~held], y[~held], x[held], y[held]
        rate = float(np.clip(yt.mean(), 0.01, 0.99))
        model = cls(math.log(rate / (1 - rate)))
        quantiles = lambda n: [np.unique(np.quantile(xt[:, j], np.arange(1, n) / n)) for j in range(x.shape[1])]
        model.edges, model.pair_edges = quantiles(BINS), quantiles(PAIR_BINS)
        model.tables = [np.zeros(len(e) + 1) for e in model.edges]
        bt, bv = cls._bins(xt, model.edges), cls._bins(xv, model.edges)
        ft, fv = np.full(len(xt), model.intercept), np.full(len(xv), model.intercept)

        def gradients() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-ft))
            return yt - p, p * (1 - p)

        def loss() -> float:
            return float(np.logaddexp(0, np.where(yv > 0, -fv, fv)).mean()) if len(yv) else 0.0

        best, kept = loss(), [t.copy() for t in model.tables]
        for _ in range(ROUNDS):
            for j, table in enumerate(model.tables):
                g, h = gradients()
                step = RATE * _shallow_tree(np.bincount(bt[:, j], g, len(table)), np.bincount(bt[:, j], h, len(table)))
                table += step
                ft += step[bt[:, j]]
                fv += step[bv[:, j]]
            if loss() < best or not len(yv):
                best, kept = loss(), [t.copy() for t in model.tables]
        model.tables = kept
        ft, fv = model.raw(xt), model.raw(xv)
        ct, cv = cls._bins(xt, model.pair_edges), cls._bins(xv, model.pair_edges)

        def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
            cell, (g, h) = ct[:, i] * shape[1] + ct[:, j], gradients()
            return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

        gains = sorted(((_shallow_grid(*grid(i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
        model.pairs = {(i, j): np.zeros_like(grid(i, j)[0]) for _, i, j in gains[:PAIRS]}
        best, kept_pairs = loss(), {k: t.copy() for k, t in model.pairs.items()}
        for _ in range(ROUNDS // 5):
            for (i, j), table in model.pairs.items():
                step = RATE * _shallow_grid(*grid(i, j))[1]
                table += step
                ft += step[ct[:, i], ct[:, j]]
                fv += step[cv[:, i], cv[:, j]]
            if loss() < best or not len(yv):
                best, kept_pairs = loss(), {k: t.copy() for k, t in model.pairs.items()}
        model.pairs = kept_pairs
        return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = feature_matrix(batch.column("text").to_pylist())
        ends = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
        yield pa.record_batch([batch.column("label"), batch.column("fold"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["label", "fold", "x"])


def fit(documents: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> AdditiveModel:
    rows = training_rows(documents, labels, "quality", most)
    got = rows.mapInArrow(_featured, "label int, fold int, x array<double>").toArrow()
    y, held = got.column("label").to_numpy().astype(float), got.column("fold").to_numpy() == 3
    if not len(y) or y.min() == y.max() or y[~held].min(initial=1) == y[~held].max(initial=0):
        rate = float(y.mean()) if len(y) else 1.0
        return AdditiveModel(40.0 if rate == 1 else -40.0 if rate == 0 else math.log(rate / (1 - rate)))
    x = np.array(got.column("x").to_pylist(), float)
    order = np.lexsort((*x.T, y, held))
    return AdditiveModel.fit(x[order], y[order], held[order])


def scorer(documents: DataFrame, model: AdditiveModel):
    """A Column of texts -> a Column of scores."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.concatenate([shared.value.score(feature_matrix(list(texts.iloc[k : k + 2048]))) for k in range(0, len(texts), 2048)] or [np.zeros(0)])
        return pd.Series(out)

    return score


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    score = scorer(documents, fit(documents, labels, most))
    scored = documents_of(documents).select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = MAX_ROWS) -> DataFrame:
    """The documents that score at least threshold, with all their columns."""
    score = scorer(documents, fit(documents, labels, most))
    text: Column = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.where(score(text) >= threshold)
