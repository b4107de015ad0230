"""Operator 1: quality score by a generalised additive model with pairwise interactions.

Features are cut into quantile bins. Shallow trees are boosted on one feature after the
other, round and round, each adding its leaf values to that feature's lookup table; then
the pairs of features that explain most of what is left get two-dimensional tables in
the same way. A score is the sum of the looked-up values through a logistic function, so
scoring a batch is a handful of vectorised additions.

The model is fitted on at most ``SAMPLE`` labelled rows (a bounded numeric matrix); all
documents are scored in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm import textstats
from claimscope.llm.common import labelled_sample, sample_rows

SAMPLE = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, RATE, RIDGE = 150, 0.1, 2.0


@dataclass
class Additive:
    """Lookup tables: one per feature, one per chosen pair."""

    base: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        cut = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for f in {f for p in self.pairs for f in p}}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[cut[i], cut[j]]
        return logistic(total)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, place) of the best split of ordered bins; place 0 means no split."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g), np.cumsum(h)
    left, lh, right, rh = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
    gain = left**2 / (lh + RIDGE) + right**2 / (rh + RIDGE) - cg[-1] ** 2 / (ch[-1] + RIDGE)
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + RIDGE))


def line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of depth two over one feature's bins."""
    out = np.zeros(len(g))
    _, mid = best_cut(g, h)
    for a, b in ((0, mid), (mid, len(g))) if mid else ((0, len(g)),):
        _, cut = best_cut(g[a:b], h[a:b])
        for c, d in ((a, a + cut), (a + cut, b)) if cut else ((a, b),):
            out[c:d] = leaf(g[c:d], h[c:d])
    return out


def plane_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per cell of a tree that splits one feature, then the other on either side."""
    options = []
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        out = np.zeros(gg.shape)
        gain, cut = best_cut(gg.sum(axis=1), hh.sum(axis=1))
        for a, b in ((0, cut), (cut, len(gg))) if cut else ((0, len(gg)),):
            part, side = gg[a:b].sum(axis=0), hh[a:b].sum(axis=0)
            more, at = best_cut(part, side)
            gain += more
            for c, d in ((0, at), (at, len(part))) if at else ((0, len(part)),):
                out[a:b, c:d] = leaf(part[c:d], side[c:d])
        options.append((gain, out.T if flip else out))
    return max(options, key=lambda o: o[0])[1]


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Additive:
    """Boost lookup tables for 0/1 labels. Without labels of both kinds the score is constant."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1.0 - share)))
    edges = [quantile_edges(x[:, f], BINS) for f in range(width)]
    coarse = [quantile_edges(x[:, f], PAIR_BINS) for f in range(width)]
    model = Additive(base, edges, coarse, [np.zeros(len(e) + 1) for e in edges])
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(width)]
    total = np.full(n, base)
    for _ in range(rounds):
        for f in range(width):
            p = logistic(total)
            size = len(model.tables[f])
            step = RATE * line_tree(np.bincount(bins[f], y - p, size), np.bincount(bins[f], p * (1 - p), size))
            model.tables[f] += step
            total += step[bins[f]]
    wide = [len(c) + 1 for c in coarse]
    cut = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(width)]

    def cells(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cut[i] * wide[j] + cut[j], v, wide[i] * wide[j]).reshape(wide[i], wide[j])

    p = logistic(total)
    g, h = y - p, p * (1 - p)
    gains = {(i, j): float((cells(i, j, g) ** 2 / (cells(i, j, h) + RIDGE)).sum()) for i, j in combinations(range(width), 2)}
    model.pairs = sorted(gains, key=gains.get, reverse=True)[:pairs]
    model.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    for _ in range(rounds // 3):
        for k, (i, j) in enumerate(model.pairs):
            p = logistic(total)
            step = RATE * plane_tree(cells(i, j, y - p), cells(i, j, p * (1 - p)))
            model.pair_tables[k] += step
            total += step[cut[i], cut[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, sample: int = SAMPLE) -> Additive:
    """Fit on at most ``sample`` labelled ids that ``allowed`` (on labels) selects, by hash order."""
    picked = labelled_sample(labels, label, allowed, sample)
    known = textstats.with_features(sample_rows(docs, picked), "doc_id", "label").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(known["x"].tolist(), dtype=float).reshape(len(known), len(textstats.NAMES))
    return fit_additive(x, known["label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted), one row per row of ``docs``.

    A null or empty text is scored by its all-zero features. Rows with a null or repeated
    doc_id are scored one by one. Other columns are ignored; an empty table gives no rows.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = model.score(textstats.matrix(pdf["text"].tolist()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": s})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInPandas(scored, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
