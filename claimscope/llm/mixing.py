"""Operator 9: soft-membership mixing of sources to target weights.

A classifier learned from the labelled table gives each document posteriors over domains
(the combinations of the labels). Nonnegative document rates are then fitted so that the
expected domain token totals, the sum over documents of rate x tokens x posterior, match
the targets in least squares. Each projected-gradient step is one distributed aggregate:
it sums the domain totals at the current rates, and only that short vector reaches the
driver. A document's rate follows from its own posteriors and the sequence of these
vectors, so no per-document state moves between steps.

Steps carry momentum and are measured in tokens (a long and a short document with equal posteriors get equal
rates) and residuals are whitened by the domains' Gram matrix, with which a step of
length one needs no line search.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm import quality, textstats, toxicity
from claimscope.llm.common import arrow_rows, sample_rows, staged

SAMPLE = 20_000
LABELS = ("quality", "toxic")
#: Target share of the tokens of each domain (one value per label, in order), and the
#: tokens to give out as a multiple of those there are.
TARGETS = {"1,0": 0.85, "0,0": 0.10, "1,1": 0.04, "0,1": 0.01}
BUDGET = 1.2
STEPS, TOLERANCE = 30, 1e-3
#: Word tables that a worker holds at a time, and texts in one Arrow batch.
TABLES, TEXTS = 256, 1_000


@dataclass
class Classifier:
    domains: list[str]
    lexicons: list[dict[str, float]]
    models: list[quality.Additive]


def inputs(texts: list[str | None], lexicons: list[toxicity.Vectors], counts: list[Counter]) -> np.ndarray:
    """Text features, and for each label how often its telling terms occur."""
    x = [textstats.matrix(texts, counts)]
    for lex in lexicons:
        found = np.array([len(lex.hits(t)) for t in texts], dtype=float)
        size = np.array([len(t or "") for t in texts])
        x.append(np.column_stack([np.log1p(found), found / (1.0 + size / 6.0)]))
    return np.concatenate(x, axis=1)


def judged(texts: list[str | None], lexicons: list[toxicity.Vectors]) -> tuple[np.ndarray, np.ndarray]:
    """(words, inputs) of each text; few word tables are held at a time."""
    tokens, x = [np.zeros(0, dtype=np.int64)], [np.zeros((0, len(textstats.NAMES) + 2 * len(lexicons)))]
    for k in range(0, len(texts), TABLES):
        part = texts[k : k + TABLES]
        counts = [textstats.word_table(t) for t in part]
        tokens.append(np.array([sum(n.values()) for n in counts], dtype=np.int64))
        x.append(inputs(part, lexicons, counts))
    return np.concatenate(tokens), np.concatenate(x)


def labelled(labels: DataFrame, names: tuple[str, ...], sample: int) -> DataFrame:
    """At most ``sample`` ids by hash order with their domain; rows with a null label are left out."""
    whole = F.col("doc_id").isNotNull()
    for c in names:
        whole = whole & F.col(c).isNotNull()
    domain = F.concat_ws(",", *(F.col(c).cast("int").cast("string") for c in names))
    rows = labels.where(whole).groupBy("doc_id").agg(F.max(domain).alias("domain"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit_classifier(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = LABELS, sample: int = SAMPLE) -> Classifier:
    """One-against-rest additive models over text features, on at most ``sample`` labelled rows."""
    rows = staged(sample_rows(docs, labelled(labels, names, sample)), "sample")
    # A lexicon for the last label: the terms that go along with it.
    last = (F.element_at(F.split("domain", ","), -1).cast("int") > 0).cast("int")
    lexicons = [toxicity.vocabulary(rows.select("text", last.alias("label")))[0]]

    def computed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = [toxicity.Vectors(x) for x in lexicons]
        for pdf in batches:
            _, x = judged(pdf["text"].tolist(), lex)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "domain": pdf["domain"], "x": list(x)})

    known = rows.select("doc_id", "domain", "text").mapInPandas(computed, "doc_id long, domain string, x array<double>")
    known = known.toPandas().sort_values("doc_id", kind="stable")
    domains = sorted(known["domain"].unique())
    if not domains:
        return Classifier([], [], [])
    x = np.array(known["x"].tolist(), dtype=float).reshape(len(known), -1)
    models = [quality.fit_additive(x, (known["domain"] == d).to_numpy(dtype=float), rounds=60, pairs=4) for d in domains]
    return Classifier(domains, lexicons, models)


def posterior_batch(c: Classifier, texts: list[str | None], lex: list[toxicity.Vectors]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, posteriors) of each text. Tokens are counted as words between white space."""
    tokens, x = judged(texts, lex)
    p = np.column_stack([m.score(x) for m in c.models])
    return tokens, p / p.sum(axis=1, keepdims=True)


def with_posteriors(docs: DataFrame, c: Classifier, name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` (tokens, p0, p1, ... in domain order); the text is read once."""
    names = [f"p{k}" for k in range(len(c.domains))]

    @F.pandas_udf("tokens long, " + ", ".join(f"{n} double" for n in names))
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lex = [toxicity.Vectors(x) for x in c.lexicons]
        for texts in batches:
            tokens, p = posterior_batch(c, texts.tolist(), lex)
            out = pd.DataFrame(p, columns=names)
            out.insert(0, "tokens", tokens)
            yield out

    return docs.withColumn(name, told("text"))


def rates(p: np.ndarray, pulls: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents with posteriors ``p`` after the given steps, from one on, never below zero.

    Returns the rates and the point ahead of them (Nesterov's momentum) at which the next
    step takes its gradient.
    """
    r = ahead = np.ones(len(p))
    for k, pull in enumerate(pulls):
        before, r = r, np.maximum(0.0, ahead - p @ pull)
        ahead = r + k / (k + 3.0) * (r - before)
    return r, ahead


@dataclass
class Mix:
    domains: list[str]
    targets: np.ndarray
    reached: np.ndarray
    pulls: list[np.ndarray]


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], budget: float, steps: int = STEPS, tolerance: float = TOLERANCE) -> Mix:
    """Projected-gradient least squares over rows (tokens, p0, ...).

    Domains without a target get none of the tokens; targets of domains that were not
    learned are spread over the others. Stops when all domain totals are within
    ``tolerance`` of all tokens of their targets, or have moved by less than a tenth of
    that three times running, or after ``steps``.
    """
    k = len(domains)
    names = [f"p{i}" for i in range(k)]
    if not k:
        return Mix([], np.zeros(0), np.zeros(0), [])
    t = F.col("tokens").cast("double")
    gram = rows.agg(*(F.coalesce(F.sum(t * F.col(names[i]) * F.col(names[j])), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)))
    first = gram.first()
    g = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    total = g.sum()
    if total <= 0:
        return Mix(domains, np.zeros(k), np.zeros(k), [])
    want = np.array([targets.get(d, 0.0) for d in domains])
    want = budget * total * want / want.sum() if want.sum() > 0 else g.sum(axis=1)
    white = np.linalg.inv(g + np.eye(k) * total * 1e-6)

    def totals(pulls: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(2 * k)
            for pdf in batches:
                p, n = pdf[names].to_numpy(), pdf["tokens"].to_numpy()
                out += np.concatenate([(r * n) @ p for r in rates(p, pulls)])
            yield pd.DataFrame([out], columns=both)

        both = names + [f"a{i}" for i in range(k)]
        parts = rows.select("tokens", *names).mapInPandas(summed, ", ".join(f"{n} double" for n in both))
        found = np.array(parts.agg(*(F.sum(n) for n in both)).first(), dtype=float)
        return found[:k], found[k:]

    pulls: list[np.ndarray] = []
    reached = ahead = g.sum(axis=1)
    still = 0
    for _ in range(steps):
        pulls.append(white @ (ahead - want))
        before = reached
        reached, ahead = totals(pulls)
        still = still + 1 if np.abs(reached - before).max() <= 0.1 * tolerance * total else 0
        if np.abs(reached - want).max() <= tolerance * total or still == 3:
            break
    return Mix(domains, want, reached, pulls)


def copies(rate: Column, at: Column) -> Column:
    """Whole copies of a row: the rate rounded up or down by a hash of the row."""
    share = F.pmod(at, F.lit(1 << 20)) / float(1 << 20)
    return (F.floor(rate) + (share < rate - F.floor(rate)).cast("int")).cast("int")


def rated(p: list[Column], pulls: list[np.ndarray]) -> Column:
    """The rate of rows with posteriors ``p``.

    Declared as not deterministic, so that a filter on it is not moved in front of its column:
    it would be computed twice, by two more Python workers an executor.
    """

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(rates(columns.to_numpy(), pulls)[0])

    return rate.asNondeterministic()(F.struct(*p))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> tuple[DataFrame, Classifier, Mix]:
    """((doc_id, tokens, p0, ..., rate, copies), classifier, fit), one row per row of ``docs``.

    A null or empty text has no tokens: it weighs nothing, and its rate follows from its
    posteriors like any other. If there are no labelled rows all rates are one. Repeated
    rows have equal rates and copies. Other columns are ignored; an empty table gives no
    rows.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("at"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    c = fit_classifier(docs, labels)
    if not c.domains:
        plain = rows.select("doc_id", F.lit(0).cast("long").alias("tokens"))
        return plain.withColumns({"rate": F.lit(1.0), "copies": F.lit(1)}), c, Mix([], np.zeros(0), np.zeros(0), [])
    with arrow_rows(docs.sparkSession, TEXTS):
        told = staged(with_posteriors(rows, c, "told").select("at", "doc_id", "told.*"), "posteriors")
    mix = fit_rates(told, c.domains, targets, budget)
    names = [f"p{i}" for i in range(len(c.domains))]
    out = told.withColumn("rate", rated([F.col(n) for n in names], mix.pulls))
    return out.withColumn("copies", copies(F.col("rate"), F.col("at"))).drop("at"), c, mix


def resampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs``, with all columns, each as often as its copies say.

    The documents are written once with their posteriors beside them, so that their texts
    are not judged again when the rates are known.
    """
    c = fit_classifier(docs, labels)
    if not c.domains:
        return docs
    told = "__mix"
    while told in docs.columns:
        told += "_"
    with arrow_rows(docs.sparkSession, TEXTS):
        rows = staged(with_posteriors(docs, c, told), "mixed-docs")
    mix = fit_rates(rows.select(f"{told}.*"), c.domains, targets, budget)
    p = [rows[told][f"p{i}"] for i in range(len(c.domains))]
    often = copies(rated(p, mix.pulls), F.xxhash64("doc_id", "text"))
    columns = [rows[x] for x in docs.columns]
    spread = rows.select(*columns, often.alias(told)).where(F.col(told) > 0).select("*", F.explode(F.sequence(F.lit(1), F.col(told))))
    return spread.select(*(spread[x] for x in docs.columns))
