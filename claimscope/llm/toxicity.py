"""Operator 7: toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are words and word beginnings (crude stems). A term weighs its idf times
``1 - MIN_CHI2 / chi2`` of its association with the label in the sample, so what barely goes
along with the label weighs little and what does not weighs nothing; a text is its L2-normed
vector of ``(1 + ln tf) * weight``. Distinct example vectors lie in blocks, and for each term
and block the index holds the largest weight. A text's blocks are visited from the
largest upper bound down until no block can reach the k-th best cosine, so the
neighbours are exact. Votes are weighted by distance and calibrated on sample rows that
are not in the index; the neighbours themselves are returned as evidence.

The sample has a documented bound (``SAMPLE``), which bounds the terms as well; every
document is scored on its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import labelled_sample, sample_rows, staged

SAMPLE = 20_000
THRESHOLD = 0.7
#: A term of fewer sample rows says nothing yet, however they are labelled; in large samples,
#: where more terms are tried, the rows grow with the square root of the sample.
MIN_ROWS, ROWS_PER_ROOT, MIN_CHI2 = 8, 0.156, 10.8
NEIGHBOURS, BLOCK, NEAR = 15, 64, 0.05
STEMS, HEAD = (5, 6, 7, 8), 5
WORD = re.compile(r"[^\W\d_]+")
CACHED_WORDS, CACHED_VECTORS = 100_000, 20_000
#: Queries that the index answers at a time.
QUERIES = 512


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def word_counts(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def term_counts(text: str | None) -> Counter:
    out = Counter()
    for w, n in word_counts(text).items():
        for t in terms_of(w):
            out[t] += n
    return out


class Vectors:
    """TF-IDF vectors of texts over a fixed vocabulary."""

    def __init__(self, idf: dict[str, float]):
        self.number = {t: i for i, t in enumerate(idf)}
        self.idf = np.array(list(idf.values()), dtype=float)
        # Most words share no beginning with any term; only those that do are looked up and remembered.
        self.heads = {t[:HEAD] for t in idf}
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, word: str) -> tuple[int, ...]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        found = self.known[word] = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        return found

    def hits(self, text: str | None) -> list[tuple[int, ...]]:
        """For each word of the text that has known terms, in order, their numbers."""
        heads, known, out = self.heads, self.known, []
        for w in WORD.findall(text.lower()) if text else ():
            if w[:HEAD] in heads:
                found = known.get(w)
                if found is None:
                    found = self._learn(w)
                if found:
                    out.append(found)
        return out

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(ascending term numbers, weights) with norm 1; empty if no term is known."""
        tf = Counter(chain.from_iterable(self.hits(text)))
        t = np.array(sorted(tf), dtype=np.int64)
        w = (1.0 + np.log([tf[i] for i in t])) * self.idf[t] if len(t) else np.zeros(0)
        return t, w / np.sqrt((w**2).sum()) if len(t) else w


class BlockMaxIndex:
    """Exact top-k cosine over example vectors, skipping blocks by their upper bounds.

    A block keeps the postings of its own terms as a small matrix (terms x examples), and the
    index the largest weight of each term in each block. Queries are answered many at a time:
    the bounds of all blocks are one product, the two blocks of largest bound give each query
    a cosine that its k-th best cannot be below, and only blocks that can reach it are scored.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        # Examples with like leading terms lie together, so that block bounds are tight.
        leading = [tuple(t[np.argsort(-w, kind="stable")[:4]].tolist()) for t, w in vectors]
        self.order = sorted(range(len(vectors)), key=lambda i: (leading[i], i))
        self.terms, self.size = terms, len(vectors)
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        self.top = np.zeros((terms, -(-len(vectors) // BLOCK)))
        for b in range(self.top.shape[1]):
            some = [vectors[i] for i in self.order[b * BLOCK : (b + 1) * BLOCK]]
            own = np.unique(np.concatenate([t for t, _ in some]))
            post = np.zeros((len(own), len(some)))
            for k, (t, w) in enumerate(some):
                post[np.searchsorted(own, t), k] = w
            self.blocks.append((own, post))
            self.top[own, b] = post.max(axis=1)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the k nearest with a positive cosine, ties by place."""
        return next(self.nearest_many([(terms, weights)], k))

    def nearest_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`nearest` of each query."""
        for at in range(0, len(queries), QUERIES):
            yield from self._nearest(queries[at : at + QUERIES], k)

    def _nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        dense = np.zeros((len(queries), self.terms))
        for i, (t, w) in enumerate(queries):
            inside = t < self.terms
            dense[i, t[inside]] = w[inside]
        bound = dense @ self.top
        done = bound <= 0
        least = np.zeros(len(queries))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(b: int, rows: np.ndarray) -> np.ndarray:
            own, post = self.blocks[b]
            done[rows, b] = True
            # Rounding must not order equal cosines, so they are compared to twelve places.
            return np.round(dense[np.ix_(rows, own)] @ post, 12)

        def keep(b: int, rows: np.ndarray, cos: np.ndarray) -> None:
            i, j = np.nonzero((cos >= least[rows, None]) & (cos > 0))
            found.append((rows[i], b * BLOCK + j, cos[i, j]))

        first = np.argsort(-bound, axis=1, kind="stable")[:, :2]
        seen = np.zeros((len(queries), first.shape[1] * BLOCK))
        opened = []
        for b in np.unique(first):
            rows = np.flatnonzero((first == b).any(axis=1) & ~done[:, b])
            cos = visit(b, rows)
            side = (first[rows] == b).argmax(axis=1) * BLOCK
            seen[rows[:, None], side[:, None] + np.arange(cos.shape[1])] = cos
            opened.append((b, rows, cos))
        if seen.shape[1] >= k:
            least = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k]
        for b, rows, cos in opened:
            keep(b, rows, cos)
        for b in range(len(self.blocks)):
            rows = np.flatnonzero(~done[:, b] & (bound[:, b] >= least - 1e-9))
            if len(rows):
                keep(b, rows, visit(b, rows))
        who, place, cos = (np.concatenate([x[c] for x in found] or [np.zeros(0, dtype=np.int64)]) for c in range(3))
        order = np.lexsort((place, -cos, who))
        edges = np.searchsorted(who[order], np.arange(len(queries) + 1))
        for low, high in zip(edges[:-1], edges[1:]):
            best = order[low : min(high, low + k)]
            yield np.array([self.order[p] for p in place[best]], dtype=np.int64), cos[best]


@dataclass
class Model:
    """Vocabulary, distinct example vectors with their votes, and calibration."""

    idf: dict[str, float]
    vectors: list[tuple[np.ndarray, np.ndarray]]
    rows: np.ndarray  # examples with this vector
    share: np.ndarray  # share of them that carry the label
    example: np.ndarray  # least doc_id of them
    base: float  # share of the label among texts without neighbours
    slope: float = 1.0
    shift: float = 0.0

    def index(self) -> BlockMaxIndex:
        return BlockMaxIndex(self.vectors, len(self.idf))

    def votes(self, index: BlockMaxIndex, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS):
        """For each vector: share of the weighted votes for the label or None, neighbours, cosines."""
        for who, cos in index.nearest_many(vectors, k):
            if not len(who):
                yield None, who, cos
                continue
            weight = (1.0 + np.log(self.rows[who])) / (1.0 - np.minimum(cos, 1.0) + NEAR)
            yield float((weight * self.share[who]).sum() / weight.sum()), who, cos

    def calibrated(self, vote: float | None) -> float:
        if vote is None:
            return self.base
        return float(1.0 / (1.0 + np.exp(-(self.slope * spread(vote) + self.shift))))


def spread(vote: float) -> float:
    v = min(max(vote, 0.005), 0.995)
    return float(np.log(v / (1.0 - v)))


def fit_platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (z, y) by damped Newton steps."""
    x = np.column_stack([z, np.ones(len(z))])
    beta = np.array([1.0, 0.0])
    prior = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + (beta - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return float(beta[0]), float(beta[1])


def vocabulary(rows: DataFrame) -> tuple[dict[str, float], float]:
    """(weight of the terms that go along with the label, share of the label) over rows (text, label).

    Document frequencies come from a distributed aggregate.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "terms": [list(term_counts(t)) for t in pdf["text"]]})

    known = staged(rows.select("label", "text").mapInPandas(counted, "label int, terms array<string>"), "sample-terms")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    n, share = size["n"], (size["pos"] + 0.5) / (size["n"] + 1.0)
    df = known.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    over = F.col("pos") - F.col("n") * share
    chi2 = over * over / (F.col("n") * share * (1 - share) * (1.0 - F.col("n") / (n + 1.0)))
    rows_needed = max(MIN_ROWS, ROWS_PER_ROOT * float(np.sqrt(n)))
    chosen = df.where((F.col("n") >= rows_needed) & (over > 0)).withColumn("chi2", chi2).where(F.col("chi2") > MIN_CHI2)
    chosen = chosen.toPandas().sort_values("term")
    weight = np.log(1.0 + n / chosen["n"]) * (1.0 - MIN_CHI2 / chosen["chi2"])
    return dict(zip(chosen["term"], weight)), share


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled ids that ``allowed`` (on labels) selects, by hash order."""
    picked = labelled_sample(labels, label, allowed, sample)
    rows = staged(sample_rows(docs, picked), "sample")
    idf, share = vocabulary(rows)

    def vectored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = Vectors(idf)
        for pdf in batches:
            v = [vectors.of(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "t": [x[0] for x in v], "w": [x[1] for x in v]})

    found = rows.mapInPandas(vectored, "doc_id long, label int, t array<long>, w array<double>").toPandas()
    return build(idf, found.sort_values("doc_id", kind="stable"), share)


def build(idf: dict[str, float], sample: pd.DataFrame, share: float) -> Model:
    """Group equal vectors, index three quarters of the rows and calibrate on the fourth."""
    sample = sample.reset_index(drop=True)
    aside = (sample.index % 4 == 3) & (len(sample) >= 40)
    none = sample["t"].map(len) == 0
    held = sample[none]["label"]
    base = float((held.sum() + share) / (len(held) + 1.0))

    def model(rows: pd.DataFrame) -> Model:
        groups: dict[tuple, list] = {}
        for t, w, y, d in zip(rows["t"], rows["w"], rows["label"], rows["doc_id"]):
            groups.setdefault((tuple(t), tuple(np.round(w, 9))), [np.asarray(t, dtype=np.int64), np.asarray(w, dtype=float), 0, 0, d])
            entry = groups[(tuple(t), tuple(np.round(w, 9)))]
            entry[2] += 1
            entry[3] += int(y)
            entry[4] = min(entry[4], d)
        g = list(groups.values())
        count = np.array([x[2] for x in g], dtype=float)
        hit = np.array([x[3] for x in g], dtype=float)
        # Few rows say little: a vector's share leans a little to the overall share.
        return Model(idf, [(x[0], x[1]) for x in g], count, (hit + 0.1 * share) / (count + 0.1) if len(g) else hit, np.array([x[4] for x in g], dtype=np.int64), base)

    part = model(sample[~aside & ~none])
    index = part.index()
    left = sample[aside & ~none]
    asked = [(np.asarray(t, dtype=np.int64), np.asarray(w, dtype=float)) for t, w in zip(left["t"], left["w"])]
    votes = [(spread(v), y) for (v, _, _), y in zip(part.votes(index, asked), left["label"]) if v is not None]
    whole = model(sample[~none])
    if votes:
        whole.slope, whole.shift = fit_platt(np.array([v for v, _ in votes]), np.array([y for _, y in votes], dtype=float))
    return whole


EVIDENCE = "array<struct<doc_id:bigint,cosine:double,share:double>>"


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, evidence: int = 3) -> DataFrame:
    """(doc_id, score, predicted, evidence), one row per row of ``docs``.

    ``evidence`` lists the nearest example vectors: an example's doc_id, the cosine, and
    the share of examples with that vector that carry the label. A null or empty text, and
    one without known terms, gets the sample's share among such texts and no evidence.
    Rows with a null or repeated doc_id are scored one by one. Other columns are ignored;
    an empty table gives no rows.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, index = Vectors(model.idf), model.index()
        known: dict[tuple, tuple] = {}
        for pdf in batches:
            if len(known) > CACHED_VECTORS:
                known.clear()
            found = [vectors.of(text) for text in pdf["text"]]
            keys = [(t.tobytes(), w.tobytes()) for t, w in found]
            fresh = {key: v for key, v in zip(keys, found) if key not in known}
            for key, (vote, who, cos) in zip(fresh, model.votes(index, list(fresh.values()))):
                near = [{"doc_id": int(model.example[i]), "cosine": float(c), "share": float(model.share[i])} for i, c in zip(who[:evidence], cos)]
                known[key] = (model.calibrated(vote), near)
            out, proof = zip(*(known[key] for key in keys)) if keys else ((), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": out, "evidence": list(proof)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInPandas(scored, f"doc_id long, score double, evidence {EVIDENCE}")
    return found.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
