"""Operator 5: language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public sentencepiece
vocabulary. The probability of a word is the sum over all its segmentations into pieces,
found by a forward pass; a text's score in a language is the sum of its words' log
probabilities plus the log prior. Probabilities are learned from the pieces of all
training texts, so what is gathered is (pieces x languages) counts, whatever the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import arrow_rows, free_worker, staged

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. Signs such as ½, ² and ①, which patterns take for letters, end a run."""
    found = LETTERS.findall(text.lower()) if text else []
    if not found or text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


START = "▁"  # fixed value: the vocabulary's mark of a word's first piece
SMOOTHING = 0.1
UNDETERMINED = "und"
CACHED_WORDS = 250_000
#: Texts in one Arrow batch, and distinct words that are counted before their pieces are.
TEXTS, HELD_WORDS = 500, 200_000
BASE = 0x9E3779B97F4A7C15  # multiplier of the rolling hash
SPREAD = 0xD6E8FEB86659FD93  # multiplier that spreads hashes over the table
#: Words below this length are scored together.
TOGETHER = 32
#: What linear scale loses by underflow is below a few thousand times 5e-324, so sums from
#: here on are right to the last digit; smaller ones are formed again in log scale.
SAFE = 1e-280


class Pieces:
    """The vocabulary: piece numbers, and the byte pieces that stand in for unknown characters."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.lib.get_piece_size()
        self.number, self.byte = {}, {}
        for i in range(self.size):
            name = self.lib.id_to_piece(i)
            if self.lib.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
            elif not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i)):
                self.number[name] = i
        self._table()

    def _table(self) -> None:
        """Hash table from the rolling hash of a piece's characters to its number."""
        self.longest = max(map(len, self.number))
        self.mask = (1 << 18) - 1
        self.slot_hash = np.zeros(self.mask + 1, dtype=np.uint64)
        self.slot_piece = np.full(self.mask + 1, -1, dtype=np.int64)
        self.probes = 1
        for name, i in self.number.items():
            h = 0
            for c in name:
                h = (h * BASE + ord(c)) & (2**64 - 1)
            at, n = (h * SPREAD & (2**64 - 1)) >> 46, 1
            while self.slot_piece[at] >= 0:
                assert int(self.slot_hash[at]) != h, "two pieces share a hash"
                at, n = (at + 1) & self.mask, n + 1
            self.slot_hash[at], self.slot_piece[at] = h, i
            self.probes = max(self.probes, n)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 where there is none."""
        at = ((hashes * np.uint64(SPREAD)) >> np.uint64(46)).astype(np.int64)
        out = np.full(hashes.shape, -1, dtype=np.int64)
        for _ in range(self.probes):
            found = self.slot_piece[at]
            np.copyto(out, found, where=self.slot_hash[at] == hashes)
            at = (at + 1) & self.mask
        return out


def count_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(lang, piece, n) over the words of all texts with a language."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free_worker()
        pieces, counts, held = Pieces(vocabulary), {}, {}

        def add(lang: str, words: Counter) -> None:
            total = counts.setdefault(lang, np.zeros(pieces.size))
            distinct = list(words)
            for k in range(0, len(distinct), 5000):
                part = distinct[k : k + 5000]
                ids = pieces.lib.encode(part, num_threads=1)
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int64)
                np.add.at(total, flat, np.repeat([words[w] for w in part], [len(x) for x in ids]))

        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                words = held.setdefault(lang, Counter())
                for t in texts:
                    words.update(words_of(t))
            if sum(map(len, held.values())) > HELD_WORDS:
                for lang, words in held.items():
                    add(lang, words)
                held = {}
        for lang, words in held.items():
            add(lang, words)
        for lang, total in counts.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "piece": used, "n": total[used]})

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return rows.mapInPandas(counted, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # pieces x languages
    prior: np.ndarray


def fit(docs: DataFrame, vocabulary: str, allowed: Column, smoothing: float = SMOOTHING) -> Model:
    """Learn from all rows that ``allowed`` selects and whose lang is not null."""
    train = docs.where(allowed)
    size = Pieces(vocabulary).size
    # At most (languages x vocabulary) rows, whatever the number of documents.
    with arrow_rows(docs.sparkSession, TEXTS):
        counts = count_pieces(train, vocabulary).toPandas()
    languages = sorted(counts["lang"].unique())
    n = np.zeros((size, len(languages)))
    n[counts["piece"].to_numpy(), counts["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(dtype=int)] = counts["n"]
    logp = np.log(n + smoothing) - np.log(n.sum(axis=0) + smoothing * size)
    rows = train.where(F.col("lang").isNotNull()).groupBy("lang").count().toPandas().set_index("lang")["count"]
    prior = np.log(np.array([rows[x] for x in languages], dtype=float) / max(rows.sum(), 1))
    return Model(languages, logp, prior)


class WordScorer:
    """Log probability of words in every language, summed over all segmentations."""

    def __init__(self, vocabulary: str, model: Model):
        self.pieces, self.model = Pieces(vocabulary), model
        self.width = len(model.languages)
        # The last row, also reached by -1, stands for "no such piece".
        self.p = np.vstack([np.exp(model.logp), np.zeros((1, self.width))])
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, self.width))

    def unknown(self, char: str) -> np.ndarray:
        """Log probability of a character outside the vocabulary: that of its byte pieces."""
        return sum(self.model.logp[self.pieces.byte[b]] for b in char.encode("utf-8"))

    def one(self, word: str) -> np.ndarray:
        """Forward pass over one word in log scale (any length)."""
        text, number = START + word, self.pieces.number
        n = len(text)
        alpha = np.full((n + 1, self.width), -np.inf)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            terms = []
            for i in range(max(0, j - self.pieces.longest), j):
                piece = number.get(text[i:j])
                if piece is not None:
                    terms.append(alpha[i] + self.model.logp[piece])
                elif i == j - 1:
                    terms.append(alpha[i] + self.unknown(text[i]))
            top = np.max(terms, axis=0)
            alpha[j] = top + np.log(np.exp(np.array(terms) - top).sum(axis=0))
        return alpha[n]

    def many(self, words: list[str]) -> np.ndarray:
        """Forward pass over words of one length side by side.

        In linear scale first; words that get too small there in any language, such as
        those of several characters outside the vocabulary, go through log scale.
        """
        n = len(words[0]) + 1
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), dtype=np.uint32)
        codes = codes.reshape(len(words), n).astype(np.uint64)
        longest = min(n, self.pieces.longest)
        p, piece, hashes = self.p, [], np.zeros((len(words), n), dtype=np.uint64)
        for k in range(longest):
            hashes = hashes[:, : n - k] * np.uint64(BASE) + codes[:, k:]
            piece.append(self.pieces.lookup(hashes))
        missing = piece[0] < 0
        if missing.any():  # characters outside the vocabulary get rows of their own
            chars, which = np.unique(codes[missing], return_inverse=True)
            piece[0][missing] = len(p) - 1 + which
            p = np.vstack([p[:-1], *(np.exp(self.unknown(chr(int(c))))[None] for c in chars), p[-1:]])
        alpha = np.zeros((n + 1, len(words), self.width))
        alpha[0] = 1.0
        for end in range(1, n + 1):
            for k in range(min(end, longest)):
                alpha[end] += alpha[end - k - 1] * p[piece[k][:, end - k - 1]]
        small = (alpha[n] < SAFE).any(axis=1)
        out = np.empty((len(words), self.width))
        out[~small] = np.log(alpha[n][~small])
        if small.any():
            with np.errstate(divide="ignore"):  # the row of "no such piece" becomes -inf
                out[small] = self.logs([x[small] for x in piece], np.log(p))
        return out

    def logs(self, piece: list[np.ndarray], logp: np.ndarray) -> np.ndarray:
        """The forward pass of :meth:`many` in log scale, where nothing underflows."""
        words, n = piece[0].shape
        alpha = np.zeros((n + 1, words, self.width))
        for end in range(1, n + 1):
            terms = np.stack([alpha[end - k - 1] + logp[piece[k][:, end - k - 1]] for k in range(min(end, len(piece)))])
            # Finite: each character is a piece or has a row of its own.
            top = terms.max(axis=0)
            alpha[end] = top + np.log(np.exp(terms - top).sum(axis=0))
        return alpha[n]

    def learn(self, words: list[str]) -> None:
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        new = [self.scores]
        at = len(self.scores)
        for length, group in by.items():
            for k in range(0, len(group), 4000):
                part = group[k : k + 4000]
                new.append(self.many(part) if length < TOGETHER else np.array([self.one(w) for w in part]))
                self.row.update(zip(part, range(at, at + len(part))))
                at += len(part)
        self.scores = np.concatenate(new)

    def texts(self, counts: list[Counter]) -> np.ndarray:
        """Sum of word scores, one row per text."""
        if len(self.row) > CACHED_WORDS:
            self.row, self.scores = {}, self.scores[:0]
        self.learn(list({w for c in counts for w in c if w not in self.row}))
        out = np.zeros((len(counts), self.width))
        filled = np.flatnonzero([len(c) for c in counts])
        if len(filled):
            rows = np.fromiter((self.row[w] for c in counts for w in c), dtype=np.int64)
            n = np.fromiter((k for c in counts for k in c.values()), dtype=float)
            first = np.concatenate([[0], np.cumsum([len(counts[i]) for i in filled])[:-1]])
            out[filled] = np.add.reduceat(self.scores[rows] * n[:, None], first, axis=0)
        return out


def identify(docs: DataFrame, vocabulary: str, model: Model) -> DataFrame:
    """(doc_id, text_hash, lang_pred, score), one row per row of ``docs``; ``score`` is the posterior.

    A null text, and one without a letter, is ``und`` with score 0; so is every text when
    nothing was learned. Equal scores go to the language that comes first. Other columns
    are ignored; an empty table gives an empty result. The verdicts are written here, while
    workers get few texts at a time.
    """
    # Plain arrays: at most (languages x vocabulary) numbers.
    handle = docs.sparkSession.sparkContext.broadcast((model.languages, model.logp, model.prior))

    def identified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free_worker()
        known = Model(*handle.value)
        scorer = WordScorer(vocabulary, known)
        for pdf in batches:
            counts = [Counter(words_of(t)) for t in pdf["text"]]
            pred, score = [UNDETERMINED] * len(pdf), np.zeros(len(pdf))
            if known.languages:
                total = scorer.texts(counts) + known.prior
                total -= total.max(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                post = 1.0 / np.exp(total).sum(axis=1)
                for i, c in enumerate(counts):
                    if c:
                        pred[i], score[i] = known.languages[best[i]], post[i]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text_hash": pdf["text_hash"], "lang_pred": pred, "score": score})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    with arrow_rows(docs.sparkSession, TEXTS):
        return staged(rows.mapInPandas(identified, "doc_id long, text_hash long, lang_pred string, score double"), "languages")
