"""Numeric features of whole texts, computed batch by batch inside tasks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = (
    "log_words", "log_bytes", "word_length", "upper", "digit", "symbol", "shout", "stop_marks", "space", "newline",
    "other_bytes", "distinct", "top_word", "repeated_lines", "short_words", "capital_words",
)

SYMBOLS = b"#*$%&|<>~^=+_\\/@{}[]"


def _class(chars: bytes) -> np.ndarray:
    return np.array(sorted(set(chars)), dtype=np.int64)


UPPER = np.arange(65, 91)
LETTERS = np.concatenate([UPPER, np.arange(97, 123)])
DIGITS = np.arange(48, 58)
CLASSES = {"symbol": _class(SYMBOLS), "shout": _class(b"!?"), "stop_marks": _class(b".,;:"), "space": _class(b" \t"), "newline": _class(b"\n\r")}


def word_table(text: str | None) -> Counter:
    """Occurrences of the words between white space."""
    return Counter(text.split()) if text else Counter()


def features(text: str | None, count: Counter | None = None) -> list[float]:
    """Feature values of one text in the order of NAMES; a null or empty text has zeros.

    ``count`` is the text's :func:`word_table`, if the caller has it.
    """
    if not text:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8")
    n = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    count = word_table(text) if count is None else count
    words = sum(count.values())
    lines = [x for x in text.split("\n") if x.strip()]
    total, size = max(words, 1), len(raw)
    letters = max(int(n[LETTERS].sum()), 1)
    return [
        float(np.log1p(words)),
        float(np.log1p(size)),
        sum(len(w) * k for w, k in count.items()) / total,
        n[UPPER].sum() / letters,
        n[DIGITS].sum() / size,
        *(n[CLASSES[c]].sum() / size for c in ("symbol", "shout", "stop_marks", "space", "newline")),
        n[128:].sum() / size,
        len(count) / total,
        max(count.values(), default=0) / total,
        1.0 - len(set(lines)) / max(len(lines), 1),
        sum(k for w, k in count.items() if len(w) <= 3) / total,
        sum(k for w, k in count.items() if w[0].isupper()) / total,
    ]


def matrix(texts: list[str | None], counts: list[Counter] | None = None) -> np.ndarray:
    counts = counts or [None] * len(texts)
    return np.array([features(t, c) for t, c in zip(texts, counts)], dtype=float).reshape(len(texts), len(NAMES))


def with_features(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` (numbers) and ``x``, the feature array, of rows with a text."""

    def computed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({**{k: pdf[k] for k in keep}, "x": list(matrix(pdf["text"].tolist()))})

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + ", x array<double>"
    return rows.select(*keep, F.col("text")).mapInPandas(computed, schema)
