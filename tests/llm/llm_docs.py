"""Fixture of the training-data tests."""

from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) tuples, with columns that clash with results."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENTS)
        for name in ("score", "predicted", "copies", "rate", "tokens", "node", "key", "label", "ws", "refs", "start", "part"):
            frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame

    return make
