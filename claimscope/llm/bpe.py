"""Operator 3: token counts by heap-and-linked-list byte-pair merging.

A text is cut into the library's pre-token pieces. Within a piece the lowest-ranked
adjacent pair is popped from a heap again and again and merged in a doubly linked list;
the count is the number of initial byte symbols minus the number of merges. No token
ids are formed. Counts of short pieces are remembered per worker, since words repeat.

Pieces never hold a space that follows a non-space and precedes a non-space except as
their first character, so a text may be cut before each such space and the parts
counted on their own. Registered special strings count as one token each, as the
library does by default.
"""

from __future__ import annotations

import heapq
import json
import re as _re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies split text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LIMIT_TOKENS = 512
CACHED_PARTS = 600_000
CACHED_LENGTH = 64
# A single space between two non-spaces; a text with other runs of spaces is cut by this.
SAFE_CUT = regex.compile(r"(?<=\S)(?= \S)")
MARKS = frozenset(".,;:!?")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class TokenCounter:
    """Counts the tokens of texts under one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        self.symbols = byte_symbols()
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = _re.compile("|".join(map(_re.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece: initial symbols minus merges."""
        sym = [self.symbols[b] for b in piece.encode("utf-8")]
        n = len(sym)
        if n < 2:
            return n
        ranks = self.ranks
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or sym[i] != left or sym[j] != right:
                continue  # one of the two has been merged since
            sym[i], sym[j] = left + right, ""
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return n - merges

    def _pieces(self, text: str) -> int:
        return sum(map(self.merged, self.pieces.findall(text)))

    def _word(self, word: str) -> int:
        """Tokens of a word with a space before it; counts of words used lately are kept."""
        n = self.older.get(word)
        if n is None:
            if word[-1] in MARKS and word[:-1].isalpha():
                # Letters and the mark behind them are pieces of their own.
                n = self.known.get(word[:-1])
                n = (self._word(word[:-1]) if n is None else n) + 1
            else:
                n = self._pieces(" " + word)
        if len(word) <= CACHED_LENGTH:
            if len(self.known) >= CACHED_PARTS:
                self.older, self.known = self.known, {}
            self.known[word] = n
        return n

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        first, words = words_of(text)
        counts = list(map(self.known.get, words))
        if None in counts:
            counts = [self._word(w) if n is None else n for w, n in zip(words, counts)]
        return self._pieces(first) + sum(counts)

    def count(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1


def words_of(text: str) -> tuple[str, list[str]]:
    """``text`` cut at each space that stands between two non-spaces.

    Returns what is before the first such space, and the rest, each without its space.
    """
    if "  " in text or text[0] == " " or text[-1] == " ":
        first, *rest = SAFE_CUT.split(text)
        return first, [r[1:] for r in rest]
    first, *rest = text.split(" ")
    return first, rest


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT_TOKENS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens, not over the limit). Rows with a null
    or repeated doc_id are counted one by one. Other columns are ignored; an empty table
    gives an empty result.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(vocabulary)
        for pdf in batches:
            texts = pdf["text"].tolist()
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "n_bytes": pdf["n_bytes"],
                    "n_tokens": [counter.count(t) for t in texts],
                }
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInPandas(counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
