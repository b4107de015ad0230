"""Operator 6: chat formatting with offset-aligned loss masks.

A conversation is rendered as one string,

    <|im_start|>role<|im_sep|>text<|im_end|>\\n

for each turn, and encoded once with character offsets. The spans of the assistant texts
and the token spans are both sorted, so each turn finds its tokens by binary search; a
token is under the loss if it overlaps an assistant text. The control strings are tokens
of their own (ids after the vocabulary's), so no token holds a piece of the template and a
piece of a text: what is under the loss is the assistant texts and nothing else.

Control strings inside roles and texts are escaped reversibly: a backslash becomes two,
and ``<|`` gets a backslash between its characters, so that ``<|`` occurs in the rendering
only where the template puts it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import one_thread_per_task

TURN_START, ROLE_END, TURN_END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Characters that are encoded at a time; a longer conversation goes by itself.
LETTERS = 200_000
SCHEMA = (
    "conv_id long, formatted string, ids array<int>, starts array<int>, stops array<int>, loss array<boolean>, "
    "spans array<struct<start:int,stop:int>>"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def encoder(vocabulary: str):
    """The library's tokenizer with the template's control strings as tokens of their own."""
    from tokenizers import AddedToken, Tokenizer

    one_thread_per_task()
    lib = Tokenizer.from_file(vocabulary)
    lib.add_special_tokens([AddedToken(t, normalized=False) for t in (TURN_START, ROLE_END, TURN_END)])
    return lib


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (start, stop) spans of the assistant texts in it."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{TURN_START}{escape(role)}{ROLE_END}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{TURN_END}\n"]
        at += len(head) + len(body) + len(TURN_END) + 1
    return "".join(out), spans


def loss_mask(starts: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap a span; token starts and stops never decrease."""
    mask = np.zeros(len(starts), dtype=bool)
    for a, b in spans:
        if a < b:
            first = np.searchsorted(stops, a, side="right")
            last = np.searchsorted(starts, b, side="left")
            mask[first:last] = True
    return mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def masked_texts(formatted: str, starts: np.ndarray, stops: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
    """For each assistant span the unescaped text that masked tokens cover in it.

    Tokens of one character split over several cover it once.
    """
    out = []
    a_of, b_of = starts[mask], stops[mask]
    for a, b in spans:
        first, last = np.searchsorted(b_of, a, side="right"), np.searchsorted(a_of, b, side="left")
        parts, done = [], a
        for s, e in zip(a_of[first:last].tolist(), b_of[first:last].tolist()):
            s, e = max(s, done), min(e, b)
            if s < e:
                parts.append(formatted[s:e])
                done = e
        out.append(unescape("".join(parts)))
    return out


def masked_text(formatted: str, starts: np.ndarray, stops: np.ndarray, mask: np.ndarray) -> str:
    """The unescaped text of the masked tokens, by their offsets alone."""
    parts, done = [], 0
    for s, e in zip(starts[mask].tolist(), stops[mask].tolist()):
        s = max(s, done)  # tokens of one character split over several cover it once
        if s < e:
            parts.append(formatted[s:e])
            done = e
    return unescape("".join(parts))


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order.

    Null roles and texts are empty. Equal turn numbers go by role, then text; a null turn
    number comes first. Rows without conv_id belong to nothing that is known: each is a
    conversation of its own, made where it is read.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("said"))
    named = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    return named.unionByName(turns.where(F.col("conv_id").isNull()).select("conv_id", F.array("said").alias("turns")))


def format_conversations(rows: DataFrame, vocabulary: str) -> DataFrame:
    """Formatted text, token ids, character offsets, loss mask and assistant spans of each conversation.

    One row per conv_id and per row without one, see :func:`conversations` for nulls and
    ties. Other columns are ignored; an empty table gives an empty result.
    """

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lib = encoder(vocabulary)
        for batch in batches:
            size = batch["turns"].map(lambda turns: sum(len(t["text"]) for t in turns)).cumsum() // LETTERS
            for _, pdf in batch.groupby(size):
                done = [render([(t["role"], t["text"]) for t in turns]) for turns in pdf["turns"]]
                coded = lib.encode_batch([text for text, _ in done], add_special_tokens=False)
                out = []
                for conv, (text, spans), c in zip(pdf["conv_id"], done, coded):
                    offsets = np.array(c.offsets, dtype=np.int32).reshape(-1, 2)
                    mask = loss_mask(offsets[:, 0], offsets[:, 1], spans)
                    marks = [{"start": a, "stop": b} for a, b in spans]
                    out.append((conv, text, np.array(c.ids, dtype=np.int32), offsets[:, 0], offsets[:, 1], mask, marks))
                frame = pd.DataFrame(out, columns=["conv_id", "formatted", "ids", "starts", "stops", "loss", "spans"])
                yield frame.assign(conv_id=frame["conv_id"].astype("Int64"))

    return conversations(rows).mapInPandas(formatted, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """Read back: turns and masked text of formatted conversations as counts and hashes."""

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                turns, told = parse(r.formatted), hashlib.sha256()
                for role, text in turns:
                    told.update(f"{role}\n{text}\n".encode())
                mask = np.asarray(r.loss, dtype=bool)
                loss = masked_text(r.formatted, np.asarray(r.starts), np.asarray(r.stops), mask)
                out.append((r.conv_id, len(turns), told.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r.formatted)))
            frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield frame.assign(conv_id=frame["conv_id"].astype("Int64"))

    kept = formatted.select("conv_id", "formatted", "starts", "stops", "loss")
    return kept.mapInPandas(
        digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
