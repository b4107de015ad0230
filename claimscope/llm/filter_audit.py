"""Filter interaction audit: what each filter of a chain removes, in every order, and its Shapley share.

Five filters judge whole texts (null text: empty): A too few words, B too few distinct
words, C too many capitals, D a symbol of SYMBOLS, E identical to the text of a smaller
doc_id anywhere in the table. All that any order of the filters does follows from how many
documents fail exactly which filters, so one pass gives every document a five-bit pattern
and Spark counts the patterns per part: at most 32 x 4 rows a part, whatever its size.

From them the removals v(S) of all 32 coalitions S are tabulated. A step of an order removes
v(S + f) - v(S). The Shapley values solve the least-squares problem that weights coalition S
by (n-1) / (C(n,|S|) |S| (n-|S|)) under the constraint that the values sum to v(all); its
normal equations are solved in rationals, so the result is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import staged

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
ALL = (1 << len(FILTERS)) - 1

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))

AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: str | None) -> tuple[bytes, int]:
    """Digest of the text and the bits of the filters A to D that it fails."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space: \x20 and \x09-\x0D
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
        100 * capitals > MAX_CAPITAL_PERCENT * len(text),
        SYMBOLS.search(raw) is not None,
    )
    return hashlib.sha256(raw).digest(), sum(1 << k for k, bad in enumerate(fails) if bad)


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [text_failures(t) for t in pdf["text"]]
        yield pd.DataFrame(
            {"doc_id": pdf["doc_id"], "part": pdf["part"], "digest": [d for d, _ in found], "mask": [m for _, m in found]}
        )


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents per part, failure pattern and label pair.

    A row without doc_id has no smaller id: it never fails E, never makes another fail it,
    and has no label. Repeated rows count each; rows that share id and text do not make each
    other fail E. An id with several labels takes the largest. All keys of the joins are
    unique on one side and pre-aggregated on the other, so no copy group meets in one task.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), "text")
    judged = texts.mapInPandas(_judged, "doc_id long, part string, digest binary, mask int")
    # Ids that are null need no digest: their rows fold into a few on the map side.
    judged = judged.withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest")))
    rows = staged(judged.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")

    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.withColumn("is_first", F.lit(True))
    marks = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    )
    repeat = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    mask = F.col("mask").bitwiseOR(F.when(repeat, 1 << FILTERS.index("E")).otherwise(0))
    no = F.lit(False)
    return (
        rows.join(first, ["digest", "doc_id"], "left")
        .join(marks, "doc_id", "left")
        .groupBy("part", mask.alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
        .agg(F.sum("n").alias("n"))
    )


def solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """Gauss-Jordan elimination in rationals."""
    rows = [[*line, r] for line, r in zip(matrix, right)]
    for k in range(len(rows)):
        pivot = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(len(rows)):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k])]
    return [line[-1] for line in rows]


def shapley(value: list[int]) -> list[Fraction]:
    """Shapley values of the game ``value`` (by coalition bits, value[0] = 0).

    Weighted least squares over the proper coalitions with the values' sum fixed to the
    grand coalition's value by a multiplier.
    """
    n = (len(value) - 1).bit_length()
    gram = [[Fraction(0)] * n for _ in range(n)]
    right = [Fraction(0)] * n
    for s in range(1, len(value) - 1):
        size = s.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        members = [i for i in range(n) if s >> i & 1]
        for i in members:
            right[i] += weight * value[s]
            for j in members:
                gram[i][j] += weight
    one = Fraction(1)
    system = [[*gram[i], one] for i in range(n)] + [[one] * n + [Fraction(0)]]
    return solve(system, [*right, Fraction(value[-1])])[:n]


def removals(counts: list[int]) -> list[int]:
    """Documents that fail any filter of each coalition, from counts by exact failure pattern."""
    return [sum(n for mask, n in enumerate(counts) if mask & s) for s in range(ALL + 1)]


def audit_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part from its pattern counts."""
    by = {"all": [0] * (ALL + 1), "good": [0] * (ALL + 1), "toxic": [0] * (ALL + 1)}
    for mask, good, toxic, n in zip(pdf["mask"], pdf["good"], pdf["toxic"], pdf["n"]):
        by["all"][mask] += int(n)
        by["good"][mask] += int(n) * bool(good)
        by["toxic"][mask] += int(n) * bool(toxic)
    value, good, toxic = (removals(by[k]) for k in ("all", "good", "toxic"))
    total, orders = sum(by["all"]), factorial(len(FILTERS))
    share = [orders * x for x in shapley(value)]
    if any(x.denominator != 1 for x in share):
        raise ArithmeticError("Shapley values are not multiples of 1/n!")
    out = []
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            k = FILTERS.index(name)
            after = before | 1 << k
            gone = value[after] - value[before]
            out.append((
                order, step, total - value[after], gone, value[1 << k] - gone, value[ALL] - value[ALL ^ 1 << k],
                good[after] - good[before], toxic[after] - toxic[before], int(share[k]),
            ))
            before = after
    names = [c.split()[0] for c in AUDIT.split(", ")]
    frame = pd.DataFrame(out, columns=names[1:])
    frame.insert(0, "part", pdf["part"].iloc[0])
    return frame


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step (AUDIT); a table without rows gives none.

    ``docs`` needs doc_id, source (null: empty string), text; ``labels`` doc_id, quality,
    toxic. Further columns do not matter.
    """
    return patterns(docs, labels).groupBy("part").applyInPandas(audit_part, AUDIT)
