"""Letter n-grams of text columns, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of the grams that a longer needle is looked up by; shorter needles are grams themselves.
SIZE = 3


def grams(text: Column, sizes: tuple[int, ...] = (SIZE,)) -> Column:
    """Distinct substrings of the given lengths; null and shorter texts have none."""
    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.char_length(text) - F.lit(n - 1))
        cut = F.transform(places, lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.char_length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(of(n) for n in sizes)))


def needle_grams(needle: Column) -> Column:
    """The grams that every text holding ``needle`` has: its trigrams, or itself if it is shorter; none if empty."""
    short = F.when(F.char_length(needle) > 0, F.array(needle)).otherwise(F.array().cast("array<string>"))
    return F.when(F.char_length(needle) >= SIZE, grams(needle)).otherwise(short)
