"""Post-aggregate refinements of a directory result: category and text search.

These only hide rows of an already computed directory; its totals (the KPI
row) are taken before them. Contrast with the pre-aggregate category filter
in ``filters.select_codes``, which changes the totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.functions.scalars import search_text, split_list


def post_category(directory: DataFrame, category: str | None,
                  column: str = "categories_served") -> DataFrame:
    """Keep rows whose served-category list holds ``category`` as an element.

    Exact element match on the split list (a literal, not a regular
    expression); a null list never matches. None = identity.
    """
    if category is None:
        return directory
    return directory.where(F.coalesce(F.array_contains(split_list(column), F.lit(category)), F.lit(False)))


def searchable_columns(df: DataFrame) -> list[str]:
    """Every column except binary floating point ones (their text form differs
    between engines and from what a reader sees)."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def search(directory: DataFrame, text: str | None) -> DataFrame:
    """Case-insensitive literal substring over all cells of a row; empty = all."""
    if not text:
        return directory
    return directory.where(search_text(*searchable_columns(directory)).contains(F.lit(text.lower())))


def refine(directory: DataFrame, category: str | None = None, text: str | None = None) -> DataFrame:
    return search(post_category(directory, category), text)
