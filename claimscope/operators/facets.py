"""Distinct value lists offered as filter choices (facets).

Each is a ``distinct`` + sort over one column, so it returns a small
DataFrame computed in parallel; the caller decides whether to collect it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.scalars import split_list
from claimscope.operators.filters import reference_by_category


def _sorted(df: DataFrame, *cols) -> DataFrame:
    """A facet has few values (states, years, categories, codes): after the
    distributed ``distinct`` it is ordered in one partition."""
    return df.repartition(1).sortWithinPartitions(*cols)


def states(claims: DataFrame) -> DataFrame:
    return _sorted(
        claims.where(F.col("practice_state").isNotNull()).select(F.col("practice_state").alias("state")).distinct(),
        "state",
    )


def years(claims: DataFrame) -> DataFrame:
    """Years with a known month (``claim_year`` is null exactly when month is)."""
    return _sorted(
        claims.where(F.col("claim_year").isNotNull()).select(F.col("claim_year").alias("year")).distinct(),
        "year",
    )


def categories(ref: DataFrame) -> DataFrame:
    return _sorted(ref.where(F.col("category").isNotNull()).select("category").distinct(), "category")


def codes(ref: DataFrame, category: str | None = None) -> DataFrame:
    """Codes available under the chosen category, in category then code order."""
    return _sorted(
        reference_by_category(ref, category).select(F.col("code").alias("hcpcs_code"), "category", "description"),
        F.col("category").asc_nulls_last(),
        F.col("hcpcs_code").asc_nulls_last(),
    )


def served_categories(directory: DataFrame, column: str = "categories_served") -> DataFrame:
    """Categories present in a directory result: split, explode, distinct, sort."""
    return _sorted(
        directory.where(F.col(column).isNotNull()).select(F.explode(split_list(column)).alias("category")).distinct(),
        "category",
    )
