"""Aggregate measures shared by the reports.

``m4`` are the four measures of every summary report. ``directory`` adds the
served-category count and list. Every aggregate here is algebraic or a set of
bounded size, so Spark plans them as partial (map-side) + final aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.scalars import LIST_SEPARATOR


def providers(alias: str = "providers") -> Column:
    """Exact distinct billing providers (always billing, even for servicing views)."""
    return F.count_distinct("billing_npi").alias(alias)


def total_claims(alias: str = "total_claims") -> Column:
    return F.sum("total_claims").alias(alias)


def total_beneficiaries(alias: str = "total_beneficiaries") -> Column:
    """Plain sum of per-row beneficiary counts — not distinct persons."""
    return F.sum("total_unique_beneficiaries").alias(alias)


def total_paid(alias: str = "total_paid") -> Column:
    """Money stays DECIMAL; rounding to cents is exact on DECIMAL input."""
    return F.round(F.sum("total_paid"), 2).alias(alias)


def m4(providers_alias: str = "providers") -> list[Column]:
    return [providers(providers_alias), total_claims(), total_beneficiaries(), total_paid()]


def served_categories() -> list[Column]:
    """Distinct category count and sorted ``", "`` list; an all-null input gives null, not ''."""
    cats = F.collect_set("category")
    return [
        F.size(cats).cast("bigint").alias("hiv_service_categories"),
        F.when(F.size(cats) > 0, F.array_join(F.sort_array(cats), LIST_SEPARATOR)).alias(
            "categories_served"
        ),
    ]


def directory(base: DataFrame, *keys: str) -> DataFrame:
    """Directory measures by ``keys``, in two steps.

    Claim rows are first summed by (keys, category), an ordinary hash aggregate; the
    category set is then collected over at most one row per category, so that the
    object aggregate never sees claim rows.
    """
    by_category = base.groupBy(*keys, "category").agg(
        F.sum("total_claims").alias("total_claims"),
        F.sum("total_unique_beneficiaries").alias("total_unique_beneficiaries"),
        F.sum("total_paid").alias("total_paid"),
    )
    return by_category.groupBy(*keys).agg(
        *served_categories(), total_claims("total_hiv_claims"), total_beneficiaries(), total_paid()
    )
