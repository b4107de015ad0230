"""Headline figures, each a one-row DataFrame derived from its report.

Sums over an empty report are 0, not null. 'providers' in the overview and
services KPIs is the sum of per-group distinct counts (a provider active in
two categories counts twice); in the directory it is the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum0(col: str, alias: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).alias(alias)


def _count(alias: str) -> Column:
    return F.count(F.lit(1)).alias(alias)


def reference_kpis(ref: DataFrame) -> DataFrame:
    return ref.agg(_count("total_codes"), F.count_distinct("category").alias("service_categories"))


def overview_kpis(overview: DataFrame) -> DataFrame:
    return overview.agg(
        _count("states"),
        _sum0("total_providers", "providers"),
        _sum0("total_claims", "total_claims"),
        _sum0("total_paid", "total_paid"),
    )


def services_kpis(category_summary: DataFrame) -> DataFrame:
    return category_summary.agg(
        _count("service_categories"),
        _sum0("providers", "providers"),
        _sum0("total_claims", "total_claims"),
        _sum0("total_paid", "total_paid"),
    )


def directory_kpis(directory: DataFrame) -> DataFrame:
    """Taken on the full directory, before post-category and search."""
    return directory.agg(
        _count("providers"),
        _sum0("total_hiv_claims", "total_hiv_claims"),
        _sum0("total_beneficiaries", "total_beneficiaries"),
        _sum0("total_paid", "total_paid"),
    )


def shown_rows(df: DataFrame, alias: str = "rows_shown") -> DataFrame:
    """Rows left after all filters (the 'N found' line)."""
    return df.agg(_count(alias))
