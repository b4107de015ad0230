"""Whole report pages computed from one pass over the fact.

A page shows several reports over the same filtered claims (services: by
category, by category x state, by code; trends: by month, by year, by month x
category). Instead of one fact scan per report, each page first aggregates
the fact to the finest grain its reports need *with the billing NPI in the
key* — (code, state, npi) or (month, code, npi). That grain is bounded by
providers x tracked codes (x months), not by claim volume, and because the
NPI is part of it, exact distinct-provider counts can still be taken from it
per report. The grain is persisted (memory, spilling to disk) for the life of
the page; ``close()`` releases it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions import measures
from claimscope.operators import filters as flt
from claimscope.operators.filters import ClaimsFilter
from claimscope.operators.joins import with_reference
from claimscope.plans import directory as dirs
from claimscope.plans import kpis
from claimscope.plans.reports import MEASURES, NO_FILTER, _by_claims, _fact_columns, sorted_small, trend_base


def _sums() -> list:
    """Additive measures kept at the page grain (exact; rounded only at the end)."""
    return [
        F.sum("total_claims").alias("total_claims"),
        F.sum("total_unique_beneficiaries").alias("total_unique_beneficiaries"),
        F.sum("total_paid").alias("total_paid"),
    ]


@dataclass
class _Page:
    _held: list[DataFrame] = field(default_factory=list, repr=False)

    def close(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()

    def __enter__(self):
        return self

    def __exit__(self, *exc) -> None:
        self.close()


@dataclass
class ServicesPage(_Page):
    category: DataFrame = None
    category_state: DataFrame = None
    code_detail: DataFrame = None
    kpis: DataFrame = None


@dataclass
class TrendsPage(_Page):
    monthly: DataFrame = None
    yearly: DataFrame = None
    category_trend: DataFrame = None


@dataclass
class DirectoryPage(_Page):
    rows: DataFrame = None
    kpis: DataFrame = None
    served_categories: DataFrame = None

    def refine(self, category: str | None = None, text: str | None = None) -> DataFrame:
        from claimscope.operators import refine

        return refine.refine(self.rows, category, text)


def services_page(claims: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER,
                  storage: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> ServicesPage:
    fact = flt.claim_filters(_fact_columns(claims), filt)
    codes = flt.select_codes(ref, filt.category, filt.codes)
    tracked = fact.join(codes.select("code").distinct(), "code", "left_semi")
    grain = tracked.groupBy("code", "practice_state", "billing_npi").agg(*_sums()).persist(storage)
    labelled = with_reference(grain, codes)

    category = _by_claims(labelled.groupBy("category").agg(*measures.m4()), "total_claims", "category")
    category_state = _by_claims(
        labelled.groupBy("category", F.col("practice_state").alias("state")).agg(*measures.m4()),
        "total_claims", "category", "state",
    )
    code_agg = grain.groupBy("code").agg(*measures.m4())
    code_detail = _by_claims(
        with_reference(code_agg, codes).select(F.col("code").alias("hcpcs_code"), "category", "description", *MEASURES),
        "total_claims", "hcpcs_code", "category",
    )
    return ServicesPage([grain], category, category_state, code_detail, kpis.services_kpis(category))


def trends_page(claims: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER,
                storage: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> TrendsPage:
    base = trend_base(claims, ref, filt)
    grain = base.groupBy("month", "claim_year", "category", "billing_npi").agg(*_sums()).persist(storage)
    monthly = sorted_small(grain.groupBy("month").agg(*measures.m4()), F.col("month").asc_nulls_last())
    yearly = sorted_small(
        grain.groupBy(F.col("claim_year").alias("year")).agg(*measures.m4()), F.col("year").asc_nulls_last()
    )
    category_trend = sorted_small(
        grain.groupBy("month", "category").agg(measures.total_claims()),
        F.col("month").asc_nulls_last(), F.col("category").asc_nulls_last(),
    )
    return TrendsPage([grain], monthly, yearly, category_trend)


def directory_page(claims: DataFrame, ref: DataFrame, registry: DataFrame, filt: ClaimsFilter,
                   view: str = "billing", storage: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DirectoryPage:
    """The directory once; KPIs, category facet and refinements read it."""
    from claimscope.operators import facets

    rows = dirs.directory(claims, ref, registry, filt, view).persist(storage)
    return DirectoryPage([rows], rows, kpis.directory_kpis(rows), facets.served_categories(rows))
