"""Summary reports: state overview, service analysis, trends, code reference.

Each report is a lazy DataFrame plan: filters as ``Column`` predicates on
the fact, the small code reference joined by broadcast, then a grouped
aggregate. With one exact distinct count Spark aggregates in two phases —
partially by (group keys, billing NPI) before the first shuffle, then by the
group keys — so a state or provider holding a large share of the rows never
meets in one task as raw rows. Results are small; only they are sorted.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions import measures
from claimscope.operators import filters as flt
from claimscope.operators.filters import ClaimsFilter
from claimscope.operators.joins import with_reference

FACT_COLUMNS = (
    "billing_npi",
    "servicing_npi",
    "code",
    "month",
    "claim_year",
    "practice_state",
    "total_claims",
    "total_unique_beneficiaries",
    "total_paid",
)

NO_FILTER = ClaimsFilter()
MEASURES = ("providers", "total_claims", "total_beneficiaries", "total_paid")


def sorted_small(df: DataFrame, *cols) -> DataFrame:
    """Order a result whose size is bounded by dimension cardinalities.

    Every summary here has at most (states x categories), (codes) or
    (months x categories) rows, however large the fact is; after the
    distributed aggregation such a result is ordered in one partition, which
    skips the sampling job and extra stage of a range-partitioned global sort.
    Results that grow with the data (the provider directory, row-level
    outputs) use ``orderBy`` instead.
    """
    return df.repartition(1).sortWithinPartitions(*cols)


def _fact_columns(claims: DataFrame) -> DataFrame:
    """The model columns present: all of them on the fact, fewer on the
    provider summary (no month, no servicing NPI)."""
    return claims.select(*[c for c in FACT_COLUMNS if c in claims.columns])


def _by_claims(df: DataFrame, measure: str, *keys: str) -> DataFrame:
    """Largest first; keys break ties so the order is deterministic."""
    return sorted_small(df, F.col(measure).desc(), *[F.col(k).asc_nulls_last() for k in keys])


# ---------------------------------------------------------------- overview


def state_overview(claims: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    """All claims (no code restriction) per practice state."""
    base = flt.by_years(flt.by_states(flt.known_state(claims), filt.states), filt.years)
    out = base.groupBy(F.col("practice_state").alias("state")).agg(*measures.m4("total_providers"))
    return _by_claims(out, "total_claims", "state")


# ---------------------------------------------------------------- services


def service_base(claims: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    """Filtered fact joined to the (restricted) code reference.

    The category / code cascade restricts the small reference table before
    the broadcast join, which carries it to the fact; explicit codes are also
    put on the fact as a literal ``IN`` so they reach the Parquet scan.
    """
    fact = flt.claim_filters(_fact_columns(claims), filt)
    codes = flt.select_codes(ref, filt.category, filt.codes)
    return with_reference(fact, codes)


def category_summary(claims: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    out = service_base(claims, ref, filt).groupBy("category").agg(*measures.m4())
    return _by_claims(out, "total_claims", "category")


def category_state(claims: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    out = (
        service_base(claims, ref, filt)
        .groupBy("category", F.col("practice_state").alias("state"))
        .agg(*measures.m4())
    )
    return _by_claims(out, "total_claims", "category", "state")


def code_detail(claims: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    """Per code. Aggregated by code alone and labelled afterwards, so the
    (long) description strings never go through the shuffle; a code listed
    under two categories still yields one row per category with full sums."""
    fact = flt.claim_filters(_fact_columns(claims), filt)
    codes = flt.select_codes(ref, filt.category, filt.codes)
    tracked = fact.join(codes.select("code").distinct(), "code", "left_semi")
    agg = tracked.groupBy("code").agg(*measures.m4())
    out = with_reference(agg, codes).select(
        F.col("code").alias("hcpcs_code"), "category", "description", *MEASURES
    )
    return _by_claims(out, "total_claims", "hcpcs_code", "category")


# ---------------------------------------------------------------- trends


def trend_base(claims: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    """Trends show every year and every tracked code: only the state applies."""
    only_states = replace(filt.without_years(), category=None, codes=())
    return service_base(claims, ref, only_states)


def monthly(claims: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    """Per month; a null month is its own group, sorted last."""
    out = trend_base(claims, ref, filt).groupBy("month").agg(*measures.m4())
    return sorted_small(out, F.col("month").asc_nulls_last())


def yearly(claims: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    """Per year; distinct providers are recounted per year, not summed over months.

    ``claim_year`` is ``LEFT(month, 4)`` by construction (the partition column).
    """
    out = trend_base(claims, ref, filt).groupBy(F.col("claim_year").alias("year")).agg(*measures.m4())
    return sorted_small(out, F.col("year").asc_nulls_last())


def category_trend(claims: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    out = (
        trend_base(claims, ref, filt)
        .groupBy("month", "category")
        .agg(measures.total_claims())
    )
    return sorted_small(out, F.col("month").asc_nulls_last(), F.col("category").asc_nulls_last())


# ---------------------------------------------------------------- reference


def code_reference(ref: DataFrame) -> DataFrame:
    """The tracked codes, by category then code."""
    return sorted_small(
        ref.select(F.col("code").alias("hcpcs_code"), "category", "description"),
        F.col("category").asc_nulls_last(),
        F.col("hcpcs_code").asc_nulls_last(),
    )


def reference_by_category(ref: DataFrame, category: str | None) -> DataFrame:
    return code_reference(flt.reference_by_category(ref, category))


def category_counts(ref: DataFrame) -> DataFrame:
    """Codes per category, most first; codes without a category are not counted."""
    out = ref.where(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("code_count"))
    return _by_claims(out, "code_count", "category")
