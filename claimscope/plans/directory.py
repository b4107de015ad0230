"""Provider directory: billing, servicing, or billing x servicing pairs.

Eager aggregation: the fact is aggregated by NPI (or NPI pair) *before* the
registry is joined, and display names are computed after. Catalyst does not
push an aggregate below an outer join by itself; doing it by hand keeps ten
wide registry strings out of the shuffle and joins the registry to the small
aggregated result instead of to every claim row. It equals the
join-then-group form because registry NPIs are unique (asserted at load).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions import measures
from claimscope.functions.scalars import billing_name, servicing_name
from claimscope.operators.filters import ClaimsFilter
from claimscope.operators.joins import left_join_on
from claimscope.plans.reports import service_base

VIEWS = ("billing", "servicing", "combined")

MEASURE_COLUMNS = (
    "hiv_service_categories",
    "categories_served",
    "total_hiv_claims",
    "total_beneficiaries",
    "total_paid",
)


def _registry(registry: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """Registry renamed for the join on ``key``.

    The aggregated side is already hash-partitioned on the NPI by its
    aggregation, so a sort-merge join shuffles only the registry; AQE turns
    it into a broadcast when the registry is small. (A semi-join reduction of
    the registry by the aggregated NPIs was tried and rejected: AQE writes the
    registry shuffle before it can switch to a broadcast, and the key branch
    re-scans the fact.) For a registry of national size, store it bucketed by
    ``npi`` in the catalog so that join needs no registry shuffle at all.
    """
    return registry.select(
        F.col("npi").alias(key),
        *[F.col(c).alias(prefix + c) for c in registry.columns if c != "npi"],
    )


def _order(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(F.col("total_hiv_claims").desc(), *[F.col(k).asc_nulls_last() for k in keys])


def directory(claims: DataFrame, ref: DataFrame, registry: DataFrame, filt: ClaimsFilter,
              view: str = "billing") -> DataFrame:
    """Directory rows for the chosen view; requires at least one state."""
    if view not in VIEWS:
        raise ValueError(f"view must be one of {VIEWS}, got {view!r}")
    filt.require_states()
    base = service_base(claims, ref, filt)
    m = list(MEASURE_COLUMNS)

    if view == "billing":
        agg = measures.directory(base.withColumnRenamed("billing_npi", "npi"), "npi")
        out = agg.join(_registry(registry, "npi"), "npi", "left").select(
            "npi",
            "entity_type",
            billing_name().alias("provider_name"),
            "credentials",
            F.col("taxonomy_1").alias("taxonomy"),
            "address",
            "city",
            "state",
            "zip",
            "phone",
            *m,
        )
        return _order(out, "npi")

    if view == "servicing":
        # A null servicing NPI is one group; it matches no registry row and
        # is shown as 'Unknown'. The state shown is the servicing provider's,
        # while the state filter applied to the billing location.
        agg = measures.directory(base.withColumnRenamed("servicing_npi", "npi"), "npi")
        out = agg.join(_registry(registry, "npi"), "npi", "left").select(
            "npi",
            "entity_type",
            servicing_name().alias("provider_name"),
            "credentials",
            F.col("taxonomy_1").alias("taxonomy"),
            "address",
            "city",
            "state",
            "zip",
            "phone",
            *m,
        )
        return _order(out, "npi")

    agg = measures.directory(base, "billing_npi", "servicing_npi")
    billed = agg.join(_registry(registry, "billing_npi", "b_"), "billing_npi", "left")
    # Pairs without a servicing NPI are many rows of one null key.
    out = (
        left_join_on(billed, _registry(registry, "servicing_npi", "s_"), "servicing_npi", "billing_npi")
        .select(
            "billing_npi",
            billing_name("b_org_name", "b_first_name", "b_last_name").alias("billing_name"),
            F.col("b_entity_type").alias("billing_entity_type"),
            "servicing_npi",
            servicing_name("s_entity_type", "s_org_name", "s_first_name", "s_last_name").alias("servicing_name"),
            F.col("s_credentials").alias("servicing_credentials"),
            F.col("s_taxonomy_1").alias("servicing_taxonomy"),
            F.col("b_city").alias("city"),
            F.col("b_state").alias("state"),
            F.col("b_zip").alias("zip"),
            *m,
        )
    )
    return _order(out, "billing_npi", "servicing_npi")
