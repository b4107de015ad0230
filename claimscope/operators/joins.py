"""Joins of the claims model.

* code reference: inner equi-join;
* provider registry: left equi-joins on the billing and/or servicing NPI.

No side is hinted: Spark broadcasts a side below its byte threshold, from statistics or,
with AQE, from the size a shuffle stage turned out to have, and sort-merges otherwise.
A hot billing NPI is left to AQE's skew-join splitting. A null servicing NPI can match
nothing, so null keys are spread over many non-matching values instead of meeting in
one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.scalars import year_of

# Null join keys are spread over this many values.
NULL_SPREAD = 1024

REGISTRY_ATTRIBUTES = (
    "entity_type",
    "org_name",
    "first_name",
    "last_name",
    "credentials",
    "taxonomy_1",
    "address",
    "city",
    "state",
    "zip",
    "phone",
)


def with_reference(claims: DataFrame, ref: DataFrame) -> DataFrame:
    """Inner join on code: keeps tracked codes only and adds category, description.

    The reference must be unique on code (asserted at load), otherwise rows
    fan out and sums double.
    """
    ref = ref.select("code", "category", "description")
    return claims.join(ref, "code", "inner")


def _registry_side(registry: DataFrame, key: str, prefix: str) -> DataFrame:
    return registry.select(
        F.col("npi").alias(key), *[F.col(a).alias(prefix + a) for a in REGISTRY_ATTRIBUTES]
    )


def with_billing(df: DataFrame, registry: DataFrame, key: str = "billing_npi", prefix: str = "b_") -> DataFrame:
    """Left join registry attributes (prefixed ``b_``) on the billing NPI."""
    return df.join(_registry_side(registry, key, prefix), key, "left")


def join_key(key: str, *spread_by: str) -> F.Column:
    """The key, with nulls replaced by values that no provider number equals."""
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(NULL_SPREAD)).cast("string")
    return F.coalesce(F.col(key), F.concat(F.lit("null-"), spread))


def left_join_on(df: DataFrame, side: DataFrame, key: str, *spread_by: str) -> DataFrame:
    """Left join on a nullable key of ``df``; ``side`` has the key under the same name."""
    keyed = df.withColumn("__join_key", join_key(key, *spread_by))
    return keyed.join(side.withColumnRenamed(key, "__join_key"), "__join_key", "left").drop("__join_key")


def with_servicing(df: DataFrame, registry: DataFrame, key: str = "servicing_npi", prefix: str = "s_") -> DataFrame:
    """Left join on the servicing NPI; a null NPI never matches."""
    spread_by = [c for c in ("billing_npi", "code", "month") if c in df.columns]
    return left_join_on(df, _registry_side(registry, key, prefix), key, *spread_by)


def with_both(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry joined twice: billing attributes ``b_*``, servicing ``s_*``."""
    return with_servicing(with_billing(df, registry), registry)


def enrich(monthly: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach the billing provider's practice state and the claim year.

    Left join: claims of unregistered providers are kept with a null state
    (every report then drops them). Only two registry columns take part.
    """
    location = registry.select(F.col("npi").alias("billing_npi"), F.col("state").alias("practice_state"))
    return monthly.join(location, "billing_npi", "left").withColumn("claim_year", year_of("month"))
