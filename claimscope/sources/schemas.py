"""Declared schemas of the three warehouse tables and load-time checks.

The claims model has no DDL upstream, so every table is conformed to a
declared ``StructType`` when it is loaded: missing columns fail fast, types
are cast once, and keys that must be unique are asserted (a duplicate
registry NPI or reference code would silently double every sum after the
joins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Enriched claims fact: one row per billing x servicing x code x month.
# Beneficiary counts are per row and are NOT de-duplicated persons: summing
# them repeats people across providers and months.
CLAIMS = T.StructType(
    [
        T.StructField("billing_npi", T.StringType(), False),
        T.StructField("servicing_npi", T.StringType(), True),
        T.StructField("code", T.StringType(), False),
        T.StructField("month", T.StringType(), True),
        T.StructField("total_claims", T.LongType(), False),
        T.StructField("total_unique_beneficiaries", T.LongType(), False),
        T.StructField("total_paid", MONEY, False),
        T.StructField("practice_state", T.StringType(), True),
        T.StructField("claim_year", T.StringType(), True),
    ]
)

# Provider summary: the fact aggregated over servicing provider and month,
# one row per billing provider x code x practice state x year. Distinct
# billing providers stay exact on it (the NPI is in the key); sums are
# additive. Reports that need neither month nor servicing NPI read it.
# Money stays DECIMAL(18,2) as in the fact: up to precision 18 Parquet stores
# it as INT64 and Spark adds it as a long; wider decimals are read through
# BigDecimal row by row. A per-provider/code/year sum beyond 10^16 would fail
# the cast (ANSI mode, the default) rather than be truncated.
SUMMARY_MONEY = MONEY
SUMMARY = T.StructType(
    [
        T.StructField("billing_npi", T.StringType(), False),
        T.StructField("code", T.StringType(), False),
        T.StructField("practice_state", T.StringType(), True),
        T.StructField("total_claims", T.LongType(), False),
        T.StructField("total_unique_beneficiaries", T.LongType(), False),
        T.StructField("total_paid", SUMMARY_MONEY, False),
        T.StructField("claim_year", T.StringType(), True),
    ]
)

# The same at month grain (only the servicing provider aggregated away), for
# the monthly and category trends.
MONTH_SUMMARY = T.StructType(SUMMARY.fields[:3] + [T.StructField("month", T.StringType(), True)] + SUMMARY.fields[3:])

# Monthly rollup before enrichment (no location yet).
CLAIMS_MONTHLY = T.StructType([f for f in CLAIMS.fields if f.name not in ("practice_state", "claim_year")])

# Detailed claim lines, the input of the monthly rollup.
CLAIM_LINES = T.StructType(
    [
        T.StructField("billing_npi", T.StringType(), False),
        T.StructField("servicing_npi", T.StringType(), True),
        T.StructField("code", T.StringType(), False),
        T.StructField("month", T.StringType(), True),
        T.StructField("claims", T.LongType(), False),
        T.StructField("beneficiary_id", T.StringType(), True),
        T.StructField("paid", T.DecimalType(18, 4), False),
    ]
)

CODE_REFERENCE = T.StructType(
    [
        T.StructField("code", T.StringType(), False),
        T.StructField("category", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
    ]
)

REGISTRY = T.StructType(
    [T.StructField("npi", T.StringType(), False)]
    + [
        T.StructField(name, T.StringType(), True)
        for name in (
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
    ]
)

# Column names of the published claims file and of the
# enriched warehouse table, mapped to the model's names.
PUBLISHED_CLAIMS_COLUMNS = {
    "BILLING_PROVIDER_NPI_NUM": "billing_npi",
    "SERVICING_PROVIDER_NPI_NUM": "servicing_npi",
    "HCPCS_CODE": "code",
    "CLAIM_FROM_MONTH": "month",
    "TOTAL_CLAIMS": "total_claims",
    "TOTAL_UNIQUE_BENEFICIARIES": "total_unique_beneficiaries",
    "TOTAL_PAID": "total_paid",
    "Provider Business Practice Location Address State Name": "practice_state",
}
PUBLISHED_REFERENCE_COLUMNS = {"hcpcs_code": "code"}
PUBLISHED_REGISTRY_COLUMNS = {"NPI": "npi"}


class SchemaError(ValueError):
    """A table does not carry the columns or keys the model needs."""


def rename_published(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename publisher column names to model names (absent ones are left alone)."""
    for src, dst in mapping.items():
        if src in df.columns and dst not in df.columns:
            df = df.withColumnRenamed(src, dst)
    return df


def conform(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """Select the declared columns in declared order, cast to declared types.

    Raises ``SchemaError`` before any job runs when a column is missing.
    """
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise SchemaError(f"{name}: missing column(s) {missing}; has {df.columns}")
    current = dict(df.dtypes)
    cols = []
    for f in schema.fields:
        c = F.col(f.name)
        if current[f.name] != f.dataType.simpleString():
            c = c.cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def assert_unique(df: DataFrame, key: str, name: str) -> None:
    """Fail if ``key`` repeats. One aggregate job; stops at the first duplicate."""
    dup = df.groupBy(key).count().where(F.col("count") > 1).limit(1)
    if not dup.isEmpty():
        value = dup.first()[key]
        raise SchemaError(f"{name}: key {key!r} is not unique (e.g. {value!r})")
