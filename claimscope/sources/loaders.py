"""Load the warehouse tables (fact, code reference, provider registry).

A location is either a path (Parquet; the fact partitioned by
``claim_year``) or a catalog table name. Schemas are declared, never
inferred: in particular ``claim_year`` is read as a string although its
directory values look like integers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from claimscope.sources import schemas


def _is_path(location: str) -> bool:
    return "/" in location or ":" in location


def _read(spark: SparkSession, location: str, schema) -> DataFrame:
    if _is_path(location):
        return spark.read.schema(schema).parquet(location)
    return spark.table(location)


def load_claims(spark: SparkSession, location: str) -> DataFrame:
    df = _read(spark, location, schemas.CLAIMS)
    df = schemas.rename_published(df, schemas.PUBLISHED_CLAIMS_COLUMNS)
    if "claim_year" not in df.columns and "month" in df.columns:
        from claimscope.functions.scalars import year_of

        df = df.withColumn("claim_year", year_of("month"))
    return schemas.conform(df, schemas.CLAIMS, "claims")


def load_summary(spark: SparkSession, location: str, by_month: bool = False) -> DataFrame:
    schema = schemas.MONTH_SUMMARY if by_month else schemas.SUMMARY
    return schemas.conform(_read(spark, location, schema), schema, "provider_summary")


def load_reference(spark: SparkSession, location: str, validate: bool = True) -> DataFrame:
    df = schemas.rename_published(_read(spark, location, schemas.CODE_REFERENCE), schemas.PUBLISHED_REFERENCE_COLUMNS)
    df = schemas.conform(df, schemas.CODE_REFERENCE, "code_reference")
    if validate:
        schemas.assert_unique(df, "code", "code_reference")
    return df


def load_registry(spark: SparkSession, location: str, validate: bool = True) -> DataFrame:
    df = schemas.rename_published(_read(spark, location, schemas.REGISTRY), schemas.PUBLISHED_REGISTRY_COLUMNS)
    df = schemas.conform(df, schemas.REGISTRY, "provider_registry")
    if validate:
        schemas.assert_unique(df, "npi", "provider_registry")
    return df


@dataclass(frozen=True)
class Tables:
    """The three inputs every report reads."""

    claims: DataFrame
    reference: DataFrame
    registry: DataFrame
    summary: DataFrame | None = None
    month_summary: DataFrame | None = None

    def claims_for(self, *columns: str) -> DataFrame:
        """The smallest table holding every column a report reads: the yearly
        provider summary, else the monthly one, else the fact (which alone
        has the servicing NPI)."""
        for table in (self.summary, self.month_summary):
            if table is not None and all(c in table.columns for c in columns):
                return table
        return self.claims

    @classmethod
    def load(cls, spark: SparkSession, claims: str, reference: str, registry: str, validate: bool = True,
             summary: str | None = None, month_summary: str | None = None) -> Tables:
        """Open the tables; a provider summary is used by the reports when its location is given."""
        return cls(
            load_claims(spark, claims),
            load_reference(spark, reference, validate),
            load_registry(spark, registry, validate),
            load_summary(spark, summary) if summary else None,
            load_summary(spark, month_summary, by_month=True) if month_summary else None,
        )
