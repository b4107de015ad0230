"""Registry and provider summaries as bucketed catalog tables: directory joins without a shuffle.

The registry is bucketed by NPI; beside it lie the fact's summaries by billing and by servicing
provider, bucketed by the same NPI into as many buckets. A directory then aggregates and joins
bucket by bucket: no exchange of claims, and none of the registry, whose ten wide text columns
would otherwise be shuffled by every query once it is too large to broadcast.

Summaries, not the fact, are bucketed: a bucket is one task, and a provider with a third of all
claim rows would make one bucket a third of the table. A summary holds at most codes x states x
years rows of a provider.

The files are ordinary Parquet in a folder of their own, so another session can register them
again (:func:`register`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.sources import schemas
from claimscope.sources.loaders import Tables

#: For a registry of some ten million rows, about 50 MB a bucket.
BUCKETS = 32

SERVICING_SUMMARY = T.StructType([T.StructField("servicing_npi", T.StringType(), True), *schemas.SUMMARY.fields[1:]])


@dataclass(frozen=True)
class Bucketed:
    """Opened tables: the registry by npi, summaries by billing_npi and by servicing_npi."""

    registry: DataFrame
    billing: DataFrame | None = None
    servicing: DataFrame | None = None

    def claims_for(self, view: str, fact: DataFrame) -> DataFrame:
        """What the directory view aggregates; pairs of providers need the fact."""
        return {"billing": self.billing, "servicing": self.servicing}.get(view, fact)


TABLES = {
    "registry": ("npi", schemas.REGISTRY),
    "billing": ("billing_npi", schemas.SUMMARY),
    "servicing": ("servicing_npi", SERVICING_SUMMARY),
}


def servicing_summary(claims: DataFrame) -> DataFrame:
    """Fact -> servicing provider x code x practice state x year; no servicing NPI is one provider."""
    return claims.groupBy("servicing_npi", "code", "practice_state", "claim_year").agg(
        F.sum("total_claims").alias("total_claims"),
        F.sum("total_unique_beneficiaries").alias("total_unique_beneficiaries"),
        F.sum("total_paid").cast(schemas.SUMMARY_MONEY).alias("total_paid"),
    )


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """One file per bucket: rows are dealt by the key exactly as buckets are."""
    name = "claimscope_write_" + path.rstrip("/").rsplit("/", 1)[-1]
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay


def tables_of(view: str) -> tuple[str, ...]:
    """The tables that a directory view reads."""
    return ("registry", view) if view in TABLES else ("registry",)


def write_table(t: Tables, name: str, folder: str, buckets: int = BUCKETS) -> None:
    from claimscope.plans import prep

    if name == "registry":
        made = t.registry
    elif name == "servicing":
        made = servicing_summary(t.claims)
    else:
        made = t.summary if t.summary is not None else prep.provider_summary(t.claims)
    key, schema = TABLES[name]
    write_bucketed(schemas.conform(made, schema, name), folder, key, buckets)


def write_tables(t: Tables, folder: str, buckets: int = BUCKETS) -> None:
    for name in TABLES:
        write_table(t, name, f"{folder}/{name}", buckets)


def register(spark: SparkSession, name: str, path: str, key: str, schema: T.StructType, buckets: int = BUCKETS) -> DataFrame:
    """Bucketed files as a catalog table of this session."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def open_tables(spark: SparkSession, folder: str, version: str, buckets: int = BUCKETS) -> Bucketed:
    """The tables that :func:`write_tables` wrote; ``version`` keeps names of different sources apart."""
    opened = {n: register(spark, f"claimscope_{n}_{version}", f"{folder}/{n}", key, schema, buckets) for n, (key, schema) in TABLES.items()}
    return Bucketed(**opened)
