"""Claims model derived from the TPC-H-style test tables.

The publisher's files are not available here, so the three warehouse tables
are derived from ``supplier``, ``customer``, ``nation``, ``part``,
``orders`` and ``lineitem`` by a fixed mapping:

* registry: suppliers are organisations, customers are persons; some keys
  are deliberately left unregistered so left joins leave nulls;
* code reference: part brands 1..14 are tracked codes in seven categories,
  brands above 14 are untracked so the inner join really drops rows;
* claim lines: one per line item (billing = supplier, servicing = one of 150
  persons or null, code = part brand, month = ship month or null).

Everything is DataFrame expressions; the same mapping is written as DuckDB
SQL in ``__spark_entry__.oracle_sql`` to check the engine end to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.plans import prep
from claimscope.sources import schemas

# Tracked categories of the test mapping, indexed by brand
# number modulo 7.
TEST_CATEGORIES = (
    "Intake",
    "Diagnostics",
    "Treatment",
    "Outreach",
    "Follow-up & Review",
    "Reporting",
    "Support",
)
MAX_TRACKED_BRAND = 14
ORG_NPI_BASE = 1_000_000_000
PERSON_NPI_BASE = 2_000_000_000
SERVICING_POOL = 150


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _npi(base: int, key: str) -> F.Column:
    return (F.lit(base) + F.col(key)).cast("string")


def _address_fields(key: str, street: str) -> list[F.Column]:
    k = F.col(key)
    return [
        F.concat(k.cast("string"), F.lit(street)).alias("address"),
        F.concat(F.lit("City_"), (k % 20).cast("string")).alias("city"),
        F.col("n_name").alias("state"),
        F.lpad((k % 100000).cast("string"), 5, "0").alias("zip"),
        F.concat(F.lit("555-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone"),
    ]


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The key rules below (and the null-month / null-servicing rules in
    # claim_lines) are the fixed test mapping: they decide which providers are
    # *unregistered* so the left joins meet nulls. They do not sample: every
    # row of every source table is read and every line item becomes a claim.
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orgs = (
        read(spark, sf_dir, "supplier")
        .where(F.col("s_suppkey") % 10 != 9)
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            _npi(ORG_NPI_BASE, "s_suppkey").alias("npi"),
            F.lit("2").alias("entity_type"),
            F.col("s_name").alias("org_name"),
            F.lit(None).cast("string").alias("first_name"),
            F.lit(None).cast("string").alias("last_name"),
            F.lit(None).cast("string").alias("credentials"),
            F.lit("Clinic").alias("taxonomy_1"),
            *_address_fields("s_suppkey", " Main St"),
        )
    )
    people = (
        read(spark, sf_dir, "customer")
        .where(F.col("c_custkey") % 13 != 0)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _npi(PERSON_NPI_BASE, "c_custkey").alias("npi"),
            F.lit("1").alias("entity_type"),
            F.lit(None).cast("string").alias("org_name"),
            F.col("c_mktsegment").alias("first_name"),
            F.when(F.col("c_custkey") % 11 != 0, F.col("c_name")).alias("last_name"),
            F.when(F.col("c_custkey") % 2 == 0, F.lit("MD")).otherwise(F.lit("NP")).alias("credentials"),
            F.col("c_mktsegment").alias("taxonomy_1"),
            *_address_fields("c_custkey", " Oak Ave"),
        )
    )
    return schemas.conform(orgs.unionByName(people), schemas.REGISTRY, "provider_registry")


def brand_number(brand: str = "p_brand") -> F.Column:
    return F.substring(F.col(brand), 7, 10).cast("int")


def code_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = F.array(*[F.lit(c) for c in TEST_CATEGORIES])
    ref = (
        read(spark, sf_dir, "part")
        .select("p_brand")
        .where(brand_number() <= MAX_TRACKED_BRAND)
        .distinct()
        .select(
            F.col("p_brand").alias("code"),
            F.element_at(categories, (brand_number() % 7 + 1)).alias("category"),
            F.concat(F.lit("Procedure "), F.col("p_brand")).alias("description"),
        )
    )
    return schemas.conform(ref, schemas.CODE_REFERENCE, "code_reference")


def code_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 'annual code file' for keyword search: one code per part."""
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("code"),
        F.concat_ws(" ", F.col("p_name"), F.col("p_type")).alias("description"),
    )


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.conform(_lines(spark, sf_dir, paid_first=True), schemas.CLAIM_LINES, "claim_lines")


def landed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim lines with the line number that the publisher gives them."""
    return _lines(spark, sf_dir, paid_first=False)


def _lines(spark: SparkSession, sf_dir: str, paid_first: bool) -> DataFrame:
    """``paid_first``: the amount goes through the joins' shuffles, not price and discount. Where the line
    id takes the price along anyway, the discount is the smaller one to add."""
    paid = (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).cast("decimal(18,4)").alias("paid")
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate",
        paid if paid_first else "l_discount",
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    return joined.select(
        # Order and line number repeat in the test table; with all other columns a line is told apart.
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice").alias("line_id"),
        _npi(ORG_NPI_BASE, "l_suppkey").alias("billing_npi"),
        F.when(
            F.col("l_linenumber") != 7,
            (F.lit(PERSON_NPI_BASE) + F.col("l_partkey") % SERVICING_POOL).cast("string"),
        ).alias("servicing_npi"),
        F.col("p_brand").alias("code"),
        F.when(F.col("l_orderkey") % 97 != 0, F.date_format("l_shipdate", "yyyy-MM")).alias("month"),
        F.round(F.col("l_quantity")).cast("bigint").alias("claims"),
        F.col("o_custkey").cast("string").alias("beneficiary_id"),
        "paid" if paid_first else paid,
    )


def in_arrivals(lines: DataFrame) -> DataFrame:
    """All lines in three arrivals (``arrival``), by year. Some lines of an arrival's last month come one
    arrival late, some of the first year come with the last arrival, some come twice."""
    year, part = F.substring("month", 1, 4), F.pmod(F.xxhash64("line_id"), F.lit(10))
    due = F.when(year <= "1994", 0).when(year <= "1996", 1).otherwise(2)
    at_end = F.col("month").isin("1994-12", "1996-12")
    due = F.when(at_end & (part == 1), due + 1).when((year <= "1993") & (part == 2), 2).otherwise(due)
    twice = (part == 3) & (due < 2)
    return lines.withColumn("arrival", F.explode(F.when(twice, F.array(due, due + 1)).otherwise(F.array(due))))


def arrivals(lines: DataFrame) -> list[DataFrame]:
    """The three arrivals of :func:`in_arrivals`, one by one; lines that have their arrival already keep it."""
    dealt = lines if "arrival" in lines.columns else in_arrivals(lines)
    return [dealt.where(F.col("arrival") == k).drop("arrival") for k in range(3)]


def claims_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.monthly_rollup(claim_lines(spark, sf_dir))


def claims_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    enriched = prep.enrich_claims(claims_monthly(spark, sf_dir), registry(spark, sf_dir))
    return schemas.conform(enriched, schemas.CLAIMS, "claims_enriched")
