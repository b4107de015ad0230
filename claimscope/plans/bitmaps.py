"""Exact distinct billing providers from mergeable bitmaps, without the provider grain.

Billing providers get dense numbers, those of one practice state next to each other. A cell
(code x state x month) keeps a bitmap of its providers beside its sums, in rows per bucket of
32,768 numbers. Any coarser report merges bitmaps by OR and counts bits: providers that bill in
several codes or months count once, as COUNT(DISTINCT) over the fact would.

A cell touches the few buckets of its state's providers, so the table grows with cells, not
with providers times cells, and its bitmaps end at their last set byte. A cell's rows of one
bucket (at most 32,768 providers) meet in one task. Numbering ranks within hashed parts of a state, and only the parts' sizes
(states x PARTS rows) are added up in one place.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope.functions import measures
from claimscope.operators import filters as flt
from claimscope.operators.filters import ClaimsFilter
from claimscope.operators.joins import with_reference
from claimscope.plans.reports import MEASURES, NO_FILTER, _by_claims, sorted_small
from claimscope.sources.schemas import MONEY

ORDER = ("claim_year", "practice_state", "code", "month", "bucket")
CELL = ("code", "practice_state", "month", "claim_year")
SUMS = ("total_claims", "total_unique_beneficiaries", "total_paid")
#: Hashed parts of a state's providers that are ranked side by side.
PARTS = 64


def provider_numbers(claims: DataFrame) -> DataFrame:
    """(billing_npi, number): numbers 1 to P without gaps, ascending by practice state."""
    npis = claims.groupBy("billing_npi").agg(F.min("practice_state").alias("home"))
    npis = npis.withColumn("part", F.pmod(F.xxhash64("billing_npi"), F.lit(PARTS)))
    ranked = npis.withColumn("rank", F.row_number().over(Window.partitionBy("home", "part").orderBy("billing_npi")))
    sizes = npis.groupBy(F.col("home").alias("h"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("h", "p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("h", "p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    numbered = ranked.join(offsets, F.col("home").eqNullSafe(F.col("h")) & (F.col("part") == F.col("p")))
    return numbered.select("billing_npi", (F.col("offset") + F.col("rank")).alias("number"))


def provider_cells(claims: DataFrame, numbers: DataFrame) -> DataFrame:
    """CELL, bucket, providers (bitmap), sums: one row per cell and bucket of provider numbers.

    A bitmap under construction has 4 KB whatever it holds. So a cell's rows meet first, dealt by
    the order that the cells are written in, and no bitmap is made per cell and task, shuffled
    and sorted. A provider sets its bit as often as it has rows in the cell.
    """
    numbered = claims.select("billing_npi", *CELL, *SUMS).join(numbers, "billing_npi")
    dealt = numbered.withColumn("bucket", F.bitmap_bucket_number("number")).repartitionByRange(*ORDER)
    at = F.bitmap_bit_position("number")
    cells = dealt.groupBy(*CELL, "bucket").agg(
        F.bitmap_construct_agg(at).alias("bits"), F.max(at).alias("last"),
        *(F.sum(c).alias(c) for c in SUMS[:2]), F.sum("total_paid").cast(MONEY).alias("total_paid"),
    )
    providers = F.substring("bits", F.lit(1), (F.col("last") / 8).cast("int") + 1).alias("providers")
    return cells.select(*CELL, "bucket", providers, *SUMS)


def write_cells(cells: DataFrame, path: str) -> None:
    """Partitioned by year and clustered by state and code, like the fact; :func:`provider_cells` dealt the rows so."""
    cells.sortWithinPartitions(*ORDER).write.partitionBy("claim_year").option("compression", "zstd").parquet(path)


def load_cells(spark, path: str) -> DataFrame:
    schema = (
        "code string, practice_state string, month string, bucket long, providers binary, total_claims long, "
        "total_unique_beneficiaries long, total_paid decimal(18,2), claim_year string"
    )
    return spark.read.schema(schema).parquet(path)


def _merged(cells: DataFrame, providers: str, *keys: str) -> DataFrame:
    """The four measures by ``keys``: bitmaps merged per bucket, then bits counted."""
    by_bucket = cells.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("providers").alias("bits"), *(F.sum(c).alias(c) for c in SUMS))
    return by_bucket.groupBy(*keys).agg(
        F.sum(F.bitmap_count("bits")).alias(providers),
        measures.total_claims(), measures.total_beneficiaries(), measures.total_paid(),
    )


def _service_cells(cells: DataFrame, ref: DataFrame, filt: ClaimsFilter) -> DataFrame:
    tracked = flt.select_codes(ref, filt.category, filt.codes).select("code", "category")
    return flt.claim_filters(cells, filt).join(tracked, "code")


def state_overview(cells: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    kept = flt.by_years(flt.by_states(flt.known_state(cells), filt.states), filt.years)
    out = _merged(kept.withColumnRenamed("practice_state", "state"), "total_providers", "state")
    return _by_claims(out, "total_claims", "state")


def category_summary(cells: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    return _by_claims(_merged(_service_cells(cells, ref, filt), "providers", "category"), "total_claims", "category")


def category_state(cells: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    kept = _service_cells(cells, ref, filt).withColumnRenamed("practice_state", "state")
    return _by_claims(_merged(kept, "providers", "category", "state"), "total_claims", "category", "state")


def code_detail(cells: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    """Merged by code, labelled afterwards."""
    codes = flt.select_codes(ref, filt.category, filt.codes)
    kept = flt.claim_filters(cells, filt).join(codes.select("code").distinct(), "code", "left_semi")
    out = with_reference(_merged(kept, "providers", "code"), codes)
    out = out.select(F.col("code").alias("hcpcs_code"), "category", "description", *MEASURES)
    return _by_claims(out, "total_claims", "hcpcs_code", "category")


def _trend(cells: DataFrame, ref: DataFrame, filt: ClaimsFilter, key: str) -> DataFrame:
    """Every year and tracked code: only the state filter applies."""
    kept = _service_cells(cells, ref, replace(filt.without_years(), category=None, codes=()))
    kept = kept.withColumnRenamed("claim_year", "year")
    return sorted_small(_merged(kept, "providers", key), F.col(key).asc_nulls_last())


def monthly(cells: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    return _trend(cells, ref, filt, "month")


def yearly(cells: DataFrame, ref: DataFrame, filt: ClaimsFilter = NO_FILTER) -> DataFrame:
    return _trend(cells, ref, filt, "year")
