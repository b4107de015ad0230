"""Data preparation ahead of the reports, as Spark jobs.

monthly rollup -> small-cell suppression -> enrichment (practice state, year)
-> partitioned warehouse table; plus the code-selection steps that produce
the code reference: keyword search over a code file and a rule crosswalk.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.operators import ngrams
from claimscope.operators.joins import enrich
from claimscope.sources import schemas
from claimscope.sources.schemas import MONEY

# Rows with fewer total claims than this are withheld by the
# publisher (a row with exactly 12 is kept).
SUPPRESSION_MIN_CLAIMS = 12

# Keywords the code file is searched for.
DEFAULT_KEYWORDS = ("HIV", "antiretroviral", "PrEP", "viral load", "CD4", "opportunistic infection")

NPI_COLUMNS = ("billing_npi", "servicing_npi")

FACT_ORDER = ("claim_year", "practice_state", "code", "billing_npi")

ROLLUP_KEYS = ("billing_npi", "servicing_npi", "code", "month")


def monthly_rollup(lines: DataFrame, *also: str) -> DataFrame:
    """Claim lines -> one row per billing x servicing x code x month (``also``: columns that these decide).

    Beneficiaries are distinct within the row only. Spark plans the exact
    distinct count as partial aggregation on (keys, beneficiary) before the
    shuffle, so a provider holding a large share of lines is spread over
    many reducers instead of landing in one task.
    """
    return lines.groupBy(*ROLLUP_KEYS, *also).agg(
        F.sum("claims").cast("bigint").alias("total_claims"),
        F.count_distinct("beneficiary_id").alias("total_unique_beneficiaries"),
        F.round(F.sum("paid"), 2).cast(MONEY).alias("total_paid"),
    )


def suppress(monthly: DataFrame, min_claims: int = SUPPRESSION_MIN_CLAIMS) -> DataFrame:
    """Small-cell suppression: drop rows with fewer than ``min_claims`` claims."""
    return monthly.where(F.col("total_claims") >= F.lit(min_claims))


def enrich_claims(monthly: DataFrame, registry: DataFrame) -> DataFrame:
    """Practice state of the billing provider + claim year (left join)."""
    return enrich(monthly, registry)


def enriched_rollup(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """:func:`monthly_rollup`, enriched, from one shuffle of the lines, which is also the layout of the fact.

    The lines get state and year first (both are decided by the rollup's keys) and are dealt by
    ranges of the fact's order, drawn out by month and servicing NPI. A rollup row's lines have
    all of these in common, so both steps of the rollup and :func:`write_claims` find them
    together. A hot provider is cut by code, month and servicing NPI.
    """
    dealt = enrich(lines, registry).repartitionByRange(*FACT_ORDER, "month", "servicing_npi")
    return monthly_rollup(dealt, "practice_state", "claim_year")


def write_claims(enriched: DataFrame, path: str, mode: str = "overwrite", dealt: bool = False) -> None:
    """Write the fact partitioned by ``claim_year`` and clustered by state within a year.

    Rows are range-partitioned and sorted by (year, state, code, billing NPI): a file
    holds a narrow range of states, so min/max statistics skip files and row groups for a
    state filter, a hot state is split by code and NPI, and a file set does not grow with
    tasks x years. Null years go to the default partition and read back as null.

    Providers lie scattered over these ranges, so each row group has a Bloom filter on the
    NPIs: a lookup of providers skips row groups that hold none of them. Filters take the
    size that the row group's distinct NPIs need. Rows that are ``dealt`` by this order already
    (:func:`enriched_rollup`) are not shuffled again.
    """
    rows = enriched if dealt else enriched.repartitionByRange(*FACT_ORDER)
    writer = rows.sortWithinPartitions(*FACT_ORDER).write.mode(mode).partitionBy("claim_year")
    for npi in NPI_COLUMNS:
        if npi in enriched.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{npi}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def provider_summary(enriched: DataFrame, by_month: bool = False) -> DataFrame:
    """Fact -> billing provider x code x practice state x year (or x month),
    sums only. Sums are additive, so the year grain can be built from the
    month grain. Partial aggregation runs before the shuffle, so the shuffle
    carries at most one row per group per task.
    """
    keys = ["billing_npi", "code", "practice_state"] + (["month"] if by_month else []) + ["claim_year"]
    return enriched.groupBy(*keys).agg(
        F.sum("total_claims").alias("total_claims"),
        F.sum("total_unique_beneficiaries").alias("total_unique_beneficiaries"),
        F.sum("total_paid").cast(schemas.SUMMARY_MONEY).alias("total_paid"),
    )


def keyword_match(text: Column, keywords: Iterable[str]) -> Column:
    """Case-insensitive literal substring match against any keyword."""
    lowered = F.lower(text)
    conds = [lowered.contains(F.lit(k.lower())) for k in keywords]
    if not conds:
        return F.lit(False)
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def keyword_codes(code_file: DataFrame, keywords: Iterable[str] = DEFAULT_KEYWORDS,
                  text_col: str = "description") -> DataFrame:
    """Codes of an annual code file whose description names any keyword."""
    return code_file.where(keyword_match(F.col(text_col), keywords))


def crosswalk(codes: DataFrame, rules: Sequence[tuple[Sequence[str], str]],
              text_col: str = "description", default: str | None = None) -> DataFrame:
    """Assign each code one category: the first rule whose keywords match wins.

    ``rules`` is an ordered list of ``(keywords, category)``. Compiled into
    one ``CASE WHEN`` expression, so it is a projection, not a join.
    """
    expr = None
    for keywords, category in rules:
        cond = keyword_match(F.col(text_col), keywords)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    if expr is None:
        expr = F.lit(default)
    elif default is not None:
        expr = expr.otherwise(F.lit(default))
    return codes.withColumn("category", expr.cast("string"))


def crosswalk_table(codes: DataFrame, rules: DataFrame, text_col: str = "description", default: str | None = None) -> DataFrame:
    """:func:`crosswalk` with the rules as rows (rule, keyword, category), for rule tables of any length.

    A rule has as many rows as keywords; the first matching rule by number wins, ties of
    numbers go to the least category. Instead of one condition per keyword on every code, a
    keyword meets only texts that hold its rarest trigram (a shorter keyword: itself), and is
    then looked for in full. Texts are matched once however many codes share them. A null
    keyword matches nothing, an empty one every text that is not null.
    """
    keyed = rules.where(F.col("keyword").isNotNull()).select(
        F.col("rule").cast("long").alias("rule"), F.lower("keyword").alias("keyword"), F.col("category").cast("string").alias("category")
    )
    texts = codes.where(F.col(text_col).isNotNull()).select(F.lower(text_col).alias("text")).distinct()
    spread = texts.select("text", F.explode(F.concat(F.array(F.lit("")), ngrams.grams(F.col("text"), (1, 2, 3)))).alias("gram"))

    words = keyed.select("keyword").distinct()
    held = ngrams.needle_grams(F.col("keyword"))
    parts = words.select("keyword", F.explode(F.when(F.size(held) > 0, held).otherwise(F.array(F.lit("")))).alias("gram"))
    often = spread.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # A gram that no text has rules its keyword out: no row is left for it below.
    rare = parts.join(often, "gram", "left").groupBy("keyword").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("least")
    )
    keys = rare.select("keyword", F.col("least.gram").alias("gram"))
    met = spread.join(keys, "gram").where(F.col("text").contains(F.col("keyword")))
    first = met.join(keyed, "keyword").groupBy("text").agg(F.min(F.struct("rule", "category")).alias("first"))
    first = first.select(F.col("text").alias("__text"), F.col("first.category").alias("__category"), F.lit(True).alias("__met"))
    told = codes.drop("category") if "category" in codes.columns else codes
    told = told.join(first, F.lower(F.col(text_col)) == F.col("__text"), "left")
    category = F.when(F.col("__met"), F.col("__category")).otherwise(F.lit(default)).cast("string")
    return told.withColumn("category", category).drop("__text", "__category", "__met")
