"""Incremental publication of monthly claim files into the warehouse, summaries included.

Each new monthly rollup file dropped into a landing folder is suppressed, enriched with
the billing provider's practice state (``plans.prep``) and published by a Structured
Streaming query. A micro-batch is written as plain Parquet to folders keyed by its batch
id, so a replayed batch overwrites itself and adds nothing, and nothing that a batch job
wrote is hidden.

**Releases.** Rows belong to a release of their month. A later release replaces the month; rows
of one release add up, in however many micro-batches they arrive, and a row that comes again
in a release replaces itself. A batch that holds part of a month therefore writes the whole
month: the rows that earlier batches hold of the same release, and its own. Files in
``landing/release=R/`` have release R; plain files make each micro-batch a release, which must
then hold whole months. Rows of a release older than the published one are ignored.

**Summaries.** Every batch also writes the yearly provider summary of the years it touches, from
the fact as it stands after the batch: one year's partition is read, not the whole fact.

Readers take each month, and each year of the summary, from the last batch that holds it, and
from the batch-written fact and its summary where no batch does. What a batch holds is listed
in ``months``, written last: before that, none of it is seen.

Layout under the publication root::

    claims/batch=N/claim_year=Y/    the published rows, clustered like the fact
    summary/batch=N/claim_year=Y/   the provider summary of the years touched
    months/batch=N/                 month, year and release of what the batch holds
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from claimscope.functions.scalars import year_of
from claimscope.plans import prep
from claimscope.sources import schemas, storage
from claimscope.sources.loaders import Tables

BATCH = T.StructField("batch", T.LongType())
RELEASE = T.StructField("release", T.LongType())
MONTHS = T.StructType([T.StructField("month", T.StringType()), T.StructField("year", T.StringType()), RELEASE])
ROW_KEY = ("billing_npi", "servicing_npi", "code", "month")


def monthly_stream(spark: SparkSession, landing: str, releases: bool = False) -> DataFrame:
    """Landed rows; with ``releases`` the files lie in ``release=R`` folders."""
    schema = T.StructType([*schemas.CLAIMS_MONTHLY.fields, RELEASE]) if releases else schemas.CLAIMS_MONTHLY
    return spark.readStream.schema(schema).parquet(landing)


def publish(monthly: DataFrame, registry: DataFrame,
            min_claims: int = prep.SUPPRESSION_MIN_CLAIMS) -> DataFrame:
    """Suppress small cells, then enrich."""
    enriched = prep.enrich_claims(prep.suppress(monthly, min_claims), registry)
    return schemas.conform(enriched, schemas.CLAIMS, "claims")


def _batches(spark: SparkSession, root: str, name: str, schema: T.StructType, before: int | None) -> DataFrame:
    """Rows of all batches, or of those before one, with their batch id."""
    if not storage.exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], T.StructType([*schema.fields, BATCH]))
    rows = spark.read.schema(T.StructType([*schema.fields, BATCH])).parquet(f"{root}/{name}")
    return rows if before is None else rows.where(F.col("batch") < before)


def _last(listed: DataFrame, key: str) -> DataFrame:
    """(m, b): the last batch that holds each month or year."""
    return listed.groupBy(F.col(key).alias("m")).agg(F.max("batch").alias("b"))


def _held(key: str):
    return F.col(key).eqNullSafe(F.col("m"))


def _same_row(left: DataFrame, right: DataFrame):
    cond = F.lit(True)
    for k in ROW_KEY:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def _months_of(monthly: DataFrame, listed: DataFrame) -> DataFrame:
    """(month, year, release) that the batch publishes: the newest release in it, unless a newer one is out.

    A handful of rows, taken through the driver: they become literals of the plans that follow.
    """
    out = listed.groupBy(F.col("month").alias("m")).agg(F.max("release").alias("r"))
    here = monthly.groupBy("month").agg(F.max("release").alias("release")).join(out, _held("month"), "left")
    here = here.where(F.col("r").isNull() | (F.col("release") >= F.col("r")))
    rows = here.select("month", year_of("month").alias("year"), "release").collect()
    return monthly.sparkSession.createDataFrame(rows, MONTHS)


def _whole_months(monthly: DataFrame, months: DataFrame, listed: DataFrame, claims: DataFrame, registry: DataFrame,
                  min_claims: int) -> DataFrame:
    """Published rows of every month of the batch, with what earlier batches hold of the same release."""
    wanted = F.broadcast(months.select(F.col("month").alias("m"), F.col("release").alias("r")))
    of_release = _held("month") & (F.col("release") == F.col("r"))
    totals = [f.name for f in schemas.CLAIMS_MONTHLY.fields if f.name not in ROW_KEY]
    # A row that a batch repeats counts once; if its totals differ, the largest stand.
    new = monthly.join(wanted, of_release, "left_semi").groupBy(*ROW_KEY).agg(F.max(F.struct(*totals)).alias("t"))
    new = new.select(*ROW_KEY, "t.*")
    # The last batch of a month holds all of its release so far; rows that come again, suppressed now or not, leave it.
    same = _last(listed.join(wanted, of_release, "left_semi"), "month")
    held = claims.join(same, _held("month") & (F.col("batch") == F.col("b")), "left_semi")
    again = monthly.join(wanted, of_release, "left_semi").select(*ROW_KEY)
    held = held.join(again, _same_row(held, again), "left_anti")
    return publish(new, registry, min_claims).unionByName(held.select(*schemas.CLAIMS.fieldNames()))


def write_batch(monthly: DataFrame, batch_id: int, registry: DataFrame, root: str,
                min_claims: int = prep.SUPPRESSION_MIN_CLAIMS, fact: DataFrame | None = None) -> None:
    """Publish one batch on top of those before it; writing it again replaces it.

    Without a ``release`` column the batch is a release of its own. ``fact`` is the
    batch-written fact that the publications go onto; summaries of a year include it.
    """
    spark = monthly.sparkSession
    if "release" not in monthly.columns:
        monthly = monthly.withColumn("release", F.lit(batch_id).cast("bigint"))
    claims_path, months_path = f"{root}/claims/batch={batch_id}", f"{root}/months/batch={batch_id}"
    storage.drop(spark, months_path)  # a replayed batch is not seen until it is whole again
    listed = _batches(spark, root, "months", MONTHS, before=batch_id)
    claims = _batches(spark, root, "claims", schemas.CLAIMS, before=batch_id)
    months = _months_of(monthly, listed)
    prep.write_claims(_whole_months(monthly, months, listed, claims, registry, min_claims), claims_path)

    # The years touched, as literals: the fact's other year partitions are not read.
    years = {r["year"] for r in months.collect()}
    in_year = F.col("claim_year").isin([y for y in years if y is not None])
    in_year = in_year | F.col("claim_year").isNull() if None in years else in_year
    before = load_published(spark, root, fact, before=batch_id).where(in_year)
    kept = before.join(F.broadcast(months.select(F.col("month").alias("m"))), _held("month"), "left_anti")
    summary = prep.provider_summary(kept.unionByName(_read_rows(spark, claims_path)))
    prep.write_claims(schemas.conform(summary, schemas.SUMMARY, "provider_summary"), f"{root}/summary/batch={batch_id}")
    months.coalesce(1).write.mode("overwrite").parquet(months_path)


def _read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CLAIMS).parquet(path).select(*schemas.CLAIMS.fieldNames())


def start_publication(spark: SparkSession, landing: str, registry: DataFrame, root: str,
                      checkpoint: str, available_now: bool = True,
                      min_claims: int = prep.SUPPRESSION_MIN_CLAIMS, fact: DataFrame | None = None,
                      releases: bool = False) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what has landed, then stops.

    The registry is read anew, and its join planned anew, in every micro-batch.
    """
    writer = monthly_stream(spark, landing, releases).writeStream.foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, registry, root, min_claims, fact)
    ).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def load_published(spark: SparkSession, root: str, fact: DataFrame | None = None, before: int | None = None) -> DataFrame:
    """The fact with all publications under ``root`` applied (or those before a batch)."""
    rows = _batches(spark, root, "claims", schemas.CLAIMS, before)
    last = _last(_batches(spark, root, "months", MONTHS, before), "month")
    published = rows.join(last, _held("month") & (F.col("batch") == F.col("b")), "left_semi")
    published = published.select(*schemas.CLAIMS.fieldNames())
    if fact is None:
        return published
    kept = fact.join(last, _held("month"), "left_anti")
    return kept.select(*schemas.CLAIMS.fieldNames()).unionByName(published)


def load_summary(spark: SparkSession, root: str, base: DataFrame | None = None) -> DataFrame:
    """The yearly provider summary of :func:`load_published`; ``base`` is the old fact's summary.

    Valid if the batches were written with the same ``fact`` that ``base`` summarises.
    """
    names = schemas.SUMMARY.fieldNames()
    rows = _batches(spark, root, "summary", schemas.SUMMARY, None)
    last = _last(_batches(spark, root, "months", MONTHS, None), "year")
    summary = rows.join(last, _held("claim_year") & (F.col("batch") == F.col("b")), "left_semi").select(*names)
    if base is None:
        return summary
    return base.join(last, _held("claim_year"), "left_anti").select(*names).unionByName(summary)


def published_tables(spark: SparkSession, root: str, tables: Tables) -> Tables:
    """``tables`` with all publications applied to the fact and to the provider summary."""
    summary = load_summary(spark, root, tables.summary) if tables.summary is not None else None
    return Tables(load_published(spark, root, tables.claims), tables.reference, tables.registry, summary)
