"""Eager aggregation vs join-then-group, warehouse build, streaming publication."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from claimscope.functions import measures
from claimscope.functions.scalars import billing_name, servicing_name
from claimscope.operators.filters import ClaimsFilter
from claimscope.operators.joins import with_billing, with_servicing
from claimscope.plans import directory as dirs
from claimscope.plans import prep, reports
from claimscope.sources import testtables, warehouse
from claimscope.sources.loaders import load_claims
from claimscope.streaming import publish
from conftest import SF01, SF001

FILT = ClaimsFilter(states=["NATION_1", "NATION_2"])


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def t(spark):
    return warehouse.open_test_tables(spark, SF01)


SHOWN = ("npi", "entity_type", "provider_name", "credentials", "taxonomy", "address", "city", "state", "zip", "phone")
MEASURED = ("category", "total_claims", "total_unique_beneficiaries", "total_paid")


def sums():
    return measures.total_claims("total_hiv_claims"), measures.total_beneficiaries(), measures.total_paid()


def test_eager_billing_equals_join_then_group(t):
    base = with_billing(reports.service_base(t.claims, t.reference, FILT), t.registry)
    shown = base.select(
        F.col("billing_npi").alias("npi"), F.col("b_entity_type").alias("entity_type"),
        billing_name("b_org_name", "b_first_name", "b_last_name").alias("provider_name"),
        F.col("b_credentials").alias("credentials"), F.col("b_taxonomy_1").alias("taxonomy"),
        F.col("b_address").alias("address"), F.col("b_city").alias("city"), F.col("b_state").alias("state"),
        F.col("b_zip").alias("zip"), F.col("b_phone").alias("phone"), *MEASURED,
    )
    plain = shown.groupBy(*SHOWN).agg(*measures.served_categories(), *sums())
    eager = dirs.directory(t.claims, t.reference, t.registry, FILT, "billing")
    assert _rows(eager) == _rows(plain.select(*eager.columns))


def test_eager_servicing_equals_join_then_group(t):
    base = with_servicing(reports.service_base(t.claims, t.reference, FILT), t.registry)
    shown = base.select(
        F.col("servicing_npi").alias("npi"), F.col("s_entity_type").alias("entity_type"),
        servicing_name("s_entity_type", "s_org_name", "s_first_name", "s_last_name").alias("provider_name"),
        F.col("s_credentials").alias("credentials"), F.col("s_taxonomy_1").alias("taxonomy"),
        F.col("s_address").alias("address"), F.col("s_city").alias("city"), F.col("s_state").alias("state"),
        F.col("s_zip").alias("zip"), F.col("s_phone").alias("phone"), *MEASURED,
    )
    plain = shown.groupBy(*SHOWN).agg(*measures.served_categories(), *sums())
    eager = dirs.directory(t.claims, t.reference, t.registry, FILT, "servicing")
    rows = _rows(eager)
    assert rows == _rows(plain.select(*eager.columns))
    assert len(rows) == 151 and sum(r[2] == "Unknown" for r in rows) == 25  # FIXTURES expectation


def test_fresh_build_and_pointer(spark):
    home = f"{warehouse.scratch_root(spark)}/claimscope/test-build/{uuid.uuid4().hex[:8]}"
    folder = warehouse.build(spark, SF001, home)
    assert spark.read.text(f"{home}/_current").first()[0] == folder
    built = load_claims(spark, f"{folder}/claims")
    derived = testtables.claims_enriched(spark, SF001)
    assert built.count() == derived.count()
    assert built.exceptAll(derived).isEmpty()


def _published(spark, tmp_path, landing, fact=None):
    registry = testtables.registry(spark, SF001)
    q = publish.start_publication(spark, landing, registry, str(tmp_path / "pub"), str(tmp_path / "ck"))
    q.awaitTermination()
    return publish.load_published(spark, str(tmp_path / "pub"), fact)


def test_stream_publication_onto_batch_written_fact(spark, tmp_path):
    monthly = testtables.claims_monthly(spark, SF001)
    batch = publish.publish(monthly, testtables.registry(spark, SF001))
    early = F.col("claim_year") <= "1996"
    prep.write_claims(batch.where(early), str(tmp_path / "fact"))
    fact = load_claims(spark, str(tmp_path / "fact"))
    landing = str(tmp_path / "landing")
    year = F.substring("month", 1, 4)
    monthly.where((year > "1996") | year.isNull()).write.parquet(landing)
    got = _published(spark, tmp_path, landing, fact)
    assert got.count() == batch.count() and got.exceptAll(batch).isEmpty()
    # A second run over the same landing folder adds nothing.
    again = _published(spark, tmp_path, landing, fact)
    assert again.count() == batch.count() and again.exceptAll(batch).isEmpty()
    # A month landed again under a new name counts once, also one of the batch-written year.
    monthly.where(F.col("month").isin("1997-03", "1995-02")).write.mode("append").parquet(landing)
    third = _published(spark, tmp_path, landing, fact)
    assert third.count() == batch.count() and third.exceptAll(batch).isEmpty()
    # A summary of the published fact agrees with it.
    s = prep.provider_summary(third)
    ref = testtables.code_reference(spark, SF001)
    assert _rows(reports.yearly(s, ref)) == _rows(reports.yearly(third, ref))


def test_replayed_batch_adds_nothing_and_a_suppressed_month_goes(spark, tmp_path):
    monthly = testtables.claims_monthly(spark, SF001)
    registry, root = testtables.registry(spark, SF001), str(tmp_path / "pub")
    one = monthly.where("month = '1997-03'")
    publish.write_batch(one, 0, registry, root)
    publish.write_batch(one, 0, registry, root)
    n = publish.publish(one, registry).count()
    assert publish.load_published(spark, root).count() == n > 0
    publish.write_batch(one.withColumn("total_claims", F.lit(1).cast("bigint")), 1, registry, root)
    assert publish.load_published(spark, root).count() == 0


def test_rollup_suppression_counts(spark):
    monthly = testtables.claims_monthly(spark, SF01)
    assert monthly.count() == 59711
    kept = prep.suppress(monthly)
    assert kept.count() == 46452
    assert kept.agg(F.sum("total_claims")).first()[0] == 1444075
