"""Publication: months split over batches, releases, and the summary kept in step with the fact."""

from __future__ import annotations

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimscope.plans import prep, reports
from claimscope.sources import schemas, testtables, warehouse
from claimscope.sources.loaders import Tables, load_claims
from claimscope.streaming import publish
from conftest import SF001, reg


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def month_rows(*cells):
    """(billing, servicing, code, month, claims[, release]) -> landed rows."""
    return [(b, s, c, m, n, n // 2, n * 10, *rest) for b, s, c, m, n, *rest in cells]


class Publication:
    def __init__(self, spark, base, registry, fact=None):
        self.spark, self.root, self.registry, self.fact, self.n = spark, str(base / "pub"), registry, fact, 0

    def batch(self, *cells, n=None):
        names = schemas.CLAIMS_MONTHLY.fieldNames() + ["release"] * (len(cells[0]) > 5)
        typed = ", ".join(f"{x} {'string' if k < 4 else 'long'}" for k, x in enumerate(names))
        df = self.spark.createDataFrame(month_rows(*cells), typed)
        df = df.withColumn("total_paid", F.col("total_paid").cast(schemas.MONEY))
        publish.write_batch(df, self.n if n is None else n, self.registry, self.root, fact=self.fact)
        self.n += n is None
        self.in_step()
        return {(r["billing_npi"], r["month"]): r["total_claims"] for r in self.claims().collect()}

    def claims(self):
        return publish.load_published(self.spark, self.root, self.fact)

    def in_step(self):
        base = prep.provider_summary(self.fact) if self.fact is not None else None
        kept = publish.load_summary(self.spark, self.root, base)
        built = schemas.conform(prep.provider_summary(self.claims()), schemas.SUMMARY, "s")
        assert rows(schemas.conform(kept, schemas.SUMMARY, "s")) == rows(built)


@pytest.fixture
def registry(make):
    return make.registry([reg(str(k), state=f"S{k % 3}") for k in range(1, 7)])


def test_month_in_two_batches_of_one_release_is_whole(spark, tmp_path, registry):
    p = Publication(spark, tmp_path, registry)
    p.batch(("1", None, "A", "2020-01", 20, 1), ("2", "5", "A", "2020-01", 30, 1), ("3", "5", "A", "2020-02", 30, 1))
    got = p.batch(("4", "5", "A", "2020-01", 40, 1), ("2", "5", "A", "2020-01", 35, 1))
    # Row 2 came again: it replaces itself. Row 1 stays, February is untouched.
    assert got == {("1", "2020-01"): 20, ("2", "2020-01"): 35, ("4", "2020-01"): 40, ("3", "2020-02"): 30}
    # A row that comes again below the publishing limit goes; a third part is added.
    got = p.batch(("4", "5", "A", "2020-01", 3, 1), ("5", None, "A", "2020-01", 50, 1), ("5", None, "A", "2020-01", 50, 1))
    assert got == {("1", "2020-01"): 20, ("2", "2020-01"): 35, ("5", "2020-01"): 50, ("3", "2020-02"): 30}


def test_later_release_replaces_and_older_is_ignored(spark, tmp_path, registry):
    p = Publication(spark, tmp_path, registry)
    p.batch(("1", None, "A", "2020-01", 20, 1), ("2", None, "A", "2020-01", 30, 1), ("1", None, "A", None, 15, 1))
    got = p.batch(("2", None, "A", "2020-01", 99, 2))
    assert got == {("2", "2020-01"): 99, ("1", None): 15}
    got = p.batch(("1", None, "A", "2020-01", 77, 1), ("1", None, "A", "2021-05", 44, 1))
    assert got == {("2", "2020-01"): 99, ("1", None): 15, ("1", "2021-05"): 44}
    got = p.batch(("3", None, "A", "2020-01", 12, 2), ("6", None, "A", None, 21, 1))
    assert got == {("2", "2020-01"): 99, ("3", "2020-01"): 12, ("1", None): 15, ("6", None): 21, ("1", "2021-05"): 44}
    # Suppressed whole: the month goes, from the summary too.
    assert ("2", "2020-01") not in p.batch(("2", None, "A", "2020-01", 1, 3))


def test_replay_and_crash_before_the_list(spark, tmp_path, registry):
    p = Publication(spark, tmp_path, registry)
    p.batch(("1", None, "A", "2020-01", 20, 1))
    second = [("2", None, "A", "2020-01", 30, 1), ("2", None, "A", "2020-03", 30, 1)]
    got = p.batch(*second)
    assert p.batch(*second, n=1) == got  # written again
    # Data without its line in the list of months is not seen.
    publish.storage.drop(spark, f"{p.root}/months/batch=1")
    assert {r["billing_npi"] for r in p.claims().collect()} == {"1"}
    p.in_step()
    assert p.batch(*second, n=1) == got


def test_onto_a_batch_written_fact(spark, tmp_path, registry, make):
    monthly = spark.createDataFrame(month_rows(("1", None, "A", "2020-01", 20), ("1", None, "A", "2020-02", 25), ("2", "3", "B", "2019-02", 40), ("2", "3", "B", None, 40)),
                                    "billing_npi string, servicing_npi string, code string, month string, total_claims long, total_unique_beneficiaries long, total_paid long")
    prep.write_claims(publish.publish(monthly.withColumn("total_paid", F.col("total_paid").cast(schemas.MONEY)), registry), str(tmp_path / "fact"))
    fact = load_claims(spark, str(tmp_path / "fact"))
    p = Publication(spark, tmp_path, registry, fact)
    got = p.batch(("4", None, "A", "2020-02", 60))
    assert got == {("1", "2020-01"): 20, ("4", "2020-02"): 60, ("2", "2019-02"): 40, ("2", None): 40}
    got = p.batch(("5", None, "A", None, 60))
    assert got[("5", None)] == 60 and ("2", None) not in got
    # Reports take the summary in place of the fact.
    t = Tables(fact, make.ref([("A", "Cat", "x"), ("B", "Cat", "y")]), registry, prep.provider_summary(fact))
    now = publish.published_tables(spark, p.root, t)
    grain = now.claims_for("billing_npi", "code", "practice_state", "claim_year")
    assert grain is now.summary and "month" not in grain.columns
    assert rows(reports.yearly(grain, now.reference)) == rows(reports.yearly(now.claims, now.reference))
    assert rows(reports.state_overview(grain)) == rows(reports.state_overview(now.claims))


def test_stream_of_releases_keeps_the_summary(spark, tmp_path):
    t = warehouse.open_test_tables(spark, SF001)
    landing, root, ck = (str(tmp_path / n) for n in ("landing", "pub", "ck"))
    fact = prep.suppress(t.claims.where("claim_year <= '1994'"))
    prep.write_claims(fact, str(tmp_path / "fact"))
    fact = load_claims(spark, str(tmp_path / "fact"))
    monthly = testtables.claims_monthly(spark, SF001)
    late = monthly.where("month > '1994-06' or month is null")
    half = F.pmod(F.xxhash64("billing_npi"), F.lit(2)) == 0
    for part in (late.where(half), late.where(~half)):
        part.write.mode("append").parquet(f"{landing}/release=1")
        publish.start_publication(spark, landing, t.registry, root, ck, fact=fact, releases=True).awaitTermination()
        kept = publish.load_summary(spark, root, prep.provider_summary(fact))
        assert rows(kept) == rows(schemas.conform(prep.provider_summary(publish.load_published(spark, root, fact)), schemas.SUMMARY, "s"))
    want = prep.suppress(t.claims)
    assert rows(publish.load_published(spark, root, fact)) == rows(want)


def test_a_batch_reads_only_the_years_it_touches(spark, tmp_path, registry, make):
    fact_path = str(tmp_path / "fact")
    prep.write_claims(make.claims([("1", None, "A", f"20{y}-01", 20, 2, Decimal(1), "S1", f"20{y}") for y in range(10, 20)]), fact_path)
    fact = load_claims(spark, fact_path)
    seen = []
    old = prep.provider_summary

    def spy(df, *a):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return old(df, *a)

    prep.provider_summary = spy
    try:
        df = make.claims([("1", None, "A", "2015-03", 50, 2, Decimal(1), "S1", "2015")]).select(*schemas.CLAIMS_MONTHLY.fieldNames())
        publish.write_batch(df, 0, registry, str(tmp_path / "pub"), fact=fact)
    finally:
        prep.provider_summary = old
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", seen[0])
    assert any("claim_year" in f and "2015" in f for f in filters), seen[0]
