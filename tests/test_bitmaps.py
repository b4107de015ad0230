"""Distinct providers from bitmaps equal COUNT(DISTINCT) over the fact."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimscope.operators.filters import ClaimsFilter
from claimscope.plans import bitmaps, reports
from claimscope.sources.warehouse import open_test_tables
from conftest import SF001, claim

FILTERS = (
    ClaimsFilter(),
    ClaimsFilter(states=["NATION_1", "NATION_12"], years=["1996", "1997"]),
    ClaimsFilter(category="Outreach"),
    ClaimsFilter(codes=("Brand#3", "Brand#10"), years=["1995"]),
    ClaimsFilter(states=["nowhere"]),
)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    t = open_test_tables(spark, SF001)
    path = str(tmp_path_factory.mktemp("bitmaps") / "cells")
    bitmaps.write_cells(bitmaps.provider_cells(t.claims, bitmaps.provider_numbers(t.claims)), path)
    return t, bitmaps.load_cells(spark, path)


def test_numbers_are_dense_and_ordered_by_state(made):
    t, _ = made
    numbers = bitmaps.provider_numbers(t.claims).collect()
    assert sorted(r["number"] for r in numbers) == list(range(1, t.claims.select("billing_npi").distinct().count() + 1))
    home = {r["billing_npi"]: r["practice_state"] or "" for r in t.claims.select("billing_npi", "practice_state").distinct().collect()}
    states = [home[r["billing_npi"]] for r in sorted(numbers, key=lambda r: r["number"])]
    assert states == sorted(states)


@pytest.mark.parametrize("filt", FILTERS, ids=str)
def test_reports_equal_those_over_the_fact(made, filt):
    t, cells = made
    assert rows(bitmaps.state_overview(cells, filt)) == rows(reports.state_overview(t.claims, filt))
    for name in ("category_summary", "category_state", "code_detail", "monthly", "yearly"):
        got, want = getattr(bitmaps, name)(cells, t.reference, filt), getattr(reports, name)(t.claims, t.reference, filt)
        assert got.columns == want.columns and rows(got) == rows(want), name
        assert [f.dataType for f in got.schema] [:2] == [f.dataType for f in want.schema][:2]


def test_more_providers_than_one_bucket(spark, make, monkeypatch):
    """80,000 providers in two states: buckets meet inside a state, bitmaps end at the last byte."""
    i = F.col("id")
    claims = spark.range(160_000).select(
        F.concat(F.lit("N"), i % 80_000).alias("billing_npi"), F.lit(None).cast("string").alias("servicing_npi"),
        F.concat(F.lit("C"), i % 3).alias("code"), F.format_string("2020-%02d", (i % 2 + 1).cast("int")).alias("month"),
        F.lit(1).cast("long").alias("total_claims"), F.lit(1).cast("long").alias("total_unique_beneficiaries"),
        F.lit(1).cast("decimal(18,2)").alias("total_paid"),
        F.when(i % 80_000 < 50_000, "S1").otherwise("S2").alias("practice_state"), F.lit("2020").alias("claim_year"),
    )
    cells = bitmaps.provider_cells(claims, bitmaps.provider_numbers(claims)).cache()
    assert {r["state"]: r["total_providers"] for r in bitmaps.state_overview(cells).collect()} == {"S1": 50_000, "S2": 30_000}
    spans = cells.groupBy("practice_state").agg(F.collect_set("bucket").alias("b")).collect()
    assert {r["practice_state"]: sorted(r["b"]) for r in spans} == {"S1": [1, 2], "S2": [2, 3]}
    assert cells.agg(F.max(F.octet_length("providers"))).first()[0] <= 4096
    cells.unpersist()


def test_hot_provider_and_unknown_state(make):
    r = random.Random(3)
    claims = [claim("hot" if k % 3 == 0 else f"b{r.randrange(40)}", f"C{k % 4}", f"202{k % 2}-0{k % 5 + 1}" if k % 11 else None,
                    state=None if k % 13 == 0 else f"S{k % 3}", servicing=f"x{k}") for k in range(900)]
    fact, ref = make.claims(claims), make.ref([("C0", "A", "d"), ("C1", "B", "d"), ("C1", "A", "d"), ("C3", None, None)])
    cells = bitmaps.provider_cells(fact, bitmaps.provider_numbers(fact))
    assert cells.count() <= len({(c[2], c[7], c[3]) for c in claims})
    assert rows(bitmaps.state_overview(cells)) == rows(reports.state_overview(fact))
    for name in ("category_summary", "category_state", "code_detail", "monthly", "yearly"):
        assert rows(getattr(bitmaps, name)(cells, ref)) == rows(getattr(reports, name)(fact, ref)), name


def test_no_fact(make):
    none = make.claims([])
    cells = bitmaps.provider_cells(none, bitmaps.provider_numbers(none))
    assert rows(bitmaps.state_overview(cells)) == [] == rows(bitmaps.yearly(cells, make.ref([])))


def test_plan_pre_aggregates(made):
    _, cells = made
    p = bitmaps.state_overview(cells)._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_or_agg" in p and p.index("partial_bitmap_or_agg") > p.rindex("Exchange hashpartitioning")
    assert "billing_npi" not in p
