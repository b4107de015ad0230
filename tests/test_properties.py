"""Invariants between reports under random filters (fixed seed) on sf0.01."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimscope.operators import reshape
from claimscope.operators.filters import ClaimsFilter
from claimscope.plans import reports
from claimscope.sources.warehouse import open_test_tables
from conftest import SF01

STATES = [f"NATION_{i}" for i in range(25)]
YEARS = [str(y) for y in range(1995, 2002)]


def _total(df, col="total_claims"):
    return df.agg(F.coalesce(F.sum(col), F.lit(0))).first()[0]


@pytest.fixture(scope="module")
def t(spark):
    return open_test_tables(spark, SF01)


def _filters(n=4, seed=7):
    rnd = random.Random(seed)
    for _ in range(n):
        yield ClaimsFilter(
            states=rnd.sample(STATES, rnd.randint(0, 4)),
            years=rnd.sample(YEARS, rnd.randint(0, 3)),
        )


def test_no_filter_equals_all(t):
    everything = _total(t.claims.where(F.col("practice_state").isNotNull()))
    assert _total(reports.state_overview(t.claims)) == everything


@pytest.mark.parametrize("filt", list(_filters()))
def test_states_partition_the_total(t, filt):
    whole = _total(reports.state_overview(t.claims, ClaimsFilter(years=filt.years)))
    parts = sum(
        _total(reports.state_overview(t.claims, ClaimsFilter(states=[s], years=filt.years))) for s in STATES
    )
    assert whole == parts


@pytest.mark.parametrize("filt", list(_filters()))
def test_category_state_sums_to_category(t, filt):
    cs = reports.category_state(t.claims, t.reference, filt)
    c = reports.category_summary(t.claims, t.reference, filt)
    by_cat = {r.category: r.s for r in cs.groupBy("category").agg(F.sum("total_claims").alias("s")).collect()}
    assert by_cat == {r.category: r.total_claims for r in c.collect()}
    assert _total(reports.code_detail(t.claims, t.reference, filt)) == _total(c)


@pytest.mark.parametrize("filt", list(_filters(2, seed=11)))
def test_monthly_yearly_pivot_agree(t, filt):
    m = reports.monthly(t.claims, t.reference, filt)
    y = reports.yearly(t.claims, t.reference, filt)
    assert _total(m) == _total(y)
    ct = reports.category_trend(t.claims, t.reference, filt)
    assert _total(ct) == _total(m)
    pivot = reshape.pivot_wide(ct)
    cols = [c for c in pivot.columns if c != "month"]
    pivot_sum = pivot.agg(F.sum(sum(F.col(f"`{c}`") for c in cols))).first()[0] or 0
    assert pivot_sum == _total(ct.where(F.col("month").isNotNull()))


def test_distinct_providers_per_year_not_sum_of_months(t):
    y = {r.year: r.providers for r in reports.yearly(t.claims, t.reference).collect()}
    m = reports.monthly(t.claims, t.reference)
    summed = {r.y: r.s for r in m.groupBy(F.substring("month", 1, 4).alias("y")).agg(F.sum("providers").alias("s")).collect()}
    assert all(y[k] <= summed[k] for k in y if k is not None)
    assert any(y[k] < summed[k] for k in y if k is not None)
