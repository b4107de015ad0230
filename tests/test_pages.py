"""One-pass pages equal the individual reports."""

from __future__ import annotations

import uuid

import pytest

from claimscope.operators import facets, refine
from claimscope.operators.filters import ClaimsFilter
from claimscope.plans import directory as dirs
from claimscope.plans import kpis, pages, reports
from claimscope.sources import loaders, warehouse
from claimscope.sources.warehouse import open_test_tables
from conftest import SF01, SF001

FILTERS = [
    ClaimsFilter(),
    ClaimsFilter(states=["NATION_12", "NATION_15"], years=["1998", "1999"]),
    ClaimsFilter(years=["1997"], category="Outreach"),
    ClaimsFilter(category="Treatment", codes=["Brand#3"]),
]


def _rows(df):
    return [tuple(float(v) if hasattr(v, "as_tuple") else v for v in r) for r in df.collect()]


@pytest.fixture(scope="module")
def t(spark):
    return open_test_tables(spark, SF01)


@pytest.mark.parametrize("filt", FILTERS)
def test_services_page(t, filt):
    with pages.services_page(t.claims, t.reference, filt) as page:
        assert _rows(page.category) == _rows(reports.category_summary(t.claims, t.reference, filt))
        assert _rows(page.category_state) == _rows(reports.category_state(t.claims, t.reference, filt))
        assert _rows(page.code_detail) == _rows(reports.code_detail(t.claims, t.reference, filt))
        assert _rows(page.kpis) == _rows(kpis.services_kpis(reports.category_summary(t.claims, t.reference, filt)))


@pytest.mark.parametrize("filt", FILTERS[:2])
def test_trends_page(t, filt):
    with pages.trends_page(t.claims, t.reference, filt) as page:
        assert _rows(page.monthly) == _rows(reports.monthly(t.claims, t.reference, filt))
        assert _rows(page.yearly) == _rows(reports.yearly(t.claims, t.reference, filt))
        assert _rows(page.category_trend) == _rows(reports.category_trend(t.claims, t.reference, filt))


def test_directory_page(t):
    filt = FILTERS[1]
    with pages.directory_page(t.claims, t.reference, t.registry, filt, "servicing") as page:
        plain = dirs.directory(t.claims, t.reference, t.registry, filt, "servicing")
        assert _rows(page.rows) == _rows(plain)
        assert _rows(page.kpis) == _rows(kpis.directory_kpis(plain))
        assert _rows(page.served_categories) == _rows(facets.served_categories(plain))
        assert _rows(page.refine("Outreach", "machinery")) == _rows(refine.refine(plain, "Outreach", "machinery"))


@pytest.mark.parametrize("filt", FILTERS)
def test_provider_summary_equals_fact(t, filt):
    s = t.claims_for("billing_npi", "code", "practice_state", "claim_year")
    assert s is t.summary and "month" not in s.columns
    assert t.claims_for("month") is t.claims and t.claims_for("servicing_npi") is t.claims
    for report in (reports.category_summary, reports.category_state, reports.code_detail, reports.yearly):
        assert _rows(report(s, t.reference, filt)) == _rows(report(t.claims, t.reference, filt)), report.__name__
    assert _rows(reports.state_overview(s, filt)) == _rows(reports.state_overview(t.claims, filt))
    assert _rows(facets.states(s)) == _rows(facets.states(t.claims))
    assert _rows(facets.years(s)) == _rows(facets.years(t.claims))
    if filt.states:
        a = dirs.directory(s, t.reference, t.registry, filt, "billing")
        b = dirs.directory(t.claims, t.reference, t.registry, filt, "billing")
        assert _rows(a) == _rows(b)
    with pages.services_page(s, t.reference, filt) as p:
        assert _rows(p.code_detail) == _rows(reports.code_detail(t.claims, t.reference, filt))


def test_month_summary_is_an_option(spark):
    home = f"{warehouse.scratch_root(spark)}/claimscope/test-months/{uuid.uuid4().hex[:8]}"
    f = warehouse.build(spark, SF001, home, month_summary=True)
    places = (f"{f}/claims", f"{f}/code_reference", f"{f}/provider_registry")
    plain = loaders.Tables.load(spark, *places)
    assert plain.claims_for("claim_year") is plain.claims
    t = loaders.Tables.load(spark, *places, summary=f"{f}/provider_summary", month_summary=f"{f}/provider_month_summary")
    assert t.claims_for("claim_year") is t.summary
    m = t.claims_for("month")
    assert m is t.month_summary and "servicing_npi" not in m.columns and m.count() < t.claims.count()
    for report in (reports.monthly, reports.category_trend, reports.yearly):
        want = _rows(report(plain.claims, t.reference))
        assert _rows(report(m, t.reference)) == want, report.__name__
    assert _rows(reports.yearly(t.summary, t.reference)) == _rows(reports.yearly(t.claims, t.reference))
