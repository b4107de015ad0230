"""Every registered query equals its DuckDB oracle on the sf0.01 test tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from conftest import SF01, SF001
from oracle_compare import compare, duck

KEYS = list(entry._QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    ok, msg = compare(spark, con, key, entry.queries()[key], entry.oracle_sql()[key], SF01)
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["npi", "entity_type", "provider_name"]
    ok, msg = compare(spark, duck(SF001), "directory_billing", lambda s, sf: df,
                      entry.oracle_sql()["directory_billing"], SF001)
    assert ok, msg


def test_fixture_expectations(spark):
    """Spot values from FIXTURES.md at sf0.01."""
    q = entry.queries()
    nation1 = [r for r in q["state_overview"](spark, SF01).collect() if r.state == "NATION_1"][0]
    assert (nation1.total_providers, nation1.total_claims, nation1.total_beneficiaries) == (3, 44436, 1753)
    assert round(nation1.total_paid, 2) == 90142702.61
    assert q["scan_claims"](spark, SF01).count() == 59711
    assert q["scan_registry"](spark, SF01).count() == 1474
    assert q["prep_suppress"](spark, SF01).count() == 46452
    kpi = q["kpi_overview"](spark, SF01).first()
    assert (kpi.states, kpi.providers, kpi.total_claims) == (25, 90, 1372922)
    assert q["trend_yearly"](spark, SF01).count() == 8
    assert q["trend_category_pivot"](spark, SF01).count() == 83
