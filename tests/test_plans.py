"""Physical-plan checks: the shapes the scale design depends on."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from claimscope.operators.filters import ClaimsFilter
from claimscope.plans import directory as dirs
from claimscope.plans import reports
from claimscope.sources.warehouse import open_test_tables
from conftest import SF01


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return open_test_tables(spark, SF01)


def test_reference_join_is_broadcast(tables):
    p = plan(reports.category_summary(tables.claims, tables.reference))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_year_filter_prunes_partitions(tables):
    p = plan(reports.state_overview(tables.claims, ClaimsFilter(years=["1998"])))
    assert "PartitionFilters: [isnotnull(claim_year" in p or "PartitionFilters: [claim_year" in p
    assert "1998" in p.split("PartitionFilters")[1].split("]")[0]


def test_state_filter_pushed_to_parquet(tables):
    p = plan(reports.state_overview(tables.claims, ClaimsFilter(states=["NATION_1"])))
    assert "PushedFilters: [IsNotNull(practice_state), In(practice_state" in p or \
        "EqualTo(practice_state,NATION_1)" in p


def test_scan_reads_only_needed_columns(tables):
    p = plan(reports.state_overview(tables.claims))
    schema = p.split("ReadSchema: ")[1].split("\n")[0]
    assert "servicing_npi" not in schema and "month" not in schema and "code" not in schema


def test_distinct_count_is_two_phase_without_expand(tables):
    p = plan(reports.monthly(tables.claims, tables.reference))
    assert "Expand" not in p
    assert p.count("HashAggregate") >= 4  # partial/merge by (key, npi), then by key


def test_directory_aggregates_before_registry_join(tables):
    d = dirs.directory(tables.claims, tables.reference, tables.registry, ClaimsFilter(states=["NATION_1"]), "billing")
    p = d._jdf.queryExecution().optimizedPlan().toString()
    # The aggregate sits below the outer join with the registry.
    join_at = p.index("Join LeftOuter")
    assert "Aggregate" in p[join_at:]


@pytest.mark.parametrize("key", list(entry._QUERIES))
def test_no_python_evaluation_in_any_query(spark, key):
    df = entry.queries()[key](spark, SF01)
    p = plan(df)
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert node not in p, f"{key} evaluates Python: {node}"
