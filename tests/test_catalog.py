"""Bucketed registry and summaries: joins without an exchange, equal rows."""

from __future__ import annotations

import glob

import pytest

from claimscope.operators.filters import ClaimsFilter
from claimscope.plans import directory as dirs
from claimscope.sources import catalog
from claimscope.sources.warehouse import open_test_tables
from conftest import SF001

FILT = ClaimsFilter(states=[f"NATION_{k}" for k in range(25)])


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    t = open_test_tables(spark, SF001)
    folder = str(tmp_path_factory.mktemp("catalog"))
    catalog.write_tables(t, folder, buckets=8)
    return t, folder, catalog.open_tables(spark, folder, "test", buckets=8)


@pytest.fixture
def large(spark):
    """As with a registry far beyond the broadcast threshold."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[1], "false")
    yield lambda limit: spark.conf.set(names[0], limit)
    for n, v in old.items():
        spark.conf.set(n, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def below(text: str, node: str) -> str:
    """The part of a plan under the first node of a name."""
    return text[text.index(node):]


@pytest.mark.parametrize("view", dirs.VIEWS)
def test_equal_rows(made, view):
    t, _, b = made
    got = dirs.directory(b.claims_for(view, t.claims), t.reference, b.registry, FILT, view)
    assert rows(got) == rows(dirs.directory(t.claims, t.reference, t.registry, FILT, view))
    assert got.count() > 5


@pytest.mark.parametrize("view", ["billing", "servicing"])
def test_no_exchange_under_the_registry_join(made, view, large):
    t, _, b = made
    ref = t.reference.hint("broadcast")  # tens of codes; the registry is what must not move
    large("-1")
    df = dirs.directory(b.claims_for(view, t.claims), ref, b.registry, FILT, view)
    joined = below(plan(df), "SortMergeJoin")
    assert "Exchange hashpartitioning" not in joined and "Exchange" not in joined.replace("BroadcastExchange", "")
    assert joined.count("Bucketed: true") == 2
    plain = below(plan(dirs.directory(t.claims, ref, t.registry, FILT, view)), "SortMergeJoin")
    assert plain.count("Exchange hashpartitioning") >= 2


def test_pairs_move_but_the_registry_does_not(made, large):
    t, _, b = made
    large("-1")
    p = plan(dirs.directory(t.claims, t.reference.hint("broadcast"), b.registry, FILT, "combined"))
    scans = [k for k, line in enumerate(p.split("\n")) if "FileScan" in line and "org_name" in line]
    lines = p.split("\n")
    assert len(scans) == 2
    for k in scans:
        depth = lines[k].index("FileScan")
        above = next(i for i in range(k, -1, -1) if "SortMergeJoin" in lines[i] and lines[i].index("SortMergeJoin") < depth)
        branch = [x for x in lines[above + 1 : k] if x.rstrip().split("- ")[-1]]
        own = branch[next((i for i in range(len(branch) - 1, -1, -1) if branch[i].lstrip(" :").startswith("+-") and branch[i].index("+-") <= lines[above].index("SortMergeJoin") + 3), 0):]
        assert not any("Exchange" in x for x in own), own


def test_files_are_buckets_and_another_session_can_open_them(spark, made):
    t, folder, _ = made
    for name in catalog.TABLES:
        assert 1 <= len(glob.glob(f"{folder}/{name}/part-*.parquet")) <= 8
    other = spark.newSession()
    again = catalog.open_tables(other, folder, "again", buckets=8)
    assert rows(again.registry.orderBy("npi")) == rows(t.registry.orderBy("npi"))


def test_no_servicing_provider_is_one_group(spark, made):
    t, _, b = made
    none = b.servicing.where("servicing_npi is null")
    want = t.claims.where("servicing_npi is null").select("code", "practice_state", "claim_year").distinct().count()
    assert none.count() == want > 0
