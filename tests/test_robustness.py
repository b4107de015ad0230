"""Hot keys and interrupted builds."""

from __future__ import annotations

import uuid
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from claimscope.operators.filters import ClaimsFilter
from claimscope.plans import directory as dirs
from claimscope.plans import prep, reports
from claimscope.sources import schemas, warehouse
from conftest import SF001

CATS = {"C1": "A", "C2": "B", "C3": "B"}


def _skewed_rows(n=3000):
    """One billing NPI ('HOT') holds a third of all rows, in one state."""
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        billing = "HOT" if hot else f"P{i % 97}"
        state = "S0" if hot else f"S{i % 5}"
        code = ("C1", "C2", "C3", "X9")[i % 4]
        month = f"20{20 + i % 3}-{1 + i % 12:02d}"
        rows.append((billing, f"V{i % 11}", code, month, 12 + i % 7, 1 + i % 4, Decimal(f"{i % 1000}.25"),
                     state, month[:4]))
    return rows


def test_hot_provider_results_equal_brute_force(spark, make):
    rows = _skewed_rows()
    claims = make.claims(rows)
    ref = make.ref([(c, k, f"d{c}") for c, k in CATS.items()])

    # Overview, brute force in Python.
    want = defaultdict(lambda: [set(), 0, 0, Decimal(0)])
    for b, _, _, _, c, ben, paid, st, _ in rows:
        w = want[st]
        w[0].add(b)
        w[1] += c
        w[2] += ben
        w[3] += paid
    got = {r.state: (r.total_providers, r.total_claims, r.total_beneficiaries, r.total_paid)
           for r in reports.state_overview(claims).collect()}
    assert got == {k: (len(v[0]), v[1], v[2], v[3]) for k, v in want.items()}

    # Billing directory for the hot state: the hot provider is one row.
    d = dirs.directory(claims, ref, make.registry([]), ClaimsFilter(states=["S0"]), "billing").collect()
    hot = [r for r in d if r.npi == "HOT"][0]
    assert hot.total_hiv_claims == sum(r[4] for r in rows if r[0] == "HOT" and r[2] in CATS)
    assert hot.categories_served == "A, B"


def test_hot_key_plan_preaggregates_before_shuffle(spark, make):
    claims = make.claims(_skewed_rows(300))
    p = reports.state_overview(claims)._jdf.queryExecution().executedPlan().toString()
    first_exchange = p.rfind("Exchange hashpartitioning")
    assert "HashAggregate" in p[first_exchange:], "partial aggregation must run before the first shuffle"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_rollup_hot_group(spark):
    lines = spark.createDataFrame(
        [("B", "S", "C", "2020-01", 1, f"m{i % 500}", Decimal("1.0000")) for i in range(5000)]
        + [("B2", None, "C", None, 2, "x", Decimal("0.0050"))],
        schemas.CLAIM_LINES,
    )
    got = {r.billing_npi: r for r in prep.monthly_rollup(lines).collect()}
    assert (got["B"].total_claims, got["B"].total_unique_beneficiaries, got["B"].total_paid) == (5000, 500, Decimal("5000.00"))
    assert got["B2"].total_paid == Decimal("0.01")


def test_unfinished_build_is_never_used(spark):
    root = f"{warehouse.scratch_root(spark)}/claimscope/test-interrupted/{uuid.uuid4().hex[:8]}"
    # A build folder with data but no pointer: what a crash mid-build leaves.
    spark.range(3).write.parquet(f"{root}/build-crashed/claims")
    assert warehouse._current_build(spark, f"{root}/_current") is None
    folder = warehouse.build(spark, SF001, root)
    assert folder != f"{root}/build-crashed"
    assert warehouse._current_build(spark, f"{root}/_current") == folder
    n = spark.read.parquet(f"{folder}/claims").where(F.col("billing_npi").isNotNull()).count()
    assert n > 0
