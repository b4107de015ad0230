"""No caps or frozen size switches; null keys spread; written layout; reuse; report order."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimscope.operators import reshape
from claimscope.operators.filters import ClaimsFilter
from claimscope.operators.joins import with_reference, with_servicing
from claimscope.plans import directory as dirs
from claimscope.plans import prep, reports
from claimscope.sinks.tables import materialize_all
from claimscope.sources import loaders, testtables
from claimscope.sources.warehouse import open_test_tables
from conftest import SF01, claim, reg


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark):
    return open_test_tables(spark, SF01)


def test_reference_that_grows_is_no_longer_broadcast(spark, make, tmp_path):
    path, old = str(tmp_path / "ref"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    claims = make.claims([claim("1", "A", "2020-01")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        make.ref([("A", "Cat", "x")]).write.parquet(path)
        assert "BroadcastHashJoin" in plan(with_reference(claims, loaders.load_reference(spark, path)))
        big = spark.range(20_000).select(
            F.concat(F.lit("C"), "id").alias("code"), F.lit("Cat").alias("category"), F.sha2(F.col("id").cast("string"), 512).alias("description")
        )
        big.write.mode("overwrite").parquet(path)
        p = plan(with_reference(loaders.load_claims(spark, _written(claims, tmp_path)), loaders.load_reference(spark, path)))
        assert "BuildRight" not in p  # the claims may be broadcast, the reference may not
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _written(claims, tmp_path) -> str:
    path = str(tmp_path / "claims")
    claims.write.mode("overwrite").parquet(path)
    return path


def test_null_servicing_keys_are_spread(spark, make):
    rows = [claim(f"B{i % 50}", "A", f"2020-{i % 12 + 1:02d}", servicing=None if i % 3 == 0 else f"S{i % 40}") for i in range(600)]
    claims = make.claims(rows)
    registry = make.registry([reg(f"S{i}", "1", first="F", last=f"L{i}") for i in range(30)])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = with_servicing(claims, registry)
        assert "SortMergeJoin" in plan(got) and "__join_key" in plan(got)
        out = got.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(out) == 600
    names = {f"S{i}": f"L{i}" for i in range(30)}
    assert all(r["s_last_name"] == names.get(r["servicing_npi"]) for r in out)
    assert len({r["part"] for r in out if r["servicing_npi"] is None}) > 3


def test_directory_object_aggregate_sees_no_claim_rows(t):
    for view in dirs.VIEWS:
        d = dirs.directory(t.claims, t.reference, t.registry, ClaimsFilter(states=["NATION_1"]), view)
        p = d._jdf.queryExecution().optimizedPlan().toString()
        object_aggregate = p[p.index("collect_set"):]
        # Below the aggregate that collects sets there is one that sums by category.
        assert "Aggregate" in object_aggregate.split("\n", 1)[1] and "category" in object_aggregate.split("Aggregate")[1]


def test_pivot_takes_any_name_and_empty_input(spark):
    long = spark.createDataFrame(
        [("2020-01", "Cat. A", 1), ("2020-01", "b`c", 2), ("2020-02", "Cat. A", 3), (None, "x", 9), ("2020-02", None, 9)],
        "month string, category string, total_claims long",
    )
    wide = reshape.pivot_wide(long)
    assert wide.columns == ["month", "Cat. A", "b`c"]
    assert [tuple(r) for r in wide.collect()] == [("2020-01", 1, 2), ("2020-02", 3, 0)]
    none = reshape.pivot_wide(long.limit(0))
    assert none.columns == ["month"] and none.count() == 0
    given = reshape.pivot_wide(long, values=["Cat. A", "absent"])
    assert [tuple(r) for r in given.collect()] == [("2020-01", 1, 0), ("2020-02", 3, 0)]


def test_more_pivot_values_than_a_thousand(spark):
    long = spark.range(1200).select(F.lit("2020-01").alias("month"), F.concat(F.lit("c."), "id").alias("category"), F.lit(1).alias("total_claims"))
    wide = reshape.pivot_wide(long)
    assert len(wide.columns) == 1201 and sum(wide.first()[1:]) == 1200


def test_second_identical_materialisation_writes_nothing(spark, t, tmp_path):
    root = str(tmp_path / "reports")
    made = {"overview": reports.state_overview(t.claims), "categories": reports.category_summary(t.claims, t.reference)}
    first = {k: sorted(map(tuple, v.collect())) for k, v in materialize_all(made, root).items()}
    files = sorted(glob.glob(f"{root}/**", recursive=True))
    second = {k: sorted(map(tuple, v.collect())) for k, v in materialize_all(made, root).items()}
    assert first == second and files == sorted(glob.glob(f"{root}/**", recursive=True))


def test_states_lie_together_in_the_written_fact(spark, t, tmp_path):
    path = str(tmp_path / "fact")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        prep.write_claims(t.claims, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = glob.glob(f"{path}/claim_year=*/*.parquet")
    wanted, read = {"NATION_12", "NATION_15"}, 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        k = [meta.schema.column(i).name for i in range(meta.num_columns)].index("practice_state")
        groups = [meta.row_group(g).column(k).statistics for g in range(meta.num_row_groups)]
        read += any(s is None or not s.has_min_max or any(s.min <= w <= s.max for w in wanted) for s in groups)
    # Not tasks x years files, and a year's file is one of few.
    years = t.claims.select("claim_year").distinct().count()
    assert len(files) <= years + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert loaders.load_claims(spark, path).exceptAll(t.claims).isEmpty()
    assert read <= len(files)


def _descending(values):
    return all(a >= b for a, b in zip(values, values[1:]))


def test_report_order(t):
    assert _descending([r["total_claims"] for r in reports.state_overview(t.claims).collect()])
    assert _descending([r["total_claims"] for r in reports.category_summary(t.claims, t.reference).collect()])
    assert _descending([r["total_claims"] for r in reports.code_detail(t.claims, t.reference).collect()])
    assert _descending([r["code_count"] for r in reports.category_counts(t.reference).collect()])
    for view in dirs.VIEWS:
        d = dirs.directory(t.claims, t.reference, t.registry, ClaimsFilter(states=["NATION_1", "NATION_12"]), view)
        assert _descending([r["total_hiv_claims"] for r in d.collect()])
    months = [r["month"] for r in reports.monthly(t.claims, t.reference).collect() if r["month"] is not None]
    assert months == sorted(months)
    years = [r["year"] for r in reports.yearly(t.claims, t.reference).collect() if r["year"] is not None]
    assert years == sorted(years)


def test_reference_pages(spark):
    ref = testtables.code_reference(spark, SF01)
    rows = reports.code_reference(ref).collect()
    assert [(r["category"], r["hcpcs_code"]) for r in rows] == sorted((r["category"], r["hcpcs_code"]) for r in rows)
