"""What the shared steps shuffle and write: each table when asked for, one shuffle of lines, bitmaps and index in place."""

from __future__ import annotations

import glob
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

import __spark_entry__ as entry
from claimscope.operators import ngrams
from claimscope.plans import bitmaps, prep
from claimscope.sinks import text_index
from claimscope.sources import schemas, testtables, warehouse
from conftest import SF001, claim, reg


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def opened(spark):
    home = f"{warehouse.scratch_root(spark)}/claimscope/test-parts/{uuid.uuid4().hex[:8]}"
    return home, warehouse.Warehouse(spark, SF001, home)


def parts(home: str) -> set[str]:
    return {p.rsplit("/", 1)[-1] for p in glob.glob(f"{home}/*")}


def test_tables_are_written_when_asked_for(spark):
    home, t = opened(spark)
    assert t.reference.count() > 0 and parts(home) == {"code_reference"}
    assert "month" in t.claims_for("billing_npi", "month").columns
    assert parts(home) == {"code_reference", "provider_registry", "claims"}
    assert "month" not in t.claims_for("billing_npi", "code").columns and "provider_summary" in parts(home)
    assert t.claims.exceptAll(testtables.claims_enriched(spark, SF001)).isEmpty()
    assert t.claims.count() == testtables.claims_enriched(spark, SF001).count()


def test_enriched_rollup_shuffles_lines_once(spark, make):
    lines = spark.createDataFrame(
        [(f"B{i % 7}" if i % 11 else None, f"S{i % 3}" if i % 5 else None, f"C{i % 2}", f"20{20 + i % 2}-0{i % 3 + 1}" if i % 4 else None, i,
          f"m{i % 13}" if i % 6 else None, Decimal(i) / 8) for i in range(600)],
        "billing_npi string, servicing_npi string, code string, month string, claims long, beneficiary_id string, paid decimal(18,4)",
    )
    registry = make.registry([reg(f"B{i}", state=f"S{i % 2}") for i in range(5)])
    got, want = prep.enriched_rollup(lines, registry), prep.enrich_claims(prep.monthly_rollup(lines), registry).select(*schemas.CLAIMS.fieldNames())
    names = schemas.CLAIMS.fieldNames()
    assert sorted(map(repr, got.select(*names).collect())) == sorted(map(repr, want.collect()))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = physical(prep.enriched_rollup(lines, spark.read.schema(registry.schema).parquet(_kept(registry))))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    above = plan[: plan.index("Exchange rangepartitioning")]
    assert "HashAggregate" in above and "Exchange" not in above


def _kept(df) -> str:
    path = f"{warehouse.scratch_root(df.sparkSession)}/claimscope/test-parts/{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return path


def test_no_bitmap_is_shuffled(spark, make):
    claims = make.claims([claim(f"N{i % 9}", f"C{i % 2}", f"2020-0{i % 3 + 1}") for i in range(60)])
    plan = physical(bitmaps.provider_cells(claims, bitmaps.provider_numbers(claims)))
    made = plan.rindex("bitmap_construct_agg")  # the lowest aggregate that makes bitmaps
    assert "Exchange" not in plan[:made] and "Exchange rangepartitioning" in plan[made:]


def test_bucketed_view_writes_its_own_tables(spark):
    entry.queries()["directory_servicing_bucketed"](spark, SF001).collect()
    home = f"{warehouse.scratch_root(spark)}/claimscope/catalog/{warehouse.source_fingerprint(spark, SF001)}"
    before = parts(home)
    assert {"registry", "servicing"} <= before
    entry.queries()["directory_combined_bucketed"](spark, SF001).collect()
    assert parts(home) == before


def test_index_cuts_each_cell_of_a_block_once(spark, monkeypatch, tmp_path):
    rows = spark.range(400).select(F.lit("a long cell that all rows share").alias("name"), F.lit("X\ny").alias("state"), F.col("id").cast("string").alias("npi"))
    cut = []
    grams = ngrams.grams
    monkeypatch.setattr(ngrams, "grams", lambda text, *a: (cut.append(str(text)), grams(text, *a))[1])
    text_index.write_indexed(rows, str(tmp_path / "d"), ("npi",), blocks=4)
    assert cut and all("concat_ws" not in c for c in cut)
    for needle, n in (("share", 400), ("SHARE\nx", 400), ("x\ny", 400), ("\n", 400), ("y\n399", 1), ("share\ny", 0), ("nowhere", 0)):
        assert text_index.search_indexed(spark, str(tmp_path / "d"), rows.schema, needle).count() == n, needle


def test_stream_joins_lines_once(spark, monkeypatch):
    calls, landed = [], testtables.landed_lines
    monkeypatch.setattr(testtables, "arrivals", lambda lines: calls.append(physical(lines)) or [])
    monkeypatch.setattr(testtables, "landed_lines", lambda *a: landed(*a).limit(50))
    monkeypatch.setattr(entry.rollup, "load_rollup", lambda spark, *a: spark.range(1))
    entry.queries()["prep_monthly_rollup_stream"](spark, SF001)
    assert len(calls) == 1 and "Join" not in calls[0]
