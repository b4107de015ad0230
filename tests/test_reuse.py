"""Reuse of written reports: what makes an entry stale, crashes, writers at the same time."""

from __future__ import annotations

import glob
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from claimscope.operators.filters import ClaimsFilter
from claimscope.plans import reports
from claimscope.sinks import tables
from claimscope.sources import storage, warehouse
from conftest import SF001

FILT = ClaimsFilter(states=["NATION_1"])


@pytest.fixture(scope="module")
def t(spark):
    return warehouse.open_test_tables(spark, SF001)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def runs(root):
    return sorted(glob.glob(f"{root}/*/*/run-*"))


def test_found_again_and_written_once(spark, t, tmp_path):
    root = str(tmp_path)
    made = {"overview": reports.state_overview(t.claims), "categories": reports.category_summary(t.claims, t.reference)}
    first = {k: rows(v) for k, v in tables.materialize_all(made, root, key="a").items()}
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{root}/**", recursive=True)}
    second = {k: rows(v) for k, v in tables.materialize_all(made, root, key="a").items()}
    assert first == second == {k: rows(v) for k, v in made.items()}
    assert before == {p: os.path.getmtime(p) for p in glob.glob(f"{root}/**", recursive=True)}


def test_other_filter_other_source_other_names(spark, t, tmp_path):
    root = str(tmp_path)
    everything, one = reports.state_overview(t.claims), reports.state_overview(t.claims, FILT)
    assert rows(tables.reuse("overview", everything, root, "v1|all")) == rows(everything)
    assert rows(tables.reuse("overview", one, root, "v1|NATION_1")) == rows(one) != rows(everything)
    tables.reuse("overview", everything, root, "v2|all")
    # A set of other names on the same root is simply not there yet.
    trend = reports.yearly(t.claims, t.reference)
    assert rows(tables.materialize_all({"yearly": trend}, root, key="v1|all")["yearly"]) == rows(trend)
    assert len(runs(root)) == 4


def test_changed_code_is_a_miss(spark, t, tmp_path, monkeypatch):
    root, df = str(tmp_path), reports.state_overview(t.claims)
    tables.reuse("overview", df, root)
    changed = df.withColumn("total_claims", F.col("total_claims") + 1)
    monkeypatch.setattr(storage, "library_version", lambda: "another version")
    assert rows(tables.reuse("overview", changed, root)) == rows(changed)
    monkeypatch.undo()
    assert rows(tables.reuse("overview", df, root)) == rows(df)
    # A changed schema is a miss as well.
    assert tables.reuse("overview", df.select("state"), root).columns == ["state"]


def test_library_version_covers_report_modules():
    storage.library_version.cache_clear()
    home = os.path.dirname(os.path.dirname(storage.__file__))
    covered = {os.path.relpath(p, home) for p in glob.glob(f"{home}/**/*.py", recursive=True)}
    assert {"plans/reports.py", "functions/measures.py", "operators/filters.py"} <= covered
    assert len(storage.library_version()) == 16


def test_crash_before_the_pointer_leaves_no_entry(spark, t, tmp_path, monkeypatch):
    root, df = str(tmp_path), reports.state_overview(t.claims)

    def lost(*args):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(storage, "set_pointer", lost)
    with pytest.raises(RuntimeError):
        tables.reuse("overview", df, root)
    monkeypatch.undo()
    assert len(runs(root)) == 1 and not glob.glob(f"{root}/*/*/_current/at")
    assert rows(tables.reuse("overview", df, root)) == rows(df)
    assert len(runs(root)) == 2
    # A half-written pointer is a file under another name: nothing reads it.
    (pointer,) = glob.glob(f"{root}/*/*/_current/at")
    open(os.path.join(os.path.dirname(pointer), "_half"), "w").write('{"fold')
    assert rows(tables.reuse("overview", df, root)) == rows(df) and len(runs(root)) == 2


def test_writers_at_the_same_time(spark, t, tmp_path):
    root, df = str(tmp_path), reports.state_overview(t.claims)
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: rows(tables.reuse("overview", df, root)), range(4)))
    assert all(g == rows(df) for g in got)
    (pointer,) = glob.glob(f"{root}/*/*/_current/at")
    named = json.load(open(pointer))
    assert named["folder"] in runs(root) and named["report"] == "overview" and named["code"] == storage.library_version()


def test_first_pointer_wins(spark, tmp_path):
    home = str(tmp_path / "p")
    assert storage.read_pointer(spark, home) is None
    assert storage.set_pointer(spark, home, "one") == "one"
    assert storage.set_pointer(spark, home, "two") == "one" == storage.read_pointer(spark, home)
    assert [p for p in os.listdir(home) if p.startswith("_")] == []


def test_derived_tables_of_other_code_are_not_found(spark, tmp_path, monkeypatch):
    home, made = str(tmp_path / "derived"), []

    def write(folder):
        made.append(folder)
        spark.range(3).write.parquet(folder)

    assert warehouse.derived(spark, home, write) == warehouse.derived(spark, home, write) == made[0]
    monkeypatch.setattr(storage, "library_version", lambda: "another version")
    assert warehouse.derived(spark, home, write) == made[1] != made[0]


def test_open_runs_no_spark_job(spark, t):
    group = "open-test-tables"
    spark.sparkContext.setJobGroup(group, "open")
    try:
        warehouse.open_test_tables(spark, SF001)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_fingerprint_follows_the_source(spark, tmp_path):
    names = ("a", "b")
    for n in names:
        spark.range(3).write.parquet(str(tmp_path / f"{n}.parquet"))
    one = warehouse.source_fingerprint(spark, str(tmp_path), names)
    assert one == warehouse.source_fingerprint(spark, str(tmp_path), names)
    spark.range(3).write.mode("append").parquet(str(tmp_path / "b.parquet"))
    assert one != warehouse.source_fingerprint(spark, str(tmp_path), names)
