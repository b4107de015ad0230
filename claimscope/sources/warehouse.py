"""Build-once warehouse of the claims model from the test tables.

The reports read an already prepared, partitioned fact table, as they would
in production. For the test tables that table is derived by Spark (rollup,
registry join) and written once per source version under the session's
shared checkpoint folder (``spark.checkpoint.dir``); later queries read it.
Writing it also cuts the lineage, so a lost executor costs a re-read, not a
re-run of the joins and the rollup. Each table is written when it is first
asked for: a query of the code reference does not wait for the fact.

A build is keyed by a fingerprint of the source files (path, size,
modification time, asked of the file system without a Spark job) and of this
package's mapping code. A build goes to its own folder; a small pointer file
moved into place last names the finished build, so a reader never sees a
half-written one.
"""

from __future__ import annotations

import hashlib
import inspect
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession

from claimscope.sources import loaders, schemas, storage, testtables

SOURCE_TABLES = ("nation", "supplier", "customer", "part", "orders", "lineitem")

#: Lines of one rollup task, as shuffled: its hash tables and its sort take some thirty times as much.
ROLLUP_TASK = "24m"

_opened: dict[tuple[str, str, str], loaders.Tables] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for materialised tables: ``spark.checkpoint.dir``, else the warehouse folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this package, on whatever file system it lies."""
    if "/claimscope/" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@lru_cache(maxsize=1)
def _code_version() -> str:
    """Digest of the code that derives the tables, once per process."""
    from claimscope.operators import joins
    from claimscope.plans import prep

    h = hashlib.sha1()
    for mod in (testtables, prep, joins, schemas, loaders, sys.modules[__name__]):
        h.update(inspect.getsource(mod).encode())
    return h.hexdigest()[:12]


def source_fingerprint(spark: SparkSession, sf_dir: str, names=SOURCE_TABLES) -> str:
    """Digest of the source files' path, size and mtime and of the mapping code. No Spark job;
    looked up anew on every call, so that a source that changes under a live session is seen."""
    paths = [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names]
    raw = f"{sf_dir}|{storage.file_state(spark, paths)}|{_code_version()}"
    return hashlib.sha1(raw.encode()).hexdigest()[:16]


def _current_build(spark: SparkSession, pointer: str) -> str | None:
    return storage.read_pointer(spark, pointer)


def derived(spark: SparkSession, home: str, write: Callable[[str], None]) -> str:
    """Folder of tables below ``home`` that ``write(folder)`` makes; written once, then found.

    ``home`` must name the version of what the tables are derived from; the library's own
    version is added, so tables that other code derived are not found. Writers that run at the
    same time each finish; the first to set the pointer wins and all return its folder.
    """
    home = f"{home}/{storage.library_version()}"
    folder = _current_build(spark, f"{home}/_current")
    if folder is None:
        folder = f"{home}/build-{uuid.uuid4().hex[:12]}"
        write(folder)
        folder = storage.set_pointer(spark, f"{home}/_current", folder)
    return folder


def build(spark: SparkSession, sf_dir: str, home: str, month_summary: bool = False) -> str:
    """Derive and write the tables into a new folder under ``home``; point
    ``home/_current`` at it last. Returns the build folder. The monthly summary is nearly
    as large as the fact and is only written when asked for."""
    from claimscope.plans import prep

    folder = f"{home}/build-{uuid.uuid4().hex[:12]}"
    _write_registry(spark, sf_dir, f"{folder}/provider_registry")
    _write_reference(spark, sf_dir, f"{folder}/code_reference")
    _write_claims(spark, sf_dir, loaders.load_registry(spark, f"{folder}/provider_registry", validate=False), f"{folder}/claims")
    written_claims = loaders.load_claims(spark, f"{folder}/claims")
    if month_summary:
        monthly = prep.provider_summary(written_claims, by_month=True)
        prep.write_claims(schemas.conform(monthly, schemas.MONTH_SUMMARY, "month_summary"),
                          f"{folder}/provider_month_summary")
        written_claims = loaders.load_summary(spark, f"{folder}/provider_month_summary", by_month=True)
    _write_summary(written_claims, f"{folder}/provider_summary")
    return storage.set_pointer(spark, f"{home}/_current", folder)


def _checked_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = testtables.registry(spark, sf_dir)
    schemas.assert_unique(registry, "npi", "provider_registry")
    return registry


def _write_registry(spark: SparkSession, sf_dir: str, path: str) -> None:
    _checked_registry(spark, sf_dir).write.mode("overwrite").parquet(path)


def _write_reference(spark: SparkSession, sf_dir: str, path: str) -> None:
    reference = testtables.code_reference(spark, sf_dir)
    schemas.assert_unique(reference, "code", "code_reference")
    reference.orderBy("category", "code").coalesce(1).write.mode("overwrite").parquet(path)


@contextmanager
def _task_size(spark: SparkSession, size: str) -> Iterator[None]:
    """Let jobs that run inside read so much shuffled data a task."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _write_claims(spark: SparkSession, sf_dir: str, registry: DataFrame, path: str) -> None:
    """Enriched against the written registry: no second derivation."""
    from claimscope.plans import prep

    enriched = prep.enriched_rollup(testtables.claim_lines(spark, sf_dir), registry)
    with _task_size(spark, ROLLUP_TASK):
        prep.write_claims(schemas.conform(enriched, schemas.CLAIMS, "claims"), path, dealt=True)


def _write_summary(claims: DataFrame, path: str) -> None:
    """Derived from the written fact (no re-run of the rollup), with the same layout."""
    from claimscope.plans import prep

    prep.write_claims(schemas.conform(prep.provider_summary(claims), schemas.SUMMARY, "provider_summary"), path)


class Warehouse(loaders.Tables):
    """The tables of one source version, each written when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, home: str):
        self.__dict__.update(spark=spark, sf_dir=sf_dir, home=home)

    def _folder(self, name: str, write: Callable[[str], None]) -> str:
        return derived(self.spark, f"{self.home}/{name}", write)

    @cached_property
    def registry(self) -> DataFrame:
        folder = self._folder("provider_registry", lambda to: _write_registry(self.spark, self.sf_dir, to))
        return loaders.load_registry(self.spark, folder, validate=False)

    @cached_property
    def reference(self) -> DataFrame:
        def write(to: str) -> None:
            _checked_registry(self.spark, self.sf_dir)  # a source with a repeated provider opens no table
            _write_reference(self.spark, self.sf_dir, to)

        return loaders.load_reference(self.spark, self._folder("code_reference", write), validate=False)

    @cached_property
    def claims(self) -> DataFrame:
        folder = self._folder("claims", lambda to: _write_claims(self.spark, self.sf_dir, self.registry, to))
        return loaders.load_claims(self.spark, folder)

    @cached_property
    def summary(self) -> DataFrame:
        folder = self._folder("provider_summary", lambda to: _write_summary(self.claims, to))
        return loaders.load_summary(self.spark, folder)

    def claims_for(self, *columns: str) -> DataFrame:
        """As of all tables, but the summary is not written to learn its columns."""
        return self.summary if set(columns) <= set(schemas.SUMMARY.fieldNames()) else self.claims


def open_test_tables(spark: SparkSession, sf_dir: str, materialize: bool = True) -> loaders.Tables:
    """Warehouse tables for a test-data folder.

    ``materialize=False`` returns the derivation plans themselves (nothing is
    written), e.g. to inspect the full plan with ``explain``.
    """
    if not materialize:
        return loaders.Tables(
            testtables.claims_enriched(spark, sf_dir),
            testtables.code_reference(spark, sf_dir),
            testtables.registry(spark, sf_dir),
        )
    version = source_fingerprint(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, version)
    if key in _opened:
        return _opened[key]
    tables = Warehouse(spark, sf_dir, f"{scratch_root(spark)}/claimscope/warehouse/{version}")
    _opened[key] = tables
    return tables
