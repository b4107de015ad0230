"""Materialised report tables, found again by what made them.

A report computed once is written as Parquet and later reads use the table instead of
re-running the aggregate over the fact; the written table has no lineage to replay when an
executor is lost. An entry is addressed by the report's name, the caller's key (filter and
source version), the code of the library and the result's schema: if any of them changes, the
entry is another one, so a changed report, filter or source never gets old rows.

Layout under the root::

    <name>/<address>/run-*/        the rows, one folder per attempt
    <name>/<address>/_current/at   manifest of the finished attempt, moved into place last
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from claimscope.sources import storage


def materialize(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def manifest(name: str, df: DataFrame, key: str) -> dict[str, str]:
    """What an entry is made from, in a form that can be read."""
    return {"report": name, "key": key, "code": storage.library_version(), "schema": df.schema.json()}


def address(made_from: Mapping[str, str]) -> str:
    return hashlib.sha256(json.dumps(made_from, sort_keys=True).encode()).hexdigest()[:24]


def reuse(name: str, df: DataFrame, root: str, key: str = "") -> DataFrame:
    """``df`` as a table under ``root``: read if an equal entry is finished, else written now.

    A writer that stops half-way leaves a folder that nothing names. Of several writers of
    one entry the first to finish is named, and all read its rows.
    """
    spark, made_from = df.sparkSession, manifest(name, df, key)
    home = f"{root.rstrip('/')}/{name}/{address(made_from)}"
    found = storage.read_pointer(spark, f"{home}/_current")
    if found is None:
        folder = f"{home}/run-{uuid.uuid4().hex[:12]}"
        df.write.parquet(folder)
        found = storage.set_pointer(spark, f"{home}/_current", json.dumps({"folder": folder, **made_from}))
    return spark.read.schema(df.schema).parquet(json.loads(found)["folder"])


def materialize_all(reports: Mapping[str, DataFrame], root: str, parallel: int = 4, key: str = "") -> dict[str, DataFrame]:
    """The named reports as tables (:func:`reuse`), each looked up by itself.

    ``key`` names the filter and the version of the inputs. The reports are independent jobs,
    each too small to fill a cluster, so they are submitted from ``parallel`` driver threads
    and the scheduler runs their stages side by side.
    """
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(reports)))) as pool:
        futures = {name: pool.submit(reuse, name, df, root, key) for name, df in reports.items()}
        return {name: f.result() for name, f in futures.items()}
