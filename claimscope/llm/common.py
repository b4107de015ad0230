"""Shared helpers of the training-data operators: scratch tables, held-out folds, inputs."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "claimscope-llm"


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it on a cluster. Where that is unset (tests, a laptop)
    the warehouse folder serves, which Spark also expects to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{FOLDER}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete one scratch folder made by :func:`new_folder` (any Hadoop file system)."""
    if f"/{FOLDER}/" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def hadoop_uri(spark: SparkSession, path: str, make: bool = False) -> str:
    """``path`` with scheme and authority, as workers without Hadoop configuration need it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if make:
        system.mkdirs(target)
    uri = system.makeQualified(target).toUri().toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in each Python worker and kept from task to task.

    For readers of vocabularies and bounded caches only: a result must not depend on what an
    earlier task left in them. Workers are processes of one application, so the keys are its own.
    """
    held = sys.__dict__.setdefault("_claimscope_llm", {})  # functions are sent by value: module state would not last
    if key not in held:
        held[key] = make()
    return held[key]


def free_worker() -> None:
    """Let go what earlier tasks of this Python worker kept (:func:`per_worker`): another step's caches only take memory."""
    import pyarrow as pa

    sys.__dict__.pop("_claimscope_llm", None)
    pa.default_memory_pool().release_unused()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Let jobs that run inside hand texts to workers so many rows at a time, for less memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def one_thread_per_task() -> None:
    """Keep the tokenizers library to the task's own core: its threads hold memory of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts`` (null id: null)."""
    return F.crc32(doc_id.cast("string")) % parts


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == part, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, allowed: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids, picked by hash order: (doc_id, label).

    An id with several labels takes the largest. The pick is a distributed top-k.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )


def sample_rows(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids in ``picked`` with its other columns: one row per id.

    An id with several texts stands with the one of least hash, with a null text only if
    it has no other; so the bound on ids bounds the rows as well.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    others = [c for c in picked.columns if c != "doc_id"]
    first = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), "text")).alias("first")
    return rows.groupBy("doc_id", *others).agg(first).select("doc_id", F.col("first.text").alias("text"), *others)
