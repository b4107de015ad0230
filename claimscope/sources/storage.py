"""Small file-system steps on the driver: fingerprints, pointers and folders, without Spark jobs.

Any Hadoop file system will do. A pointer is a one-line file that names a finished table; it is
written beside its place and renamed into it, so that a reader sees all of it or nothing, and
the first of several writers wins.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Name of the pointer file within its folder; Spark reads the folder as text.
POINTER = "at"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def file_state(spark: SparkSession, paths: list[str]) -> str:
    """Digest of path, length and modification time of all files at ``paths``, asked of the file system."""
    found = []
    for path in paths:
        system, target = _path(spark, path)
        files = system.listFiles(target, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


@lru_cache(maxsize=1)
def library_version() -> str:
    """Digest of this package's modules outside ``llm``: reports written by other code are stale."""
    home = Path(__file__).resolve().parent.parent
    modules = sorted(p for p in home.rglob("*.py") if "llm" not in p.relative_to(home).parts)
    digest = hashlib.sha1()
    for p in modules:
        digest.update(str(p.relative_to(home)).encode() + p.read_bytes())
    return digest.hexdigest()[:16]


def read_pointer(spark: SparkSession, folder: str) -> str | None:
    """What the pointer in ``folder`` names, or None."""
    system, target = _path(spark, f"{folder}/{POINTER}")
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8").strip()
    finally:
        stream.close()


def set_pointer(spark: SparkSession, folder: str, value: str) -> str:
    """Point ``folder`` at ``value`` unless it already points elsewhere; returns what it points at."""
    jvm = spark._jvm
    system, final = _path(spark, f"{folder}/{POINTER}")
    _, part = _path(spark, f"{folder}/_{uuid.uuid4().hex}")
    system.mkdirs(final.getParent())
    stream = system.create(part, False)
    stream.write(bytearray((value + "\n").encode("utf-8")))
    stream.close()
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(part), system.makeQualified(final), no_options)
    except Py4JJavaError:
        system.delete(part, False)
        if not system.exists(final):
            raise
    return read_pointer(spark, folder)


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _path(spark, path)
    return bool(system.exists(target))


def move_files(spark: SparkSession, folder: str, into: str, prefix: str) -> None:
    """Move the data files of ``folder`` into ``into`` with ``prefix`` before their names; no folder, no files."""
    system, source = _path(spark, folder)
    _, target = _path(spark, into)
    system.mkdirs(target)
    for found in system.listStatus(source) if system.exists(source) else []:
        name = found.getPath().getName()
        if not name.startswith(("_", ".")) and not system.rename(found.getPath(), _path(spark, f"{into}/{prefix}{name}")[1]):
            raise OSError(f"cannot move {found.getPath()} into {into}")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a file or folder if it is there."""
    system, target = _path(spark, path)
    system.delete(target, True)
