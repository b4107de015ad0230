"""CSV exports of reports (header, no index, RFC 4180 quoting).

Spark's CSV defaults differ from the usual spreadsheet form: quotes inside
a value are escaped with a backslash and empty strings are written as
``""``. The options below double embedded quotes and write empty strings
and nulls as nothing. Money stays DECIMAL so large amounts never print in
exponent form. The output is a folder of part files written in parallel;
``single_file`` coalesces to one file and is meant for small reports only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}
READ_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).options(**WRITE_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an export back with its declared schema (empty cells read as null)."""
    return spark.read.options(**READ_OPTIONS).schema(schema).csv(path)


def export(df: DataFrame, path: str, single_file: bool = False) -> DataFrame:
    """Write ``df`` as CSV and return the file read back (same column types)."""
    write_csv(df, path, single_file=single_file)
    return read_csv(df.sparkSession, path, df.schema)
