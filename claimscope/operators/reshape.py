"""Reshaping of small report results: pivot, keyed series, code labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.scalars import code_label, label_code


def _quoted(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pivot_values(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct non-null values of ``column``, one per column of the wide table."""
    rows = df.where(_quoted(column).isNotNull()).select(_quoted(column).alias("v")).distinct().orderBy("v").collect()
    return [r["v"] for r in rows]


def pivot_wide(long: DataFrame, index: str = "month", columns: str = "category",
               value: str = "total_claims", values: Sequence[str] | None = None) -> DataFrame:
    """Rows ``index``, one column per ``columns`` value, holes filled with 0.

    Rows with a null index or null column value are dropped first; with ``values``
    omitted, the values present among the remaining rows become columns (none: only the
    index remains); they are looked up by a job of their own, so give a written report
    (``sinks.tables.reuse``) rather than a plan that is long to run. Nothing is cached.
    Values may hold any characters: sums get plain names and are renamed last.
    """
    clean = long.where(_quoted(index).isNotNull() & _quoted(columns).isNotNull())
    clean = clean.select(_quoted(index).alias("i"), _quoted(columns).alias("c"), _quoted(value).alias("v"))
    if values is None:
        values = pivot_values(clean, "c")
    sums = [F.sum(F.when(F.col("c") == F.lit(x), F.col("v"))).alias(f"v{k}") for k, x in enumerate(values)]
    wide = clean.groupBy("i").agg(*sums) if sums else clean.select("i").distinct()
    names = [F.coalesce(f"v{k}", F.lit(0)).alias(x) for k, x in enumerate(values)]
    # One row per index value (months): small, ordered in one partition.
    return wide.repartition(1).sortWithinPartitions("i").select(F.col("i").alias(index), *names)


def series(report: DataFrame, key: str, measure: str) -> DataFrame:
    """Keyed series (key, one measure) — the data behind a chart."""
    return report.select(key, measure)


def code_labels(codes: DataFrame) -> DataFrame:
    """Pick-list labels ``"<code> — <description>"`` for a code table."""
    return codes.select("hcpcs_code", code_label("hcpcs_code", "description").alias("label"))


def parse_labels(labels: DataFrame, column: str = "label") -> DataFrame:
    """Chosen labels back to codes."""
    return labels.select(label_code(column).alias("hcpcs_code"))
