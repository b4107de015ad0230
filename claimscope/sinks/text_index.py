"""A written directory with an inverted n-gram index: free-text search that reads few files.

The rows are written in blocks of neighbours (by the given order), one folder a block. The index
lists, for every substring of one to three letters of a row's cells, the blocks that hold
it. A search first looks up the needle's trigrams (a needle of one or two letters: itself),
keeps the blocks that hold all of them, and applies the exact substring test to those blocks
only. A block may hold the trigrams but not the needle, never the other way round, so the rows
are those of a full scan. Grams with a newline, which joins cells in the search text, may span
two cells and are not looked up.

Neighbours share most of their cells, so a block's distinct cells are cut into grams, not its
rows' texts: the work grows with what is new in a row.

The index has at most distinct grams x blocks rows and is clustered by gram; looking up reads
the row groups of a few grams. The blocks found are joined to the rows on the partition
column, so Spark prunes folders at run time; nothing passes through the driver.

Layout: ``rows/block=B/`` the rows, ``grams/`` (gram, block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.functions.scalars import search_text
from claimscope.operators import ngrams
from claimscope.operators.refine import searchable_columns

BLOCK = "__block"
SIZES = (1, 2, 3)


def write_indexed(rows: DataFrame, path: str, order: tuple[str, ...], blocks: int = 64) -> None:
    """Write ``rows`` in about ``blocks`` blocks by ``order``, then their index."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(blocks, *order).withColumn(BLOCK, F.spark_partition_id()).sortWithinPartitions(*order)
    dealt.write.partitionBy(BLOCK).parquet(f"{path}/rows")
    written = _rows(spark, path, rows.schema)
    cells = F.array(*(F.lower(F.col(c).cast("string")) for c in searchable_columns(rows)))
    values = written.select(BLOCK, F.explode(cells).alias("cell")).where(F.col("cell").isNotNull()).distinct()
    # A block's cells give each gram once a task: the explosion is pre-aggregated before it is shuffled.
    found = values.select(BLOCK, F.explode(ngrams.grams(F.col("cell"), SIZES)).alias("gram")).distinct()
    found.select("gram", BLOCK).repartitionByRange("gram", BLOCK).sortWithinPartitions("gram", BLOCK).write.parquet(f"{path}/grams")


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BLOCK, T.IntegerType())])).parquet(f"{path}/rows")


def blocks_with(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """(block): those that hold every gram of the needle, but for grams that may span cells."""
    index = spark.read.schema(f"gram string, {BLOCK} int").parquet(f"{path}/grams")
    # Literals, so that they reach the scan; lower-casing is Spark's, as in the search text.
    wanted = spark.range(1).select(ngrams.needle_grams(F.lower(F.lit(needle))).alias("g")).first()["g"]
    wanted = [g for g in wanted if "\n" not in g]
    if not wanted:
        return spark.read.schema(f"{BLOCK} int").parquet(f"{path}/rows").select(BLOCK).distinct()
    held = index.where(F.col("gram").isin(wanted)).groupBy(BLOCK).agg(F.count(F.lit(1)).alias("n"))
    return held.where(F.col("n") == len(wanted)).select(BLOCK)


def search_indexed(spark: SparkSession, path: str, schema: T.StructType, needle: str | None) -> DataFrame:
    """Rows whose cells hold ``needle``, as ``refine.search`` over all rows; an empty needle: all rows."""
    rows = _rows(spark, path, schema)
    if not needle:
        return rows.select(*schema.fieldNames())
    kept = rows.join(F.broadcast(blocks_with(spark, path, needle)), BLOCK, "left_semi")  # at most one row per block
    text = search_text(*searchable_columns(rows.drop(BLOCK)))
    return kept.where(text.contains(F.lower(F.lit(needle)))).select(*schema.fieldNames())
