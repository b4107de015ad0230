"""Monthly rollup of raw claim lines as a stateful stream.

Claim lines land in any order, late and repeated. Two stateful operators, both built in, and a
sum over what they let go turn them into the rows of ``prep.monthly_rollup``:

1. lines are taken once each (key: line id and claim month);
2. lines of one beneficiary in one rollup group are added up. The state keyed by (group,
   beneficiary) *is* the group's exact beneficiary set: spread over all state partitions by its
   key, so a provider with a third of all lines has no task of its own, and no set is ever
   gathered in one place;
3. groups count their beneficiaries and add up their sums, partially before the shuffle. All
   people of a month leave the state in one micro-batch, so this needs no state of its own.

Event time is the first day of the claim month. The watermark trails the newest month by
``lateness`` months; a month that falls behind it is closed: its rows are emitted once, and
its state is dropped. The sink writes each micro-batch to a folder keyed by its batch id, so a
replayed batch overwrites itself.

What a run leaves on disk is bounded: the checkpoint keeps the state of the last two
micro-batches, shuffled lines go with their micro-batch, and a run that stops when all is taken
in (``available_now``) keeps no second copy of its state on the workers.

Nothing is lost to the watermark: lines that come after their month was closed are dropped by
the stream (Spark counts them, :func:`dropped_late`), and :func:`reconcile` rolls those months up
again from the landed lines. Undated lines have no event time and months still open are not
emitted yet; :func:`load_rollup` rolls both up from the landed lines when it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from claimscope.session import settings
from claimscope.sources import schemas, storage

#: Claim lines as they land: with the publisher's line number, by which a repeated line is known.
LANDED_LINES = T.StructType([T.StructField("line_id", T.StringType(), False), *schemas.CLAIM_LINES.fields])

ROLLED = T.StructType([*schemas.CLAIMS_MONTHLY.fields, T.StructField("lines", T.LongType(), False)])
GROUP = ("billing_npi", "servicing_npi", "code")

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Keeps a count of the state's rows, for which every write looks its key up first.
COUNT_STATE = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
#: How many micro-batches the checkpoint goes back. Two: the last one, and the one it is repeated from.
KEPT_BATCHES = "spark.sql.streaming.minBatchesToRetain"
#: Takes old state out of the checkpoint and the workers' copy off their disks at the end of each task.
UNLOAD_STATE = "spark.sql.streaming.stateStore.unloadOnCommit"
#: Drops shuffled rows when the job that shuffled them ends, not when the driver happens to collect its garbage.
DROP_SHUFFLED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACK_STATE = "spark.sql.streaming.stateStore.rocksdb.compression"
#: Keeps state on local disk with a copy in the checkpoint, beyond what executor memory holds.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landed(spark: SparkSession, landing: str, months: Sequence[str] | None = None) -> DataFrame:
    """All landed lines, or those of some months, each once (a line id stands for one line of one month)."""
    lines = spark.read.schema(LANDED_LINES).parquet(landing)
    if months is not None:
        lines = lines.where(F.col("month").isin(*months))
    return lines.dropDuplicates(["line_id", "month"])


def _add_up(lines: DataFrame, month: str) -> DataFrame:
    """One row per group, beneficiary and ``month`` (name of the column that tells it)."""
    return lines.groupBy(*GROUP, month, "beneficiary_id").agg(
        F.sum("claims").alias("claims"), F.sum("paid").alias("paid"), F.count(F.lit(1)).alias("lines")
    )


def people(lines: DataFrame, lateness: int) -> DataFrame:
    """Streaming lines -> what each beneficiary adds to a group (``month_start``), all rows of a month when it is closed."""
    month_start = F.to_timestamp(F.concat("month", F.lit("-01")), "yyyy-MM-dd")
    timed = lines.where(F.col("month").isNotNull()).withColumn("month_start", month_start).drop("month")
    once = timed.withWatermark("month_start", f"{31 * lateness} days").dropDuplicates(["line_id", "month_start"])
    return _add_up(once, "month_start")


def groups(people: DataFrame, month: str) -> DataFrame:
    """All people of some months -> the sums of ROLLED."""
    return people.groupBy(*GROUP, month).agg(
        F.sum("claims").cast("bigint").alias("total_claims"),
        F.count("beneficiary_id").alias("total_unique_beneficiaries"),
        F.round(F.sum("paid"), 2).cast(schemas.MONEY).alias("total_paid"),
        F.sum("lines").alias("lines"),
    )


def closed_months(people: DataFrame) -> DataFrame:
    """The people that one micro-batch lets go -> rows of ROLLED."""
    rolled = groups(people, "month_start").withColumn("month", F.date_format("month_start", "yyyy-MM"))
    return rolled.select(*ROLLED.fieldNames())


def _write(rows: DataFrame, batch_id: int, root: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/closed/batch={batch_id}")


def start_rollup(spark: SparkSession, landing: str, root: str, checkpoint: str, lateness: int = 3,
                 available_now: bool = True, state_store: str = ROCKSDB, count_state: bool = True) -> StreamingQuery:
    """Start the stream; ``available_now`` takes in what has landed, then stops. Without
    ``count_state`` its progress does not tell how many rows the state has, and it runs faster.

    State lies in the checkpoint folder, so it must be on shared storage and kept between runs.
    """
    read_at_start = {
        STATE_STORE: state_store, COUNT_STATE: str(count_state).lower(), KEPT_BATCHES: "2", PACK_STATE: "zstd",
        UNLOAD_STATE: str(available_now).lower(), DROP_SHUFFLED: "true",
    }
    with settings(spark, read_at_start):
        lines = spark.readStream.schema(LANDED_LINES).parquet(landing)
        writer = people(lines, lateness).writeStream.outputMode("append").foreachBatch(
            lambda rows, batch_id: _write(closed_months(rows), batch_id, root)
        ).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
        return writer.start()


def dropped_late(query: StreamingQuery) -> int:
    """Lines of closed months that the recent micro-batches dropped; more than 0 calls for :func:`reconcile`."""
    first = "dedupe"  # late lines go at the first stateful operator
    return sum(
        op["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for op in progress["stateOperators"]
        if op["operatorName"] == first
    )


def _closed(spark: SparkSession, root: str) -> DataFrame:
    """Rows of closed months; a month that was reconciled comes from the last reconciliation."""
    rolled = spark.createDataFrame([], ROLLED)
    if storage.exists(spark, f"{root}/closed"):
        rolled = spark.read.schema(ROLLED).parquet(f"{root}/closed").select(*ROLLED.fieldNames())
    if not storage.exists(spark, f"{root}/again"):
        return rolled
    again = spark.read.schema(T.StructType([*ROLLED.fields, T.StructField("run", T.LongType())])).parquet(f"{root}/again")
    last = again.groupBy("month").agg(F.max("run").alias("run"))
    kept = rolled.join(last.select("month"), "month", "left_anti").select(*ROLLED.fieldNames())
    return kept.unionByName(again.join(last, ["month", "run"], "left_semi").select(*ROLLED.fieldNames()))


def _roll(lines: DataFrame) -> DataFrame:
    """Batch rollup with the number of lines, as two steps like the stream."""
    return groups(_add_up(lines, "month"), "month").select(*ROLLED.fieldNames())


def reconcile(spark: SparkSession, landing: str, root: str) -> list[str]:
    """Roll closed months up again whose landed lines are more than were counted; returns them.

    An audit over all landed lines; call it when :func:`dropped_late` says so. Lines are counted
    as they landed first (the month is read, nothing is shuffled): a month of no more lines than
    were counted misses none. Line ids are compared in the other months only. Running it again
    finds nothing and writes nothing.
    """
    counted = {r["month"]: r["n"] for r in _closed(spark, root).groupBy("month").agg(F.sum("lines").alias("n")).collect()}

    def other(lines: DataFrame) -> list[str]:
        there = lines.where(F.col("month").isNotNull()).groupBy("month").agg(F.count(F.lit(1)).alias("n")).collect()
        return [r["month"] for r in there if r["n"] != counted.get(r["month"], r["n"])]

    short = other(spark.read.schema(LANDED_LINES).parquet(landing))
    if short:
        short = other(landed(spark, landing, short))
    if short:
        run = 1
        while storage.exists(spark, f"{root}/again/run={run}"):
            run += 1
        _roll(landed(spark, landing, short)).write.option("compression", "zstd").parquet(f"{root}/again/run={run}")
    return sorted(short)


def load_rollup(spark: SparkSession, landing: str, root: str) -> DataFrame:
    """The rollup of all landed lines (CLAIMS_MONTHLY).

    Closed months are read as emitted. Open months and undated lines are rolled up here; which
    months are closed is joined in, so the lines of closed months are read no further than the
    month column's statistics allow.
    """
    closed = _closed(spark, root)
    months = closed.select("month").distinct()
    lines = spark.read.schema(LANDED_LINES).parquet(landing)
    rest = lines.join(F.broadcast(months), "month", "left_anti").dropDuplicates(["line_id", "month"])
    return closed.unionByName(_roll(rest)).select(*schemas.CLAIMS_MONTHLY.fieldNames())
