"""Incremental hourly aggregation, its freshness gate and the file streams they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hourspark.functions.timestamps import epoch_micros, floor_hour, from_epoch_micros, from_instant, instant
from hourspark.operators.ordered import latest
from hourspark.operators.quality import freshness
from hourspark.session import run_dir


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of part files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name files as well as folders


def summed_hours(rows: DataFrame, at: str, unit: list[str], motor: Column, count: Column, home: str, delay: str = "10 minutes") -> DataFrame:
    """Hourly countline totals of a whole stream, however late its rows come; see ``closed_hours`` for the revisions.

    ``home`` is the job's own folder: another run goes on from there, reads only files it has not seen, and its
    sums join those of the runs before.  Each micro-batch writes its own sums by day under its number, so a
    repeated batch replaces itself.  Sums are additive: a late row is one more summand of its hour and nothing is
    dropped.  Hours are given out once all rows seen lie ``delay`` past their end.
    """
    spark = rows.sparkSession
    seen = instant(F.col(at))

    def keep(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*unit, floor_hour(from_instant(seen)).alias("hour")).agg(
            F.sum(F.when(motor, count)).alias("motor_count"), F.count_if(motor).alias("motor_rows"), F.count_if(~motor).alias("other_rows"),
            F.count(F.lit(1)).alias("rows"), F.max(seen).alias("latest"),
        )
        sums.withColumn("day", F.to_date("hour")).write.mode("overwrite").partitionBy("day").parquet(f"{home}/sums/batch={number}")
        _revise(spark, home, unit, number, delay)

    query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return closed_hours(spark, home, unit)


_SUMS = ("motor_count", "motor_rows", "other_rows", "rows")


def _totals(sums: DataFrame, unit: list[str]) -> DataFrame:
    """vehicle_count is the sum of motor classes, or a derived zero if only others were seen."""
    hours = sums.groupBy(*unit, "hour").agg(*[F.sum(c).alias(c) for c in _SUMS])
    derived = (F.col("motor_rows") == 0) & (F.col("other_rows") > 0)
    total = F.when(derived, F.lit(0)).otherwise(F.col("motor_count")).cast("double")
    return hours.select(*unit, "hour", total.alias("vehicle_count"), "motor_rows", "other_rows", "rows", derived.alias("derived_zero"))


def _revise(spark: SparkSession, home: str, unit: list[str], number: int, delay: str) -> None:
    """Write what batch ``number`` closes or changes: hours that are closed now with their total before, if they
    were closed then, and now.  Only days that the batch touches or that end in between are read."""
    sums = spark.read.parquet(f"{home}/sums")
    past = F.expr(f"INTERVAL {delay}")
    own = sums.filter(F.col("batch") == number)
    # Two instants and the batch's days: small scalars, whatever the batch holds.
    before = spark.read.parquet(f"{home}/clock").filter(F.col("at") < number).agg(F.max("latest_us")).first()[0] if number else None
    days = [r.day for r in own.filter("day IS NOT NULL").select("day").distinct().collect()]
    now = own.agg(F.unix_micros(F.max("latest"))).first()[0]
    now = max((us for us in (before, now) if us is not None), default=None)
    spark.createDataFrame([(now,)], "latest_us long").write.mode("overwrite").parquet(f"{home}/clock/at={number}")
    if now is None:
        return
    ends = instant(F.col("hour")) + F.expr("INTERVAL 1 HOUR")
    moment = lambda us: F.timestamp_micros(F.lit(us)) - past
    known = sums.filter((F.col("batch") <= number) & (ends <= moment(now)))
    was = F.lit(False)
    if before is not None:  # the batch's days, and those in which hours have closed since
        was = ends <= moment(before)
        known = known.filter(F.col("day").isin(days) | F.col("day").between(F.date_sub(F.to_date(from_instant(moment(before))), 1), F.to_date(from_instant(moment(now)))))
    after = _totals(known, unit)
    old = _totals(known.filter((F.col("batch") < number) & was), unit).select(*unit, "hour", F.col("vehicle_count").alias("old_count"), F.col("rows").alias("old_rows"))
    same = F.lit(True)
    for c in (*unit, "hour"):
        same &= F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    changed = after.alias("n").join(old.alias("o"), same, "left").filter("o.old_rows IS NULL OR o.old_rows <> n.rows")
    changed.select("n.*", "o.old_count", "o.old_rows").write.mode("overwrite").parquet(f"{home}/revisions/batch={number}")


def closed_hours(spark: SparkSession, home: str, unit: list[str]) -> DataFrame:
    """The last revision of every closed hour of the job in ``home``."""
    revisions = spark.read.parquet(f"{home}/revisions")
    return latest(revisions, [*unit, "hour"], ["batch"]).drop("old_count", "old_rows", "batch")


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process all available input into a Parquet table in the shared folder and return the table."""
    spark = stream.sparkSession
    home = run_dir(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{home}/state")
        .trigger(availableNow=True).start(f"{home}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def watch_freshness(
    stream: DataFrame, checkpoint: str, keys: list[str], instant: str, lags: list[str], as_of: Column,
    publish: Callable[[DataFrame, int], None],
) -> StreamingQuery:
    """Run the freshness gate on every updated batch of a feature table and hand the result to ``publish``."""

    def gate(batch: DataFrame, number: int) -> None:
        publish(freshness(batch, keys, instant, lags, as_of), number)

    return stream.writeStream.foreachBatch(gate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gated(stream: DataFrame, home: str, keys: list[str], instant: str, lags: list[str], behind: str) -> DataFrame:
    """The freshness gate on a table that grows: statuses of all units after every batch, as a table.

    A unit is stale once its newest row lies more than ``behind`` before the newest row of all.  The job keeps
    the newest row of each unit (of equal instants the one of the greatest lags) and nothing else, so a batch costs the batch and the units.  ``home`` is the
    job's own folder; a second run goes on from there, and a repeated batch replaces itself.
    """
    spark = stream.sparkSession

    def gate(batch: DataFrame, number: int) -> None:
        rows = batch.select(*keys, instant, *lags)
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{home}/newest/at={number - 1}"))
        latest(rows, keys, [instant, *lags]).write.mode("overwrite").parquet(f"{home}/newest/at={number}")
        newest = spark.read.schema(rows.schema).parquet(f"{home}/newest/at={number}")
        as_of = newest.agg(epoch_micros(F.max(instant) - F.expr(f"INTERVAL {behind}"))).first()[0]
        freshness(newest, keys, instant, lags, from_epoch_micros(F.lit(as_of))).write.mode("overwrite").parquet(f"{home}/statuses/batch={number}")

    query = stream.writeStream.foreachBatch(gate).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{home}/statuses")
