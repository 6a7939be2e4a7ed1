"""Hourly aggregates of feeds, five-minute class counts and quarter-hour slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.functions.labels import MODES
from hourspark.functions.timestamps import plus
from hourspark.operators.ordered import cumulated_counts


def hourly_counts(df: DataFrame, unit: list[str], hour: Column, name: str = "n", hour_name: str = "hour") -> DataFrame:
    """Rows per unit and hour; hours without rows stay absent."""
    return df.groupBy(*unit, hour.alias(hour_name)).agg(F.count(F.lit(1)).alias(name))


def hourly_means(df: DataFrame, hour: str, means: dict[str, Column], count_name: str) -> DataFrame:
    """Mean of each column per hour with the number of rows; rows without an hour are left out."""
    return df.filter(F.col(hour).isNotNull()).groupBy(hour).agg(
        *[F.avg(c).alias(n) for n, c in means.items()], F.count(F.lit(1)).alias(count_name)
    )


def exact_median(df: DataFrame, keys: list[str], columns: dict[str, str], width: float = 0.1) -> DataFrame:
    """Exact median per key of several columns, without holding a key's values in one task.

    Values are first counted (equal readings collapse map-side), then ordered in slices of ``width``.
    The median is the mean of the two middle elements.
    """
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("v")) for n, c in columns.items()
    ])).alias("m")).select(*keys, "m.name", "m.v").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    sized = cumulated_counts(long, [*keys, "name"], "v", width)
    first, second = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    holds = lambda r: (F.col("_cum") >= r) & (F.col("_cum") - F.col("_n") < r)
    middle = sized.filter(holds(first) | holds(second)).groupBy(*keys, "name").agg(
        ((F.min("v") + F.max("v")) / 2).alias("median")
    )
    wide = middle.groupBy(*keys).pivot("name", list(columns)).agg(F.first("median"))
    return wide


def hourly_medians(
    df: DataFrame, hour: str, columns: dict[str, str], device: str, device_name: str, count_name: str,
    shift_hours: int = 1, width: float = 0.1,
) -> DataFrame:
    """Median readings per hour with active devices and readings, moved ``shift_hours`` later so that
    they are known before the hour they describe."""
    timed = df.filter(F.col(hour).isNotNull())
    counts = timed.groupBy(hour).agg(F.count_distinct(device).alias(device_name), F.count(F.lit(1)).alias(count_name))
    joined = counts.join(exact_median(timed, [hour], columns, width), hour, "left")
    return joined.withColumn(hour, plus(F.col(hour), hours=shift_hours)).select(
        hour, *columns, device_name, count_name
    )


def mode_counts(
    df: DataFrame, hour: str, mode: Column, count: Column, location: str | None, prefix: str = "transport",
    suffix: str = "_lag_1h", shift_hours: int = 1,
) -> DataFrame:
    """Counts per hour by travel mode in a fixed set of columns; an absent mode stays null.

    Distinct locations are counted over the whole hour, never summed over parts.
    """
    value = F.when(count >= 0, count)
    usable = df.withColumn("_mode", mode).withColumn("_v", value).filter(F.col(hour).isNotNull() & F.col("_v").isNotNull())
    place = F.col(location) if location else F.lit("unknown")
    out = usable.groupBy(hour).agg(
        *[F.sum(F.when(F.col("_mode") == m, F.col("_v"))).alias(f"{prefix}_{m}_count{suffix}") for m in MODES],
        F.count_distinct(place).alias(f"{prefix}_active_location_count{suffix}"),
        F.count(F.lit(1)).alias(f"{prefix}_observation_count{suffix}"),
    )
    return out.withColumn(hour, plus(F.col(hour), hours=shift_hours))


def mode_value(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Most frequent non-null value per key, ties to the larger one, with a flag for several values."""
    counted = df.withColumn("_v", value).filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return counted.groupBy(*keys).agg(
        F.max_by("_v", F.struct("_n", "_v")).alias(name), (F.count(F.lit(1)) > 1).alias(f"{name}_drift")
    )


def single_or_null(col: Column) -> Column:
    """The value of a group when it is the only distinct one, otherwise null."""
    return F.when(F.min(col) == F.max(col), F.min(col))


def slots_long(df: DataFrame, keep: list[str], slots: list[str], position: str = "slot", value: str = "reading") -> DataFrame:
    """One row per slot column; the position is its place in ``slots``."""
    return df.select(*keep, F.posexplode(F.array(*slots)).alias(position, value))


def value_frequency(df: DataFrame, slots: list[str], keys: list[str] = ()) -> DataFrame:
    """How often each negative reading occurs."""
    long = slots_long(df, list(keys), slots)
    return long.filter("reading < 0").groupBy(*keys, "reading").agg(F.count(F.lit(1)).alias("occurrences"))
