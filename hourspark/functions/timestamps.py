"""Wall-clock time, zones and calendar columns.

Instants are held as TIMESTAMP_NTZ in UTC and publisher times as TIMESTAMP_NTZ wall time, so no
result depends on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MELBOURNE = "Australia/Melbourne"
MELBOURNE_STANDARD_MINUTES = 600
MICROS_PER_HOUR = 3_600_000_000


def ntz(col: Column) -> Column:
    return col.cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of an NTZ value, read as UTC."""
    seconds = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint")
    fraction = F.call_function("date_part", F.lit("SECOND"), ts)
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * F.lit(86_400_000_000)
        + seconds * F.lit(1_000_000)
        + (fraction * 1_000_000).cast("bigint")
    )


def from_epoch_micros(micros: Column) -> Column:
    """NTZ value (UTC) of microseconds since 1970."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")
    )


def instant(utc: Column) -> Column:
    """TIMESTAMP of an NTZ value read as UTC, whatever the session zone."""
    return F.timestamp_micros(epoch_micros(utc))


def from_instant(ts: Column) -> Column:
    """NTZ value in UTC of a TIMESTAMP."""
    return from_epoch_micros(F.unix_micros(ts))


def iso_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of an NTZ value."""
    return F.translate(F.substring(ts.cast("string"), 1, 19), " ", "T")


def plus(ts: Column, hours: int = 0, minutes: int = 0) -> Column:
    return ts + F.expr(f"make_dt_interval(0, {hours}, {minutes}, 0)")


def floor_hour(ts: Column) -> Column:
    """Start of the hour of an NTZ value."""
    whole = F.make_dt_interval(F.lit(0), F.hour(ts), F.lit(0), F.lit(0))
    return ntz(F.to_date(ts)) + whole


def at_hour(day: Column, hour: Column) -> Column:
    """NTZ value at ``hour`` o'clock of a date."""
    return ntz(day) + F.make_dt_interval(F.lit(0), hour.cast("int"), F.lit(0), F.lit(0))


def _local_micros(micros: Column, zone: str) -> Column:
    """Local wall time, as micros, of an instant; arithmetic on instants only, whatever the session zone."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone))


def offset_minutes(utc: Column, zone: str = MELBOURNE) -> Column:
    """Local offset of an instant in minutes."""
    micros = epoch_micros(utc)
    return ((_local_micros(micros, zone) - micros) / F.lit(60_000_000)).cast("int")


def utc_to_local(utc: Column, zone: str = MELBOURNE) -> Column:
    return utc + F.make_dt_interval(F.lit(0), F.lit(0), offset_minutes(utc, zone), F.lit(0))


def _readings(wall: Column, zone: str, standard_minutes: int) -> tuple[Column, Column]:
    """Whether a wall time is real when read as standard time and when read as summer time."""
    micros = epoch_micros(wall)
    real = lambda minutes: _local_micros(micros - F.lit(minutes * 60_000_000), zone) == micros
    return real(standard_minutes), real(standard_minutes + 60)


def wall_status(wall: Column, zone: str = MELBOURNE, standard_minutes: int = MELBOURNE_STANDARD_MINUTES) -> Column:
    """Struct(is_dst, ambiguous, nonexistent); ``is_dst`` is null where the offset is undecided.

    Of the two instants a wall time can mean, both are real in the repeated hour and neither in the skipped one.
    """
    standard_ok, summer_ok = _readings(wall, zone, standard_minutes)
    return F.struct(
        F.when(standard_ok != summer_ok, summer_ok).alias("is_dst"),
        (standard_ok & summer_ok).alias("ambiguous"),
        (~standard_ok & ~summer_ok).alias("nonexistent"),
    )


def wall_to_utc(wall: Column, zone: str = MELBOURNE, standard_minutes: int = MELBOURNE_STANDARD_MINUTES) -> Column:
    """UTC of a wall time, standard time in the repeated hour; null if the time does not exist."""
    standard_ok, summer_ok = _readings(wall, zone, standard_minutes)
    shift = F.when(standard_ok, standard_minutes).when(summer_ok, standard_minutes + 60)
    return wall - F.make_dt_interval(F.lit(0), F.lit(0), shift, F.lit(0))


def wall_text(text: Column) -> Column:
    """Wall time of a text whose trailing ``Z`` is wrong; null unless it ends in ``Z``."""
    trimmed = F.trim(text)
    body = F.regexp_replace(F.regexp_replace(trimmed, "Z$", ""), "T", " ")
    return F.when(trimmed.endswith("Z"), body.try_cast("timestamp_ntz"))


def fixed_offset_hour(day: Column, hour: Column, offset_minutes: int = MELBOURNE_STANDARD_MINUTES) -> Column:
    """UTC hour of a source that never observes daylight saving."""
    return plus(at_hour(day, hour), minutes=-offset_minutes)


def fallback_wrap(start: Column, end: Column, zone: str = MELBOURNE) -> Column:
    """A wall interval that runs backwards because the clock was set back inside it."""
    return (
        (end < start)
        & (F.to_date(end) == F.to_date(start))
        & wall_status(start, zone)["ambiguous"]
        & wall_status(end, zone)["ambiguous"]
    )


def day_number(day: Column, week_start: str) -> Column:
    """Day of the week as 0-6, counted from ``sunday`` or from ``monday``."""
    if week_start == "sunday":
        return F.dayofweek(day) - 1
    if week_start == "monday":
        return F.weekday(day)
    raise ValueError(f"week_start must be 'sunday' or 'monday', not {week_start!r}")


def calendar_columns(day: Column, week_start: str = "monday") -> dict[str, Column]:
    return {
        "year": F.year(day).cast("smallint"),
        "month": F.month(day).cast("tinyint"),
        "day_of_month": F.dayofmonth(day).cast("tinyint"),
        "day_of_week": day_number(day, week_start).cast("tinyint"),
        "is_weekend": F.weekday(day) >= 5,
    }


def cyclic(name: str, value: Column, period: float) -> dict[str, Column]:
    """``<name>_sin`` and ``<name>_cos`` of a cyclic value."""
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(period))
    known = {"asof": "always"}  # a calendar value is known of any hour
    return {n: f(angle).alias(n, metadata=known) for n, f in ((f"{name}_sin", F.sin), (f"{name}_cos", F.cos))}


def direction_components(degrees: Column) -> tuple[Column, Column]:
    """Sine and cosine of a compass direction, to be averaged instead of the angle."""
    radians = degrees * F.pi() / F.lit(180.0)
    return F.sin(radians), F.cos(radians)


def year_ranges(start: Column, end: Column) -> Column:
    """Array of struct(first, last): the interval cut at calendar years."""
    return F.transform(
        F.sequence(F.year(start), F.year(end)),
        lambda y: F.struct(
            F.greatest(start, F.make_date(y, F.lit(1), F.lit(1))).alias("first"),
            F.least(end, F.make_date(y, F.lit(12), F.lit(31))).alias("last"),
        ),
    )


def date_from_columns(columns: list[str]) -> Column:
    """Local date of a row: its date, else its time stamp, else its year, month and day."""
    choices = [F.to_date(c) for c in ("local_date", "local_timestamp", "observed_at_local") if c in columns]
    if {"year", "month", "day"} <= set(columns):
        choices.append(F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int")))
    if not choices:
        raise ValueError("no date, time stamp or year, month and day among the columns")
    return F.coalesce(*choices)
