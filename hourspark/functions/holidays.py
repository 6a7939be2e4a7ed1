"""Public holidays of Victoria as a date dimension built from rules, with override rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.operators.quality import date_spine


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter Sunday (anonymous computus)."""
    div = lambda a, b: F.floor(a / F.lit(b)).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    m = (2 * e + 2 * i - h - k + 32) % 7
    n = div(a + 11 * h + 22 * m, 451)
    month = div(h + m - 7 * n + 114, 31)
    day = (h + m - 7 * n + 114) % 31 + 1
    return F.make_date(year, month, day)


def nth_weekday(year: Column, month: int, weekday: int, nth: int) -> Column:
    """The nth weekday (Monday is 0) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (nth - 1))


def _next_weekday(day: Column) -> Column:
    """The day itself, or the Monday after a weekend day."""
    return F.when(F.weekday(day) == 5, F.date_add(day, 2)).when(F.weekday(day) == 6, F.date_add(day, 1))


def _rules(year: Column) -> list[tuple[str, Column]]:
    fixed = lambda month, day: F.make_date(year, F.lit(month), F.lit(day))
    easter = easter_sunday(year)
    christmas, boxing = fixed(12, 25), fixed(12, 26)
    return [
        ("New Year's Day", fixed(1, 1)),
        ("New Year's Day (observed)", _next_weekday(fixed(1, 1))),
        ("Australia Day", F.coalesce(_next_weekday(fixed(1, 26)), fixed(1, 26))),
        ("Labour Day", nth_weekday(year, 3, 0, 2)),
        ("Good Friday", F.date_sub(easter, 2)),
        ("Easter Saturday", F.date_sub(easter, 1)),
        ("Easter Sunday", easter),
        ("Easter Monday", F.date_add(easter, 1)),
        ("Anzac Day", fixed(4, 25)),
        ("King's Birthday", nth_weekday(year, 6, 0, 2)),
        ("Melbourne Cup", nth_weekday(year, 11, 1, 1)),
        ("Christmas Day", christmas),
        ("Christmas Day (observed)", F.when(F.weekday(christmas) >= 5, F.date_add(christmas, 2))),
        ("Boxing Day", boxing),
        ("Boxing Day (observed)", F.when(F.weekday(boxing) >= 5, F.date_add(boxing, 2))),
    ]


def holidays_of(years: DataFrame, year: str = "year") -> DataFrame:
    """(local_date, public_holiday_name) of every rule in each year; names of one date are joined."""
    y = F.col(year)
    rules = F.array(*[F.struct(F.lit(n).alias("name"), d.alias("day")) for n, d in _rules(y)])
    return years.select(F.explode(rules).alias("r")).filter("r.day is not null").groupBy(
        F.col("r.day").alias("local_date")
    ).agg(F.array_join(F.array_sort(F.collect_set("r.name")), "; ").alias("public_holiday_name"))


def holiday_calendar(bounds: DataFrame, first: str, last: str, overrides: DataFrame | None = None) -> DataFrame:
    """(local_date, is_public_holiday, public_holiday_name) for every date between the bounds.

    ``overrides`` (local_date, public_holiday_name) adds proclaimed days; a null name removes a day.
    """
    days = date_spine(bounds, first, last, "local_date")
    named = holidays_of(days.select(F.year("local_date").alias("year")).distinct())
    out = days.join(named, "local_date", "left")
    if overrides is not None:
        extra = overrides.select("local_date", F.col("public_holiday_name").alias("_name"), F.lit(True).alias("_set"))
        out = out.join(extra, "local_date", "left").withColumn(
            "public_holiday_name", F.when(F.col("_set"), F.col("_name")).otherwise(F.col("public_holiday_name"))
        )
    return out.select("local_date", F.col("public_holiday_name").isNotNull().alias("is_public_holiday"), "public_holiday_name")
