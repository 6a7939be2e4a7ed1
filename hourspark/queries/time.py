"""Wall clocks, zones and calendar ranges over order times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.functions import timestamps as ts
from hourspark.operators.quality import report, zone_rules
from hourspark.queries import Tables, query

WALL_SQL = "SELECT o_orderkey, o_orderdate + to_hours((o_orderkey % 24)::INTEGER) AS wall FROM orders"
SIDES_SQL = f"""
w AS ({WALL_SQL}), s AS (SELECT *, wall - INTERVAL 11 HOUR AS summer, wall - INTERVAL 10 HOUR AS standard FROM w),
v AS (SELECT *, (summer AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' = wall AS summer_ok,
  (standard AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' = wall AS standard_ok FROM s)"""


def wall_times(t: Tables) -> DataFrame:
    hour = F.pmod("o_orderkey", F.lit(24)).cast("int")
    return t.orders.select("o_orderkey", ts.at_hour(F.to_date("o_orderdate"), hour).alias("wall"))


@query(f"""WITH {SIDES_SQL} SELECT o_orderkey, wall, CASE WHEN summer_ok <> standard_ok THEN summer_ok END AS is_dst,
  summer_ok AND standard_ok AS ambiguous, NOT summer_ok AND NOT standard_ok AS nonexistent FROM v""")
def dst_status(t: Tables) -> DataFrame:
    return wall_times(t).withColumn("s", ts.wall_status(F.col("wall"))).select("o_orderkey", "wall", "s.*")


@query(f"WITH {SIDES_SQL} SELECT o_orderkey, wall, CASE WHEN standard_ok THEN standard WHEN summer_ok THEN summer END AS utc FROM v")
def wall_to_utc(t: Tables) -> DataFrame:
    text = F.concat(ts.iso_text(F.col("wall")), F.lit("Z"))
    read = wall_times(t).withColumn("wall", ts.wall_text(text))
    return read.withColumn("utc", ts.wall_to_utc(F.col("wall")))


@query(f"""WITH {SIDES_SQL}
  SELECT count(*) AS rows, count(*) FILTER (WHERE summer_ok AND standard_ok) AS wraps FROM v""")
def fallback_wraps(t: Tables) -> DataFrame:
    """Intervals from 55 minutes past an hour back to its start: only the repeated hour may hold them."""
    spans = wall_times(t).select(ts.plus(F.col("wall"), minutes=55).alias("a"), F.col("wall").alias("b"))
    return spans.agg(F.count(F.lit(1)).alias("rows"), F.count_if(ts.fallback_wrap(F.col("a"), F.col("b"))).alias("wraps"))


@query("SELECT event_id, date_trunc('hour', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne') AS local_hour FROM events")
def utc_to_local_hour(t: Tables) -> DataFrame:
    return t.events.select("event_id", ts.floor_hour(ts.utc_to_local(F.col("ts"))).alias("local_hour"))


@query("""SELECT l_orderkey, l_linenumber, l_shipdate + to_hours((l_linenumber % 24)::INTEGER) - INTERVAL 10 HOUR AS hour_start_utc, count(*) AS copies
  FROM lineitem GROUP BY 1, 2, 3""")
def fixed_offset_hours(t: Tables) -> DataFrame:
    start = ts.fixed_offset_hour(F.to_date("l_shipdate"), F.col("l_linenumber"))
    return t.lineitem.groupBy("l_orderkey", "l_linenumber", start.alias("hour_start_utc")).agg(F.count(F.lit(1)).alias("copies"))


@query("""WITH b AS (SELECT o_orderpriority, min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders GROUP BY 1),
  y AS (SELECT *, unnest(generate_series(year(lo), year(hi))) AS y FROM b)
  SELECT o_orderpriority, greatest(lo, make_date(y, 1, 1)) AS first, least(hi, make_date(y, 12, 31)) AS last FROM y""")
def calendar_year_ranges(t: Tables) -> DataFrame:
    bounds = t.orders.groupBy("o_orderpriority").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    cut = bounds.select("o_orderpriority", F.explode(ts.year_ranges(F.col("lo"), F.col("hi"))).alias("r"))
    return cut.select("o_orderpriority", "r.first", "r.last")


@query("""WITH z AS (SELECT ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Melbourne' AS local, ts + INTERVAL 11 HOUR AS stored,
    (ts + INTERVAL 11 HOUR)::DATE AS day, hour(ts + INTERVAL 10 HOUR) AS hr FROM events),
  c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE stored IS DISTINCT FROM local) AS local_timestamp_mismatch,
    count(*) FILTER (WHERE day IS DISTINCT FROM local::DATE) AS local_date_mismatch, count(*) FILTER (WHERE hr IS DISTINCT FROM hour(local)) AS local_hour_mismatch FROM z)
  UNPIVOT c ON COLUMNS(*) INTO NAME name VALUE violations""")
def zone_cross_check(t: Tables) -> DataFrame:
    stored = t.events.select("ts", ts.plus(F.col("ts"), hours=11).alias("local")).withColumns({
        "day": F.to_date("local"), "hr": F.hour(ts.plus(F.col("ts"), hours=10)),
    })
    return report(stored, zone_rules("ts", "local", "day", "hr", ts.MELBOURNE))


@query("""SELECT o_orderkey, year(o_orderdate)::SMALLINT AS year, month(o_orderdate)::TINYINT AS month, day(o_orderdate)::TINYINT AS day_of_month,
  (isodow(o_orderdate) - 1)::TINYINT AS day_of_week, isodow(o_orderdate) >= 6 AS is_weekend FROM orders""")
def calendar_columns(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d")).withColumns(ts.calendar_columns(F.col("d"))).drop("d")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE END, make_date(year(o_orderdate), month(o_orderdate), 1)) AS local_date FROM orders")
def date_of_row(t: Tables) -> DataFrame:
    """The stored date where there is one, else the date of the year, month and day columns."""
    day = F.to_date("o_orderdate")
    parts = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", day).alias("local_date"), F.year(day).alias("year"), F.month(day).alias("month"), F.lit(1).alias("day"))
    return parts.select("o_orderkey", ts.date_from_columns(parts.columns).alias("local_date"))
