"""Streaming jobs over the event table, which arrives in slices; the jobs are stopped and started between them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.functions.timestamps import epoch_micros, instant
from hourspark.queries import Tables, query, rounded
from hourspark.queries.spatial import spread
from hourspark.queries.tracks import TRACK_AT, WALK_SQL
from hourspark.session import run_dir
from hourspark.streaming import hourly, walk

MICROS_SQL = "epoch_us(ts)"


def arriving(t: Tables, slices: int, late: bool, label: str, job: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The result of ``job`` after all events have come, one slice after the other.

    Slices are spans of time, or with ``late`` all slices hold rows of all times.  Each slice is written into the
    input folder and the job is started anew in the same home.
    """
    home = run_dir(t.spark, label)
    events = t.events.withColumn("us", epoch_micros(F.col("ts")))
    low, high = events.agg(F.min("us"), F.max("us")).first()
    place = F.pmod("event_id", F.lit(slices)) if late else F.expr(f"((us - {low}) * {slices}) div ({high} - {low} + 1)")
    for k in range(slices):
        events.filter(place == k).drop("us").write.parquet(f"{home}/in/part{k}")
        stream = t.spark.readStream.schema(t.events.schema).parquet(f"{home}/in/*")
        out = job(stream, home)
    return out


def slices_sql(slices: int) -> str:
    return f"SELECT *, (({MICROS_SQL} - min({MICROS_SQL}) OVER ()) * {slices}) // (max({MICROS_SQL}) OVER () - min({MICROS_SQL}) OVER () + 1) AS slice FROM events"


@query("""SELECT user_id, date_trunc('hour', ts) AS hour, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS motor_rows, count(*) FILTER (WHERE event_type NOT IN ('click', 'purchase')) AS other_rows, count(*) AS rows,
  round(CASE WHEN count(*) FILTER (WHERE event_type IN ('click', 'purchase')) = 0 THEN 0 ELSE sum(CASE WHEN event_type IN ('click', 'purchase') THEN value END) END, 4)::DOUBLE AS vehicle_count,
  count(*) FILTER (WHERE event_type IN ('click', 'purchase')) = 0 AS derived_zero FROM events GROUP BY 1, 2
  HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def stream_hourly(t: Tables) -> DataFrame:
    """Hours that the stream has closed, after two runs; the second run's rows are late for nearly all of them."""
    motor = F.col("event_type").isin("click", "purchase")
    hours = arriving(t, 2, True, "stream-hourly", lambda rows, home: hourly.summed_hours(rows, "ts", ["user_id"], motor, F.col("value"), home))
    return rounded(hours, "vehicle_count", digits=4)


@query(f"""WITH {WALK_SQL} SELECT route_id AS session_id, round(sum(CASE WHEN moved >= 4 THEN least(moved, 4 * greatest(0.001, secs)) ELSE 0 END), 3) AS walked_m, count(*) AS fixes FROM m GROUP BY 1""")
def stream_walk(t: Tables) -> DataFrame:
    """Walked metres per user in five runs; sessions that idled are closed, return and are joined again."""

    def job(events: DataFrame, home: str) -> DataFrame:
        fixes = events.select(
            F.col("user_id").alias("session_id"), "event_id", instant(F.col("ts")).alias("ts"),
            *[spread(F.col("event_id"), *a).alias(n) for n, a in TRACK_AT.items()], (F.col("value") / 10000).alias("remaining_km"),
        )
        return walk.run(fixes, home)

    parts = arriving(t, 5, False, "stream-walk", job)
    return rounded(walk.totals(parts).drop("arrived_at"), "walked_m", digits=3)


@query(f"""WITH s AS ({slices_sql(3)}), b AS (SELECT unnest(range(3)) AS batch), v AS (SELECT batch, user_id, ts, CASE WHEN value > 50 THEN value END AS lag FROM s JOIN b ON slice <= batch),
  n AS (SELECT *, row_number() OVER (PARTITION BY batch, user_id ORDER BY ts DESC, lag DESC NULLS LAST) AS k FROM v),
  a AS (SELECT *, ts < max(ts) OVER (PARTITION BY batch) - INTERVAL 24 HOUR AS stale FROM n WHERE k = 1)
  SELECT batch::BIGINT AS batch, user_id, ts AS newest, CASE WHEN stale OR lag IS NULL THEN 'degraded' ELSE 'ok' END AS status,
    concat_ws(';', CASE WHEN stale THEN 'stale_lag_history' END, CASE WHEN lag IS NULL THEN 'missing_lag_history' END) AS warnings FROM a""")
def stream_freshness(t: Tables) -> DataFrame:
    """Readiness of every user after each of three runs; a user is stale a day behind the newest event.

    An event's value stands for its lag, small ones for an unknown lag.
    """

    def job(events: DataFrame, home: str) -> DataFrame:
        rows = events.select("user_id", F.col("ts").cast("timestamp_ntz").alias("at"), F.when(F.col("value") > 50, F.col("value")).alias("lag"))
        return hourly.gated(rows, home, ["user_id"], "at", ["lag"], "24 HOURS")

    told = arriving(t, 3, False, "stream-freshness", job)
    return told.select(F.col("batch").cast("bigint").alias("batch"), "user_id", "newest", "status", F.array_join("warnings", ";").alias("warnings"))
