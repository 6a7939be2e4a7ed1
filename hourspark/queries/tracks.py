"""Paths and tracks: each user's events in time order, at positions computed from the event id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.functions.timestamps import epoch_micros
from hourspark.operators import ordered, tracks
from hourspark.queries import Tables, query, rounded
from hourspark.queries.spatial import metres_sql, spread, spread_sql
from hourspark.session import cut

TRACK_AT = {"lon": (7919, 10007, 144.95, 0.02), "lat": (104729, 10009, -37.82, 0.015)}


def positions(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("user_id").alias("route_id"), "ts", *[spread(F.col("event_id"), *a).alias(n) for n, a in TRACK_AT.items()])


def paths(t: Tables) -> DataFrame:
    part = ordered.slice_of(epoch_micros(F.col("ts")), ordered.DAY_MICROS)
    placed = ordered.numbered(positions(t), ["route_id"], ["ts", "event_id"], part)
    return cut(placed.select("route_id", (F.col("rn") - 1).alias("seq"), "lon", "lat"))


TRACK_SQL = f"""p AS (SELECT event_id, user_id AS route_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, {', '.join(f'{spread_sql("event_id", *a)} AS {n}' for n, a in TRACK_AT.items())} FROM events)"""
STEP = metres_sql("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat")
W = "WINDOW w AS (PARTITION BY route_id ORDER BY seq)"
BEARING = """((degrees(atan2(sin(radians({x2} - {x1})) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos(radians({x2} - {x1})))) + 360) % 360)"""
ALONG_SQL = f"""{TRACK_SQL}, st AS (SELECT *, coalesce({STEP}, 0) AS step FROM p {W}), r AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS walked FROM st),
  a AS (SELECT *, max(walked) OVER (PARTITION BY route_id) AS total FROM r)"""
TURN_SQL = f"""b AS (SELECT *, {BEARING.format(x1='lag(lon) OVER w', y1='lag(lat) OVER w', x2='lon', y2='lat')} AS b_in, {BEARING.format(x1='lon', y1='lat', x2='lead(lon) OVER w', y2='lead(lat) OVER w')} AS b_out FROM a {W}),
  d AS (SELECT *, CASE WHEN b_out - b_in > 180 THEN b_out - b_in - 360 WHEN b_out - b_in <= -180 THEN b_out - b_in + 360 ELSE b_out - b_in END AS diff FROM b)"""


@query(f"WITH {ALONG_SQL}, {TURN_SQL} SELECT route_id, seq, CASE WHEN diff > 0 THEN 'right' ELSE 'left' END AS direction, round(abs(diff), 4) AS angle_deg FROM d WHERE abs(diff) >= 30")
def turns(t: Tables) -> DataFrame:
    return rounded(tracks.turns(paths(t)), "angle_deg", digits=4)


@query(f"WITH {ALONG_SQL} SELECT route_id, seq, round(walked, 3) AS walked_m, round(total - walked, 3) AS remaining_m FROM a")
def path_progress(t: Tables) -> DataFrame:
    return rounded(tracks.along(paths(t)).select("route_id", "seq", "walked_m", "remaining_m"), "walked_m", "remaining_m", digits=3)


@query(f"""WITH {ALONG_SQL}, {TURN_SQL}, tn AS (SELECT route_id, seq, walked, CASE WHEN diff > 0 THEN 'right' ELSE 'left' END AS direction FROM d WHERE abs(diff) >= 30),
  n AS (SELECT a.route_id, a.seq, a.walked AS here, min(tn.seq) AS nxt FROM a LEFT JOIN tn ON tn.route_id = a.route_id AND tn.seq > a.seq GROUP BY 1, 2, 3)
  SELECT n.route_id, n.seq, direction, round(walked - here, 3) AS distance_m FROM n LEFT JOIN tn ON tn.route_id = n.route_id AND tn.seq = nxt""")
def next_turns(t: Tables) -> DataFrame:
    path = paths(t)
    return rounded(tracks.next_turn(path.select("route_id", "seq"), path), "distance_m", digits=3)


@query(f"""WITH {ALONG_SQL}, f AS (SELECT event_id, user_id AS route_id, {spread_sql('event_id', 6151, 9973, 144.95, 0.02)} AS lon, {spread_sql('event_id', 15485863, 9967, -37.82, 0.015)} AS lat FROM events),
  x AS (SELECT f.event_id, a.route_id, seq, {metres_sql('f.lon', 'f.lat', 'a.lon', 'a.lat')} AS m, total - walked AS left_m FROM f JOIN a ON a.route_id = f.route_id QUALIFY row_number() OVER (PARTITION BY f.event_id ORDER BY m, seq) = 1)
  SELECT event_id, route_id, seq, round(m + left_m, 3) AS remaining_m FROM x""")
def nearest_vertex(t: Tables) -> DataFrame:
    fixes = t.events.select(
        "event_id", F.col("user_id").alias("route_id"), spread(F.col("event_id"), 6151, 9973, 144.95, 0.02).alias("lon"), spread(F.col("event_id"), 15485863, 9967, -37.82, 0.015).alias("lat"),
    )
    return rounded(tracks.progress(fixes, paths(t)).select("event_id", "route_id", "seq", "remaining_m"), "remaining_m", digits=3)


@query(f"""WITH {TRACK_SQL}, n AS (SELECT route_id, count(*) AS n, count(*) * 100.0 AS m FROM p GROUP BY 1),
  k AS (SELECT route_id, seq, n, m, greatest(1, n // least(11, greatest(1, round_even(m / 250, 0)::INTEGER))) AS stride FROM p JOIN n USING (route_id))
  SELECT route_id, seq FROM k WHERE CASE WHEN n <= 2 THEN seq = 0 OR seq = n - 1 ELSE seq % stride = 0 OR seq = n - 1 END""")
def path_samples(t: Tables) -> DataFrame:
    path = paths(t)
    length = path.groupBy("route_id").agg((F.count(F.lit(1)) * 100.0).alias("m"))
    return tracks.samples(path.join(length, "route_id"), "m").select("route_id", "seq")


WALK_SQL = f"""{TRACK_SQL}, m AS (SELECT *, {STEP} AS moved, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0::DOUBLE AS secs FROM p {W})"""


@query(f"WITH {WALK_SQL} SELECT route_id, round(sum(CASE WHEN moved >= 4 THEN least(moved, 4 * greatest(0.001, secs)) ELSE 0 END), 3) AS walked_m, count(*) AS fixes FROM m GROUP BY 1")
def walked_distance(t: Tables) -> DataFrame:
    return rounded(tracks.walked_distance(positions(t), "route_id", "ts", ["event_id"]), "walked_m", digits=3)


@query("""WITH u AS (SELECT event_id, user_id, ts, floor(value / 10) AS r FROM events), c AS (SELECT *, lag(r) OVER w AS pr, row_number() OVER w AS k FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  x AS (SELECT *, CASE WHEN r <= 4 THEN 1 ELSE 0 END AS hit FROM c WHERE k = 1 OR r IS DISTINCT FROM pr),
  y AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) AS s FROM x)
  SELECT user_id, min(ts) AS confirmed_at FROM y WHERE s = 3 GROUP BY 1""")
def arrival_runs(t: Tables) -> DataFrame:
    """First time a user's reading was at most 4 (tens) on three changed updates in a row."""
    updates = t.events.select("event_id", "user_id", "ts", F.floor(F.col("value") / 10).alias("r"))
    return tracks.first_confirmed(updates, F.col("r") <= 4, "r", "user_id", "ts", ["event_id"])
