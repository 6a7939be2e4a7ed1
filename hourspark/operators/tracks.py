"""Paths and position tracks: turns, progress, samples, walked distance and arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.functions.numbers import half_even
from hourspark.functions.geo import angle_difference, bearing_deg, haversine_m
from hourspark.functions.timestamps import epoch_micros
from hourspark.operators.ordered import DAY_MICROS, first_n, neighbour, running, shifted, slice_of
from hourspark.operators.space import nearest
from hourspark.session import cut

TURN_DEG = 30.0
MIN_MOVE_M = 4.0
MAX_SPEED_M_S = 4.0
ARRIVAL_KM = 0.015
ARRIVAL_UPDATES = 3
SAMPLE_SPACING_M = 250.0
SAMPLE_POINTS = 12
# A slice of a path holds this many vertices.
PATH_SLICE = 4096


def _path_slice() -> Column:
    return F.floor(F.col("seq") / F.lit(PATH_SLICE)).cast("bigint")


def turns(paths: DataFrame, route: str = "route_id", threshold: float = TURN_DEG) -> DataFrame:
    """Inner vertices where the bearing changes by at least ``threshold`` degrees."""
    met = shifted(paths, [route], "seq", ["lon", "lat"], {"before": -1, "after": 1})
    at = lambda a, b: bearing_deg(F.col(f"{a}.lon"), F.col(f"{a}.lat"), F.col(f"{b}.lon"), F.col(f"{b}.lat"))
    bent = met.filter("before is not null and after is not null").withColumn(
        "_diff", angle_difference(at("before", "here"), at("here", "after"))
    )
    return bent.filter(F.abs("_diff") >= threshold).select(
        route, "seq", F.when(F.col("_diff") > 0, "right").otherwise("left").alias("direction"), F.abs("_diff").alias("angle_deg"),
    )


def along(paths: DataFrame, route: str = "route_id") -> DataFrame:
    """(route, seq, walked_m, remaining_m): metres from the start and to the end at every vertex."""
    step = haversine_m(F.col("before.lon"), F.col("before.lat"), F.col("here.lon"), F.col("here.lat"))
    stepped = shifted(paths, [route], "seq", ["lon", "lat"], {"before": -1}).select(route, "seq", F.coalesce(step, F.lit(0.0)).alias("_step"))
    summed = running(
        stepped, [route], ["seq"], _path_slice(), {"walked_m": ("sum", F.col("_step"))}, overall={"_total": "walked_m"}
    )
    return summed.select(route, "seq", "walked_m", F.greatest(F.col("_total") - F.col("walked_m"), F.lit(0.0)).alias("remaining_m"))


def progress(fixes: DataFrame, paths: DataFrame, route: str = "route_id") -> DataFrame:
    """Nearest vertex of its own path for each position fix, and the metres still to go."""
    measured = along(paths, route)
    met = nearest(fixes, paths, "seq", by=[route])
    return met.join(measured.select(route, "seq", "remaining_m"), [route, "seq"], "left").withColumn(
        "remaining_m", F.col("distance_m") + F.col("remaining_m")
    ).select(*fixes.columns, "seq", "remaining_m")


def next_turn(at_vertex: DataFrame, paths: DataFrame, route: str = "route_id") -> DataFrame:
    """Direction of the first turn after each vertex row and the metres to it along the path."""
    measured = cut(along(paths, route).select(route, "seq", "walked_m"))
    bends = turns(paths, route).join(measured.withColumnRenamed("walked_m", "t_m"), [route, "seq"])
    here = at_vertex.select(route, "seq").distinct().join(measured.withColumnRenamed("walked_m", "h_m"), [route, "seq"])
    # Walk the axis backwards: the last turn seen is the next one ahead.
    axis = bends.select(
        route, (-F.col("seq")).alias("_at"), F.lit(1).alias("_ask"), F.struct("direction", "t_m").alias("_turn"), F.lit(None).cast("double").alias("h_m")
    ).unionByName(here.select(
        route, (-F.col("seq")).alias("_at"), F.lit(0).alias("_ask"),
        F.lit(None).cast("struct<direction:string,t_m:double>").alias("_turn"), "h_m",
    ))
    seen = running(axis, [route], ["_at", "_ask"], F.floor(F.col("_at") / F.lit(PATH_SLICE)), {"_next": ("last", F.col("_turn"))})
    answers = seen.filter("_ask = 0").select(
        route, (-F.col("_at")).alias("seq"), F.col("_next.direction").alias("direction"),
        (F.col("_next.t_m") - F.col("h_m")).alias("distance_m"),
    )
    return at_vertex.join(answers, [route, "seq"], "left")


def samples(paths: DataFrame, distance: str, route: list[str] = ("route_id",), spacing_m: float = SAMPLE_SPACING_M, most: int = SAMPLE_POINTS) -> DataFrame:
    """Evenly strided vertices of each path with both ends; ``distance`` is the path length column."""
    route = list(route)
    sizes = paths.groupBy(*route).agg(F.count(F.lit(1)).alias("_n"), F.max(distance).alias("_m"))
    count = F.least(F.lit(most - 1), F.greatest(F.lit(1), half_even(F.col("_m") / F.lit(spacing_m)).cast("int")))
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / count))
    plain = (F.col("_n") <= 2) | (F.col("_m") <= 0)
    ends = (F.col("seq") == 0) | (F.col("seq") == F.col("_n") - 1)
    keep = F.when(plain, ends).otherwise(ends | (F.pmod(F.col("seq"), stride) == 0))
    return paths.join(sizes, route).filter(keep).drop("_n", "_m")


def walked(fixes: DataFrame, session: str = "session_id", at: str = "ts", tie: list[str] = (), width: int = DAY_MICROS) -> DataFrame:
    """Counted metres of each fix: jitter below 4 m is dropped, jumps are cut to 4 m/s."""
    before = neighbour(
        fixes, [session], [at, *tie], slice_of(epoch_micros(F.col(at)), width), [at, "lon", "lat"], "p"
    )
    moved = haversine_m(F.col("p.lon"), F.col("p.lat"), F.col("lon"), F.col("lat"))
    seconds = F.greatest(F.lit(0.001), (epoch_micros(F.col(at)) - epoch_micros(F.col(f"p.{at}"))) / 1_000_000)
    counted = F.when(moved >= MIN_MOVE_M, F.least(moved, F.lit(MAX_SPEED_M_S) * seconds)).otherwise(F.lit(0.0))
    return before.withColumn("counted_m", F.coalesce(counted, F.lit(0.0))).drop("p")


def walked_distance(fixes: DataFrame, session: str = "session_id", at: str = "ts", tie: list[str] = (), width: int = DAY_MICROS) -> DataFrame:
    return walked(fixes, session, at, tie, width).groupBy(session).agg(
        F.sum("counted_m").alias("walked_m"), F.count(F.lit(1)).alias("fixes")
    )


def first_confirmed(
    updates: DataFrame, hit: Column, changed: str, session: str = "session_id", at: str = "ts",
    tie: list[str] = (), times: int = ARRIVAL_UPDATES, width: int = DAY_MICROS,
) -> DataFrame:
    """First instant per session at which ``hit`` held for ``times`` updates in a row.

    An update that repeats the previous value of ``changed`` does not count as one.
    """
    order, part = [at, *tie], slice_of(epoch_micros(F.col(at)), width)
    flagged = updates.select(session, *order, F.col(changed).alias("_changed"), F.coalesce(hit, F.lit(False)).alias("_hit"))
    before = neighbour(flagged, [session], order, part, ["_changed"], "p")
    news = cut(before.filter(F.col("p").isNull() | ~F.col("p._changed").eqNullSafe(F.col("_changed"))).select(session, *order, "_hit"))
    # Hits without a miss between them share a run; the last of its first ``times`` hits confirms it.
    runs = running(news, [session], order, part, {"_misses": ("count", F.when(~F.col("_hit"), 1))}).filter("_hit")
    early = first_n(runs, [session, "_misses"], [F.col(c) for c in order], times, "_rn")
    return early.filter(F.col("_rn") == times).groupBy(session).agg(F.min(at).alias("confirmed_at"))
