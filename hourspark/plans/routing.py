"""Batch route planning: snapping, three biased searches, route metrics, acceptance, tags, fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.functions.numbers import half_even
from hourspark.functions.geo import WALKING_M_PER_MIN
from hourspark.functions.labels import heat_context
from hourspark.operators import candidates as cand
from hourspark.operators.graph import path_shade
from hourspark.operators.paths import arrivals, path_steps, shortest_paths
from hourspark.operators.space import nearest
from hourspark.operators.spatial import node_penalties
from hourspark.operators.tracks import samples
from hourspark.session import cut

SNAP_LIMIT_M = 400.0
SHADE_BIAS = 1.4
PENALTY_WEIGHT = 0.6
KEY = ["request_id", "id"]


def snapped(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds start_node, end_node and their distances; null beyond 400 m."""
    places = nodes.select(F.col("id").alias("node"), "lon", "lat")
    ends = [
        requests.select("request_id", F.lit(side).alias("side"), F.col(f"{side}_lon").alias("lon"), F.col(f"{side}_lat").alias("lat"))
        for side in ("from", "to")
    ]
    met = nearest(ends[0].unionByName(ends[1]), places, "node", radius_m=SNAP_LIMIT_M)
    on = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return requests.join(met.groupBy("request_id").agg(
        on("from", "node").alias("start_node"), on("from", "distance_m").alias("start_snap_m"),
        on("to", "node").alias("end_node"), on("to", "distance_m").alias("end_snap_m"),
    ), "request_id")


def route_crowd(steps: DataFrame, nodes: DataFrame, lengths: DataFrame, sites: DataFrame, flows: DataFrame) -> DataFrame:
    """Mean flow over the distinct sites nearest to the sampled points of each route."""
    placed = steps.join(nodes.select(F.col("id").alias("node"), "lon", "lat"), "node").join(lengths, KEY)
    points = samples(placed, "metres", KEY)
    met = nearest(points.select(*KEY, "lon", "lat"), sites, "site_id").select(*KEY, "site_id").distinct()
    return met.join(flows.filter(F.col("flow").isNotNull()), "site_id").groupBy(*KEY).agg(F.avg("flow").alias("crowd"))


def searched(
    searches: DataFrame, nodes: DataFrame, edges: DataFrame, sites: DataFrame, flows: DataFrame, penalties: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(rows, steps): every candidate of every request with its metrics, and the nodes of its path.

    All searches run in the same rounds; only their bias and their pull differ.
    """
    found = shortest_paths(searches, edges, KEY, F.col("bias"), penalties, F.col("pull"))
    ends = cut(arrivals(searches, found))
    steps = cut(path_steps(searches, found))
    shade = path_shade(steps, edges, KEY)
    crowd = route_crowd(steps, nodes, ends.select(*KEY, "metres"), sites, flows)
    rows = ends.join(searches.select(*KEY, "seq"), KEY).join(shade, KEY, "left").join(crowd, KEY, "left").select(
        *KEY, "seq", F.col("metres").isNotNull().alias("ok"),
        half_even(F.col("metres") / 1000, 3).alias("distance_km"), half_even(F.col("metres") / WALKING_M_PER_MIN, 1).alias("minutes"),
        half_even(F.col("shade_avg"), 3).alias("shade"), half_even(F.col("crowd"), 1).alias("crowd"),
    )
    return cut(rows), steps


def plan_routes(
    requests: DataFrame, nodes: DataFrame, edges: DataFrame, sites: DataFrame, flows: DataFrame,
    preferences: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, paths) of a batch of requests.

    ``requests`` has request_id, from_lon, from_lat, to_lon, to_lat and temperature_c; ``edges`` are directed
    with shade; ``sites`` (site_id, lon, lat) and ``flows`` (site_id, flow) carry the predicted crowds.  A
    request without a route gets its straight line, marked unavailable.
    """
    heat = heat_context(F.col("temperature_c"))["shade_multiplier"]
    asked = cut(snapped(requests, nodes).withColumn("shade_bias", heat * F.lit(SHADE_BIAS)))
    usable = asked.filter(F.col("start_node").isNotNull() & F.col("end_node").isNotNull())
    penalties = cut(node_penalties(usable, nodes, sites, flows))
    crowded = penalties.select("request_id").distinct().withColumn("crowded", F.lit(True))
    kind = lambda i, bias, pull: F.struct(
        F.lit(cand.KINDS[i]).alias("id"), F.lit(i).alias("seq"), bias.alias("bias"), F.lit(pull).alias("pull")
    )
    # Without a penalty near its corridor a request gets no quieter candidate.
    kinds = F.filter(F.array(
        kind(0, F.lit(0.0), 0.0), kind(1, F.col("shade_bias"), 0.0),
        F.when(F.col("crowded"), kind(2, F.lit(0.0), PENALTY_WEIGHT)),
    ), lambda k: k.isNotNull())
    searches = cut(usable.join(crowded, "request_id", "left").withColumn("k", F.explode(kinds)).select(
        "request_id", "k.*", "start_node", "end_node"
    ))
    rows, steps = searched(searches, nodes, edges, sites, flows, penalties)
    kept = cut(cand.tagged(cand.accepted(rows.filter("ok"))))
    warnings = F.filter(F.array(
        cand.snap_warning("origin", F.col("start_snap_m")), cand.snap_warning("destination", F.col("end_snap_m"))
    ), lambda w: w.isNotNull())
    found = kept.join(asked.select("request_id", warnings.alias("warnings")), "request_id").withColumn("status", F.lit("ok"))
    lost = asked.join(kept.select("request_id").distinct(), "request_id", "left_anti")
    why = F.filter(F.array(
        F.when(F.col("start_node").isNull(), "origin_outside_graph_coverage"),
        F.when(F.col("end_node").isNull(), "destination_outside_graph_coverage"),
        F.when(F.col("start_node").isNotNull() & F.col("end_node").isNotNull(), "no_connected_path"),
    ), lambda w: w.isNotNull())
    estimate = cand.straight_line(lost).select(
        "request_id", F.lit("fastest").alias("id"), F.lit(0).alias("seq"), F.lit(False).alias("ok"), "distance_km", "minutes",
        F.lit(None).cast("double").alias("shade"), F.lit(None).cast("double").alias("crowd"),
        F.array(F.lit("estimated")).alias("tags"), why.alias("warnings"), F.lit("unavailable").alias("status"),
    )
    out = found.select(*estimate.columns).unionByName(estimate)
    wanted = preferences if preferences is not None else requests.select(
        "request_id", F.lit(None).cast("boolean").alias("prefer_quieter"), F.lit(None).cast("int").alias("heat_sensitivity"),
        F.lit(None).cast("int").alias("comfort_balance"),
    )
    first = cand.recommendation(out.withColumn("ok", F.lit(True)), wanted)
    out = out.join(first, "request_id", "left").withColumn("recommended", F.col("id") == F.col("recommended"))
    places = nodes.select(F.col("id").alias("node"), "lon", "lat")
    paths = steps.join(kept.select("request_id", "id"), ["request_id", "id"], "left_semi").join(places, "node")
    return out, paths.select("request_id", "id", "seq", "node", "lon", "lat")
