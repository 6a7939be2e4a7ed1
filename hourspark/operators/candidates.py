"""Route candidates of a request: acceptance, tags, recommendation and fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.functions.geo import WALKING_M_PER_MIN, haversine_km
from hourspark.functions.labels import recommended
from hourspark.functions.numbers import half_even, half_up

MIN_SHADE_GAIN = 0.04
MIN_CROWD_GAIN = 0.08
# Candidate kinds in the order they are considered, and tag names.
KINDS = ["fastest", "shaded", "quieter"]


def accepted(candidates: DataFrame, request: str = "request_id") -> DataFrame:
    """Candidates that differ enough from every one accepted before them.

    Input has one row per (request, id) with id, ok, shade and crowd.  ``fastest`` always stays,
    ``shaded`` needs 0.04 more or less shade than fastest, ``quieter`` 8 % other crowd than each accepted
    one; a missing metric refuses the candidate.  One aggregation per request, no ordering.
    """
    row = F.struct("ok", "shade", "crowd")
    held = candidates.groupBy(request).agg(*[
        F.max(F.when(F.col("id") == k, row)).alias(f"_{k}") for k in KINDS
    ])
    shade_gap = F.abs(F.col("_shaded.shade") - F.col("_fastest.shade"))
    take_shaded = F.coalesce(F.col("_shaded.ok") & (shade_gap >= MIN_SHADE_GAIN), F.lit(False))

    def crowd_far(kind: str) -> Column:
        other = F.col(f"_{kind}.crowd")
        return F.abs(F.col("_quieter.crowd") - other) / F.greatest(F.abs(other), F.lit(0.01)) >= MIN_CROWD_GAIN

    take_quieter = F.coalesce(
        F.col("_quieter.ok") & crowd_far("fastest") & (~take_shaded | crowd_far("shaded")), F.lit(False)
    )
    chosen = held.select(request, F.filter(F.array(
        F.lit("fastest"), F.when(take_shaded, "shaded"), F.when(take_quieter, "quieter")
    ), lambda k: k.isNotNull()).alias("_kept"))
    return candidates.join(chosen, request).filter(F.array_contains("_kept", F.col("id"))).drop("_kept")


def tagged(candidates: DataFrame, request: str = "request_id", order: str = "seq") -> DataFrame:
    """Adds ``tags``: fastest, and most_shaded / least_crowded when at least two usable values differ.

    The first candidate in ``order`` wins a tie.
    """
    ok = F.col("ok")
    usable = lambda c: F.when(ok, F.col(c))
    key = lambda c, sign: F.when(usable(c).isNotNull(), F.struct(usable(c), sign * F.col(order)))
    facts = candidates.groupBy(request).agg(
        F.count_if(ok).alias("_ok"),
        *[F.count(usable(c)).alias(f"_n_{c}") for c in ("shade", "crowd")],
        *[(F.min(usable(c)) < F.max(usable(c))).alias(f"_vary_{c}") for c in ("shade", "crowd")],
        F.max_by(F.col(order), key("shade", -1)).alias("_shadiest"),
        F.min_by(F.col(order), key("crowd", 1)).alias("_calmest"),
        F.min_by(F.col(order), key("minutes", 1)).alias("_quickest"),
    )
    joined = candidates.join(facts, request)
    worth = lambda c: (F.col("_ok") >= 2) & (F.col(f"_n_{c}") >= 2) & F.col(f"_vary_{c}")
    tags = F.filter(F.array(
        F.when(F.col(order) == F.col("_quickest"), "fastest"),
        F.when(worth("shade") & (F.col(order) == F.col("_shadiest")), "most_shaded"),
        F.when(worth("crowd") & (F.col(order) == F.col("_calmest")), "least_crowded"),
    ), lambda t: t.isNotNull())
    return joined.withColumn("tags", tags).select(*candidates.columns, "tags")


def recommendation(candidates: DataFrame, preferences: DataFrame, request: str = "request_id", order: str = "seq") -> DataFrame:
    """(request, recommended): the candidate to suggest first under the request's preferences.

    ``preferences`` has prefer_quieter, heat_sensitivity and comfort_balance, any of them null.
    """
    ids = candidates.filter("ok").groupBy(request).agg(
        F.transform(F.array_sort(F.collect_set(F.struct(order, "id"))), lambda x: x["id"]).alias("ids")
    )
    return ids.join(preferences, request, "left").select(request, recommended(
        F.col("ids"), F.col("prefer_quieter"), F.col("heat_sensitivity"), F.col("comfort_balance")
    ).alias("recommended"))


def straight_line(requests: DataFrame) -> DataFrame:
    """Distance and minutes of the straight line, for requests without a route."""
    km = haversine_km(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat"))
    return requests.withColumns({
        "distance_km": half_up(km, 3), "minutes": half_up(km * 1000.0 / WALKING_M_PER_MIN),
    })


def snap_warning(side: str, metres: Column, limit: float = 50.0) -> Column:
    """``<side>_snap_distance_m_<metres>`` for a start or end far from the network."""
    return F.when(metres > limit, F.concat(F.lit(f"{side}_snap_distance_m_"), half_even(metres).cast("bigint").cast("string")))
