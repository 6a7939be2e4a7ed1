"""Walk history, saved places, searches and public totals for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.functions.timestamps import epoch_micros
from hourspark.operators.ordered import DAY_MICROS, first_n, latest, numbered, slice_of

GUEST_LIMITS = {"distance_km": (0.0, 100.0), "emissions_kg": (0.0, 50.0)}
SLOT_KINDS = ["home", "work"]
RECENT_SEARCHES = 5
# Rows per exported document part; a user with more rows gets more parts.
EXPORT_PART_ROWS = 1_000


def plausible_guest_walk() -> Column:
    """Limits of a countable anonymous walk: distance in (0, 100], emissions in [0, 50]."""
    return (F.col("distance_km") > 0) & (F.col("distance_km") <= 100) & F.col("emissions_kg").between(0, 50)


def split_guest_walks(guests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined); a null value is quarantined."""
    ok = F.coalesce(plausible_guest_walk(), F.lit(False))
    return guests.filter(ok), guests.filter(~ok)


def community_totals(walks: DataFrame, guests: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """Walks, emissions and distance over signed-in and unclaimed anonymous walks."""
    if claimed is not None:
        guests = guests.join(claimed.select("id"), "id", "left_anti")
    cols = ["distance_km", "emissions_kg"]
    return walks.select(*cols).unionByName(guests.select(*cols)).agg(
        F.count(F.lit(1)).alias("total_walks"),
        F.coalesce(F.sum("emissions_kg"), F.lit(0)).alias("total_emissions_kg"),
        F.coalesce(F.sum("distance_km"), F.lit(0)).alias("total_distance_km"),
    )


def calendar(walks: DataFrame, user: str, at: str, today: Column, days: int = 28, top: int = 3) -> DataFrame:
    """(user, day, level) for the last ``days`` days of every user: walks that day, at most ``top``."""
    counts = walks.groupBy(F.col(user), F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    users = counts.select(user).distinct().withColumn(
        "day", F.explode(F.sequence(F.date_sub(today, days - 1), today, F.expr("interval 1 day")))
    )
    return users.join(counts, [user, "day"], "left").select(
        user, "day", F.least(F.coalesce("n", F.lit(0)), F.lit(top)).cast("int").alias("level")
    )


def user_totals(walks: DataFrame, user: str, at: str, now: Column) -> DataFrame:
    """Per user all walks, total emissions and the walks of the current month."""
    this_month = F.trunc(F.to_date(at), "month") == F.trunc(F.to_date(now), "month")
    return walks.groupBy(user).agg(
        F.count(F.lit(1)).alias("walks"), F.sum("emissions_kg").alias("emissions_kg"),
        F.count_if(this_month).alias("walks_this_month"),
    )


def newest_n(df: DataFrame, user: str, at: str, n: int, tie: list[str] = ()) -> DataFrame:
    """The ``n`` newest rows of each user."""
    return first_n(df, [user], [F.col(at).desc(), *[F.col(t).desc() for t in tie]], n)


def upserted_searches(searches: DataFrame, user: str = "user_id", label: str = "label", at: str = "searched_at", tie: list[str] = ()) -> DataFrame:
    """One row per (user, label): the newest search."""
    return latest(searches, [user, label], [at, *tie])


def current_places(places: DataFrame, user: str = "user_id", kind: str = "kind", at: str = "created_at", tie: list[str] = ()) -> DataFrame:
    """Single slots keep their newest place per user; every favourite stays."""
    slots = latest(places.filter(F.col(kind).isin(SLOT_KINDS)), [user, kind], [at, *tie])
    return slots.unionByName(places.filter(~F.col(kind).isin(SLOT_KINDS)))


def saved_matches(points: DataFrame, places: DataFrame, user: str = "user_id") -> DataFrame:
    """Adds ``is_saved``: the user has a saved place at the same coordinates to four decimals."""
    at = [user, F.round("lat", 4).alias("_lat"), F.round("lon", 4).alias("_lon")]
    known = places.select(*at).distinct().withColumn("_saved", F.lit(True))
    keyed = points.withColumns({"_lat": F.round("lat", 4), "_lon": F.round("lon", 4)})
    return keyed.join(known, [user, "_lat", "_lon"], "left").select(
        *points.columns, F.coalesce("_saved", F.lit(False)).alias("is_saved")
    )


def account_export(
    sections: dict[str, tuple[DataFrame, str, str | None, str]], part_rows: int = EXPORT_PART_ROWS, width: int = DAY_MICROS
) -> DataFrame:
    """(user_id, section, part, document): every user's stored rows as JSON arrays.

    ``sections`` maps a section to (table, user column, time column, id column); a table without a time
    column must hold one row per user, as the profiles do.  A section of
    more than ``part_rows`` rows is cut into parts, so one very active user never becomes one huge
    document; all parts together hold all rows.
    """
    out = None
    for name, (table, user, at, row_id) in sections.items():
        if at:
            placed = numbered(table, [user], [at, row_id], slice_of(epoch_micros(F.col(at)), width), "_rn")
        else:
            placed = table.withColumn("_rn", F.lit(1))
        part = F.floor((F.col("_rn") - 1) / F.lit(part_rows)).cast("int")
        rows = F.array_sort(F.collect_list(F.struct("_rn", F.struct(*table.columns).alias("r"))))
        docs = placed.groupBy(F.col(user).alias("user_id"), part.alias("part")).agg(
            F.to_json(F.transform(rows, lambda x: x["r"])).alias("document")
        ).select("user_id", F.lit(name).alias("section"), "part", "document")
        out = docs if out is None else out.unionByName(docs)
    return out


def quietest_slot(
    slots: DataFrame, keys: list[str], at: str, flow: str, now: Column, end_hour: int = 21, step_hours: int = 2,
    most: int = 6, least_spread: float = 0.15,
) -> DataFrame:
    """Quietest sampled slot per key when it is worth suggesting.

    Slots lie ``step_hours`` apart from ``now``, at most ``most`` of them and inside today's walking
    window.  Nothing is suggested with fewer than two usable slots, a spread under 15 % of the busiest
    one, or when the quietest is the first.
    """
    left = F.lit(float(end_hour)) - (F.hour(now) + F.minute(now) / 60)
    samples = F.when(left >= step_hours, F.least(F.lit(most), F.floor(left / step_hours) + 1)).otherwise(F.lit(0))
    since = epoch_micros(F.col(at)) - epoch_micros(now)
    step = F.lit(step_hours * 3_600_000_000)
    usable = slots.withColumn("_i", since / step).filter(
        (F.pmod(since, step) == 0) & (F.col("_i") >= 0) & (F.col("_i") < samples) & F.col(flow).isNotNull()
    )
    facts = usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("slots"), F.min(F.struct(F.col(flow).alias("flow"), F.col(at).alias("at"), "_i")).alias("_q"),
        F.max(flow).alias("_busy"),
    )
    worth = (
        (F.col("slots") >= 2) & (F.col("_busy") > 0) & (F.col("_q._i") > 0)
        & ((F.col("_busy") - F.col("_q.flow")) / F.col("_busy") >= least_spread)
    )
    return facts.filter(worth).select(*keys, F.col("_q.at").alias("quietest_at"), F.col("_q.flow").alias("flow"))
