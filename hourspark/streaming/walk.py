"""Live walk tracking: walked metres and confirmed arrival per session as keyed state with event-time timeouts.

A session's state is one row, which comes and goes with its fixes.  When it times out (six idle hours), the state is given out as a closed part and
dropped; a session that comes back starts a new part.  Parts carry what it takes to join them: their ends, and the
hits at their beginning.  ``totals`` joins the parts, so that nothing a session walked is lost.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hourspark.functions.geo import EARTH_M, haversine_m
from hourspark.operators.ordered import latest, neighbour
from hourspark.operators.tracks import ARRIVAL_KM, ARRIVAL_UPDATES, MAX_SPEED_M_S, MIN_MOVE_M
from hourspark.session import cut

# A part of a session.  Instants are microseconds.  ``lead`` counts the hits before the first miss, the first of
# them came at lead1, lead2 and lead3; ``streak`` counts those after the last miss; without a miss ``all_hit`` holds.
PART = """first_us long, first_lon double, first_lat double, first_left double, last_us long, last_lon double, last_lat double,
 last_left double, walked_m double, fixes long, lead int, lead1 long, lead2 long, lead3 long, streak int, all_hit boolean, arrived_us long"""
NAMES = [c.split()[0] for c in PART.replace("\n", " ").split(", ")]
OUTPUT = f"session_id long, {PART}, closed boolean"
IDLE = "6 hours"
IDLE_MS = 6 * 3600 * 1000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _metres(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    half_lat, half_lon = np.radians(lat2 - lat1) / 2, np.radians(lon2 - lon1) / 2
    a = np.sin(half_lat) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(half_lon) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(a))


def _streaks(hit: np.ndarray, before: int) -> np.ndarray:
    """Length of the run of hits that ends at each update, continuing ``before``."""
    place = np.arange(1, len(hit) + 1)
    last_miss = np.maximum.accumulate(np.where(hit, -before, place))
    return np.where(hit, place - last_miss, 0)


def advanced(part: dict[str, Any] | None, batch: pd.DataFrame) -> dict[str, Any]:
    """``part`` (None at its beginning) after the fixes of ``batch``: event_id, at_us, lon, lat, remaining_km."""
    order = np.lexsort([batch[c].to_numpy() for c in ("event_id", "at_us")])
    x, y, t, left = (batch[c].to_numpy()[order] for c in ("lon", "lat", "at_us", "remaining_km"))
    came, left = t, np.where(np.isnan(left), np.inf, left)  # unknown is no hit, and no news after unknown
    if part is None:
        part = dict.fromkeys(NAMES) | {"first_us": int(t[0]), "first_lon": float(x[0]), "first_lat": float(y[0]), "first_left": float(left[0])}
        part |= {"walked_m": 0.0, "fixes": 0, "lead": 0, "streak": 0, "all_hit": True}
        before = np.nan
    else:
        x, y, t = np.append(part["last_lon"], x), np.append(part["last_lat"], y), np.append(part["last_us"], t)
        before = part["last_left"]
    moved = _metres(x[:-1], y[:-1], x[1:], y[1:])
    counted = np.where(moved >= MIN_MOVE_M, np.minimum(moved, MAX_SPEED_M_S * np.maximum(0.001, np.diff(t) / 1e6)), 0.0)
    fresh = left != np.append(before, left[:-1])
    hits, at = left[fresh] <= ARRIVAL_KM, came[fresh]
    part = part | {"walked_m": part["walked_m"] + float(counted.sum()), "fixes": part["fixes"] + len(batch)}
    part |= {"last_us": int(t[-1]), "last_lon": float(x[-1]), "last_lat": float(y[-1]), "last_left": float(left[-1])}
    if len(hits):
        if part["all_hit"]:
            leading = len(hits) if hits.all() else int(np.argmin(hits))
            for k in range(part["lead"], min(part["lead"] + leading, 3)):
                part[f"lead{k + 1}"] = int(at[k - part["lead"]])
            part |= {"lead": part["lead"] + leading, "all_hit": bool(hits.all())}
        runs = _streaks(hits, part["streak"])
        reached = np.flatnonzero(runs >= ARRIVAL_UPDATES)
        if part["arrived_us"] is None and len(reached):
            part["arrived_us"] = int(at[reached[0]])
        part["streak"] = int(runs[-1])
    return part


def _told(key: tuple, part: dict[str, Any], closed: bool) -> pd.DataFrame:
    return pd.DataFrame([(key[0], *(part[c] for c in NAMES), closed)], columns=["session_id", *NAMES, "closed"], dtype=object)


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A session's part after its share of a micro-batch, or closed when it has timed out."""
    part = dict(zip(NAMES, state.get)) if state.exists else None
    if state.hasTimedOut:
        state.remove()
        yield _told(key, part, True)
        return
    some = list(batches)
    part = advanced(part, some[0] if len(some) == 1 else pd.concat(some, ignore_index=True))
    state.update(tuple(part[c] for c in NAMES))
    state.setTimeoutTimestamp(max(part["last_us"] // 1000 + IDLE_MS, state.getCurrentWatermarkMs() + 1))
    yield _told(key, part, False)


def track(fixes: DataFrame) -> DataFrame:
    """The parts of sessions that each micro-batch changes or closes.

    ``fixes`` streams session_id, event_id, ts, lon, lat and remaining_km.  Fixes must arrive in time order
    between batches; inside a batch they are sorted, so a session's share of one micro-batch is held at a
    time (bound it with ``files_per_batch``).  Fixes more than six hours behind the newest are left out and
    counted by the query's progress.
    """
    fixes.sparkSession.conf.set(STATE_STORE, ROCKS_DB)
    timed = fixes.withWatermark("ts", IDLE).withColumn("at_us", F.unix_micros("ts"))
    return timed.groupBy("session_id").applyInPandasWithState(_step, OUTPUT, PART, "update", GroupStateTimeout.EventTimeTimeout)


def run(fixes: DataFrame, home: str) -> DataFrame:
    """Track all input that is available into the ledger of parts in ``home`` and return the parts so far.

    ``home`` is the job's own folder: a second run goes on from the state and the files it has read.  A batch
    that is repeated after a failure replaces its own rows.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(home, "parts", f"batch={number}"))

    started = track(fixes).writeStream.outputMode("update").foreachBatch(keep)
    started.option("checkpointLocation", os.path.join(home, "state")).trigger(availableNow=True).start().awaitTermination()
    spark = fixes.sparkSession
    rows = spark.read.schema(f"{OUTPUT}, batch long").parquet(os.path.join(home, "parts"))
    return latest(rows, ["session_id", "first_us"], ["batch", "closed"]).drop("batch")


def _joined(arrived: Column, part: Column) -> Column:
    """Streak, last remaining distance and arrival after one more part."""
    repeats = F.when(part["first_left"].eqNullSafe(arrived["left"]) & (part["lead"] > 0), 1).otherwise(0)
    missing = F.lit(ARRIVAL_UPDATES) - arrived["streak"] + repeats
    leads = F.array(part["lead1"], part["lead2"], part["lead3"])
    early = F.when((part["lead"] >= missing) & missing.between(1, 3), F.get(leads, missing - 1))
    return F.struct(
        F.when(part["all_hit"], arrived["streak"] + part["lead"] - repeats).otherwise(part["streak"]).alias("streak"),
        part["last_left"].alias("left"), F.coalesce(arrived["at"], early, part["arrived_us"]).alias("at"),
    )


def totals(parts: DataFrame) -> DataFrame:
    """session_id, walked_m, fixes, arrived_at: a session's parts and the ways between them."""
    month = 30 * 86_400_000_000
    ends = neighbour(parts, ["session_id"], ["first_us"], F.floor(F.col("first_us") / F.lit(month)), ["last_us", "last_lon", "last_lat"], "p")
    moved = haversine_m(F.col("p.last_lon"), F.col("p.last_lat"), F.col("first_lon"), F.col("first_lat"))
    seconds = F.greatest(F.lit(0.001), (F.col("first_us") - F.col("p.last_us")) / 1_000_000)
    between = F.when(moved >= MIN_MOVE_M, F.least(moved, F.lit(MAX_SPEED_M_S) * seconds))
    ends = cut(ends.withColumn("between", F.coalesce(between, F.lit(0.0))).drop("p"))
    told = F.struct("first_us", "first_left", "last_left", "lead", "lead1", "lead2", "lead3", "streak", "arrived_us", "all_hit")
    start = F.struct(F.lit(0).alias("streak"), F.lit(None).cast("double").alias("left"), F.lit(None).cast("long").alias("at"))
    return ends.groupBy("session_id").agg(
        F.sum(F.col("walked_m") + F.col("between")).alias("walked_m"), F.sum("fixes").alias("fixes"), F.array_sort(F.collect_list(told)).alias("told")
    ).select("session_id", "walked_m", "fixes", F.timestamp_micros(F.aggregate("told", start, _joined)["at"]).alias("arrived_at"))
