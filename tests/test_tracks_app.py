import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hourspark.operators import activity, candidates, tracks
from tests.test_graph import metres

PATH = [(144.96, -37.81), (144.961, -37.81), (144.961, -37.811), (144.962, -37.811)]


@pytest.fixture(scope="module")
def path(spark):
    return spark.createDataFrame([(1, i, *p) for i, p in enumerate(PATH)], "route_id long, seq long, lon double, lat double")


def test_turns_along_and_next_turn(spark, path):
    got = [(r.seq, r.direction, round(r.angle_deg)) for r in tracks.turns(path).orderBy("seq").collect()]
    assert got == [(1, "right", 90), (2, "left", 90)]
    left = {r.seq: r.remaining_m for r in tracks.along(path).collect()}
    steps = [metres(a, b) for a, b in zip(PATH, PATH[1:])]
    assert left[0] == pytest.approx(sum(steps)) and left[3] == pytest.approx(0)
    ahead = {r.seq: (r.direction, r.distance_m) for r in tracks.next_turn(path.select("route_id", "seq"), path).collect()}
    assert ahead[0] == ("right", pytest.approx(steps[0])) and ahead[1] == ("left", pytest.approx(steps[1])) and ahead[2] == (None, None)
    fix = spark.createDataFrame([(9, 1, 144.9611, -37.8109)], "fix int, route_id long, lon double, lat double")
    near = tracks.progress(fix, path).first()
    assert near.seq == 2 and near.remaining_m == pytest.approx(metres((144.9611, -37.8109), PATH[2]) + steps[2])


def test_samples_keep_both_ends(spark):
    df = spark.range(30).select(F.lit(1).alias("route_id"), F.col("id").alias("seq"), F.lit(1000.0).alias("m"))
    assert sorted(r.seq for r in tracks.samples(df, "m").collect()) == [0, 7, 14, 21, 28, 29]
    assert sorted(r.seq for r in tracks.samples(df.filter("seq < 2"), "m").collect()) == [0, 1]


def fixes(spark, *data):
    df = spark.createDataFrame([(1, i, s, lon) for i, (s, lon) in enumerate(data)], "session_id long, event_id long, s int, lon double")
    start = F.lit("2026-06-01 10:00:00").cast("timestamp_ntz")
    return df.select("session_id", "event_id", (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)"))).alias("ts"), "lon", F.lit(-37.81).alias("lat"))


def test_jitter_is_dropped_and_jumps_are_cut(spark):
    step = metres((144.96, -37.81), (144.9601, -37.81))
    track = fixes(spark, (0, 144.96), (10, 144.9601), (11, 144.96011), (12, 144.97), (112, 144.9701))
    got = tracks.walked_distance(track, "session_id", "ts", ["event_id"]).first()
    assert got.walked_m == pytest.approx(step + 0 + 4.0 + step, abs=0.01) and got.fixes == 5


def test_arrival_needs_three_changed_updates(spark):
    data = [(0, 0.5), (1, 0.01), (2, 0.01), (3, 0.012), (4, 0.5), (5, 0.01), (6, 0.009), (7, 0.009), (8, 0.008), (9, 0.007)]
    df = spark.createDataFrame([(1, i, s, d) for i, (s, d) in enumerate(data)], "session_id long, event_id long, s int, d double")
    start = F.lit("2026-06-01 10:00:00").cast("timestamp_ntz")
    df = df.withColumn("ts", start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)")))
    got = tracks.first_confirmed(df, F.col("d") <= 0.015, "d", "session_id", "ts", ["event_id"]).first()
    assert got.confirmed_at == dt.datetime(2026, 6, 1, 10, 0, 8)


def test_totals_skip_claimed_and_implausible_walks(spark):
    walk = "id string, distance_km decimal(5,2), emissions_kg decimal(5,2)"
    from decimal import Decimal as D

    walks = spark.createDataFrame([("w", D("1.50"), D("0.29"))], walk)
    guests = spark.createDataFrame([("a", D("2.00"), D("0.38")), ("b", D("3.00"), D("0.57")), ("c", D("0.00"), D("0.00")), ("d", None, D("0.10"))], walk)
    ok, held = activity.split_guest_walks(guests)
    assert sorted(r.id for r in held.collect()) == ["c", "d"]
    got = activity.community_totals(walks, ok, spark.createDataFrame([("a",)], "id string")).first()
    assert (got.total_walks, got.total_emissions_kg, got.total_distance_km) == (2, D("0.86"), D("4.50"))
    empty = activity.community_totals(walks.limit(0), guests.limit(0)).first()
    assert (empty.total_walks, empty.total_distance_km) == (0, 0)


def test_places_keep_one_slot_and_all_favourites(spark):
    df = spark.createDataFrame([(1, "home", "old", 1), (1, "home", "new", 2), (1, "favorite", "x", 1), (1, "favorite", "y", 2)], "user_id int, kind string, label string, created_at int")
    assert sorted(r.label for r in activity.current_places(df).collect()) == ["new", "x", "y"]


def test_export_holds_every_row_once(spark):
    walks = spark.range(25).select("id", F.lit(1).alias("user_id"), (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"))).alias("at"))
    people = spark.createDataFrame([(1, "Ann")], "id int, name string")
    out = activity.account_export({"walks": (walks, "user_id", "at", "id"), "profile": (people, "id", None, "id")}, part_rows=10).collect()
    ids = [w["id"] for r in sorted(out, key=lambda r: r.part) if r.section == "walks" for w in json.loads(r.document)]
    assert ids == list(range(25)) and sorted((r.section, r.part) for r in out) == [("profile", 0), ("walks", 0), ("walks", 1), ("walks", 2)]


def test_candidates_must_differ_and_first_wins_a_tie(spark):
    schema = "request_id int, id string, seq int, ok boolean, minutes double, shade double, crowd double"
    df = spark.createDataFrame([
        (1, "fastest", 0, True, 10.0, 0.30, 100.0), (1, "shaded", 1, True, 12.0, 0.33, 100.0), (1, "quieter", 2, True, 10.0, 0.30, 91.0),
        (2, "fastest", 0, True, 10.0, 0.30, None), (2, "shaded", 1, True, 12.0, 0.40, 100.0), (2, "quieter", 2, True, 10.0, 0.30, 91.0),
        (3, "fastest", 0, True, 10.0, 0.30, 100.0), (3, "shaded", 1, True, 12.0, 0.35, 90.0), (3, "quieter", 2, True, 11.0, 0.30, 88.0),
    ], schema)
    kept = candidates.accepted(df)
    assert sorted((r.request_id, r.id) for r in kept.collect()) == [(1, "fastest"), (1, "quieter"), (2, "fastest"), (2, "shaded"), (3, "fastest"), (3, "shaded")]
    tags = {(r.request_id, r.id): r.tags for r in candidates.tagged(kept).collect()}
    assert tags[1, "fastest"] == ["fastest"] and tags[1, "quieter"] == ["least_crowded"] and tags[2, "shaded"] == ["most_shaded"]
    wish = spark.createDataFrame([(1, True, 90, 0), (2, None, 60, None), (3, False, None, 39)], "request_id int, prefer_quieter boolean, heat_sensitivity int, comfort_balance int")
    assert {r.request_id: r.recommended for r in candidates.recommendation(kept, wish).collect()} == {1: "quieter", 2: "shaded", 3: "shaded"}


def test_quietest_slot_must_be_worth_it(spark):
    day = "2026-06-01 "
    data = [("a", "12:00", 100.0), ("a", "14:00", 80.0), ("b", "12:00", 100.0), ("b", "14:00", 90.0), ("c", "12:00", 10.0), ("c", "14:00", 100.0), ("d", "14:00", 1.0), ("a", "22:00", 1.0)]
    df = spark.createDataFrame([(k, day + t + ":00", f) for k, t, f in data], "k string, t string, flow double").withColumn("at", F.col("t").cast("timestamp_ntz"))
    now = F.lit(day + "12:00:00").cast("timestamp_ntz")
    assert [(r.k, r.quietest_at.hour) for r in activity.quietest_slot(df, ["k"], "at", "flow", now).collect()] == [("a", 14)]
