import datetime as dt

from pyspark.sql import functions as F

from hourspark.operators import tracks
from hourspark.operators.ordered import latest
from hourspark.streaming import hourly, walk


def pieces(spark, df, place, n, folder):
    """Write ``df`` in ``n`` pieces; yields a stream of the pieces so far after each."""
    for part in range(n):
        df.filter(place == part).coalesce(1).write.mode("append").parquet(f"{folder}/in{part}")
        yield spark.readStream.schema(df.schema).parquet(f"{folder}/in*")


def hourly_by_hand(rows, upto):
    want = {}
    for site, at, kind, n in rows:
        hour = at.replace(minute=0)
        if hour + dt.timedelta(hours=1) <= upto:
            count, cars, total = want.get((site, hour), (0, 0, 0.0))
            want[site, hour] = (count + 1, cars + (kind == "car"), total + (n if kind == "car" else 0.0))
    return want


def test_hours_over_restarts_and_late_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k % 3 if k % 50 else None, start + dt.timedelta(minutes=7 * k), "car" if k % 4 else "bus", float(k)) for k in range(600)]
    df = spark.createDataFrame(rows, "site long, at timestamp_ntz, class string, n double")
    home, place = str(tmp_path / "job"), F.when(F.col("n") < 200, 1).when(F.col("n") < 400, 0).when(F.pmod("n", F.lit(2)) == 0, 2).otherwise(3)
    for part, stream in enumerate(pieces(spark, df, place, 4, str(tmp_path))):
        got = hourly.summed_hours(stream, "at", ["site"], F.col("class") == "car", F.col("n"), home)
        seen = [r for r in rows if (1 if r[3] < 200 else 0 if r[3] < 400 else 2 if r[3] % 2 == 0 else 3) <= part]
        upto = max(r[1] for r in seen) - dt.timedelta(minutes=10)
        assert {(r.site, r.hour): (r.rows, r.motor_rows, r.vehicle_count) for r in got.collect()} == hourly_by_hand(seen, upto)
    # Four runs, a batch each: none reads a file again.
    batches = sorted(p.name for p in (tmp_path / "job" / "sums").iterdir() if p.name.startswith("batch="))
    assert batches == [f"batch={k}" for k in range(4)]
    counted = spark.read.parquet(f"{home}/sums").groupBy("batch").agg(F.sum("rows").alias("rows")).collect()
    assert {r.batch: r.rows for r in counted} == {0: 200, 1: 200, 2: 100, 3: 100}
    # A revision has the total before and after; hours that were open have none before.
    for r in spark.read.parquet(f"{home}/revisions").collect():
        assert (r.batch == 3 or r.old_rows is None or r.rows > r.old_rows) and (r.batch or r.old_rows is None)
    late = spark.read.parquet(f"{home}/revisions").filter("batch = 3 AND old_rows IS NOT NULL")
    assert late.count() > 50 and late.filter("rows <= old_rows").isEmpty()


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, start + dt.timedelta(minutes=20 * k), float(k)) for k in range(30)], "site long, at timestamp_ntz, n double")
    home = str(tmp_path / "job")
    for stream in pieces(spark, df, F.floor(F.col("n") / 15), 2, str(tmp_path)):
        got = hourly.summed_hours(stream, "at", ["site"], F.lit(True), F.col("n"), home)
    before = sorted(map(tuple, got.collect()))
    hourly._revise(spark, home, ["site"], 1, "10 minutes")
    assert sorted(map(tuple, hourly.closed_hours(spark, home, ["site"]).collect())) == before


def walk_rows(spark, minutes, left):
    start = F.lit("2026-06-01 10:00:00").cast("timestamp_ntz")
    rows = [(s, s * 1000 + k, m, 144.96 + (k // 2) * 0.0002 + s, left(s, k)) for s, all_ in minutes.items() for k, m in enumerate(all_)]
    df = spark.createDataFrame(rows, "session_id long, event_id long, m int, lon double, remaining_km double").withColumn("lat", F.lit(-37.81))
    return df.withColumn("at", start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("m"), F.lit(0)))


def check_walks(spark, df, place, n, folder):
    fixes = df.withColumn("ts", F.col("at").cast("timestamp")).drop("at")
    for stream in pieces(spark, fixes, place, n, folder):
        parts = walk.run(stream, f"{folder}/job")
    got = {r.session_id: r for r in walk.totals(parts).collect()}
    want = {r.session_id: r for r in tracks.walked_distance(df, "session_id", "at", ["event_id"]).collect()}
    hit = F.coalesce(F.col("remaining_km") <= 0.015, F.lit(False))
    arrived = {r.session_id: r.confirmed_at for r in tracks.first_confirmed(df, hit, "remaining_km", "session_id", "at", ["event_id"]).collect()}
    assert set(got) == set(want)
    for session, row in got.items():
        assert row.fixes == want[session].fixes and abs(row.walked_m - want[session].walked_m) < 1e-6
        assert row.arrived_at == arrived.get(session), session
    return parts


def test_walks_over_restarts_equal_the_batch_operators(spark, tmp_path):
    minutes = {0: range(0, 60, 2), 1: range(1, 60, 2)}
    df = walk_rows(spark, minutes, lambda s, k: 1.0 - k / 100 if k < 20 else 0.01 - k / 10000)
    parts = check_walks(spark, df, F.floor(F.col("m") / 20), 3, str(tmp_path))
    assert parts.count() == 2


def test_walks_without_a_session_are_one_session_apart(spark, tmp_path):
    """Rows of a null id follow other sessions' rows in the same task and take no part in them."""
    minutes = {s: range(s, 60, 6) for s in range(6)}
    df = walk_rows(spark, minutes, lambda s, k: 1.0 - k / 100 if k < 7 else 0.01 - k / 10000)
    df = df.withColumn("session_id", F.when(F.col("session_id") != 2, F.col("session_id")))
    parts = check_walks(spark, df, F.floor(F.col("m") / 20), 3, str(tmp_path))
    assert parts.count() == 6


def test_a_walk_that_returns_after_idle_hours_is_whole(spark, tmp_path):
    """Sessions idle for 31 hours while another one moves the event time on: closed, given out and joined again."""
    day = 24 * 60
    minutes = {0: [0, 1, 2, 3, 31 * 60, 31 * 60 + 1, 31 * 60 + 2, 31 * 60 + 3], 9: range(0, 3 * day, 60)}
    # Hits before and after the gap: runs of three that span it, with and without a repeated distance, or a miss.
    kinds = {
        1: [1, 1, .01, .009, .008, .007, 1, 1], 2: [1, 1, 1, .01, .01, .009, .008, .007], 3: [1, 1, .01, .009, .009, .009, .009, 1],
        4: [1, .01, 1, .01, 1, .01, .009, .008], 5: [None, None, .01, .009, None, .008, .007, .006], 6: [.01] * 8, 7: [1, 1, 1, .01, .009, .009, .007, 1],
    }
    minutes |= {s: minutes[0] for s in kinds}
    df = walk_rows(spark, minutes, lambda s, k: (kinds[s][k] if kinds[s][k] is None else float(kinds[s][k])) if s in kinds else 1.0 - k / 1000)
    parts = check_walks(spark, df, F.least(F.floor(F.col("m") / (16 * 60)), F.lit(4)), 5, str(tmp_path))
    count = {r.session_id: (r.n, r.closed) for r in parts.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if("closed").alias("closed")).collect()}
    assert all(count[s] == (2, 2) for s in (0, *kinds)) and count[9] == (1, 0)


def test_freshness_gate_runs_on_every_batch(spark, tmp_path):
    df = spark.sql("SELECT 1 AS u, timestamp_ntz'2026-06-01 10:00:00' AS h, CAST(NULL AS int) AS lag UNION ALL SELECT 2, timestamp_ntz'2026-06-01 12:00:00', 5")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    query = hourly.watch_freshness(
        hourly.stream_files(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "c"), ["u"], "h", ["lag"],
        F.lit("2026-06-01 11:00:00").cast("timestamp_ntz"), lambda out, number: seen.extend((r.u, r.status, tuple(r.warnings)) for r in out.collect()),
    )
    query.awaitTermination()
    assert sorted(seen) == [(1, "degraded", ("stale_lag_history", "missing_lag_history")), (2, "ok", ())]
    assert latest(df, ["u"], ["h"]).count() == 2


def test_the_gate_publishes_all_units_after_every_batch(spark, tmp_path):
    start = dt.datetime(2026, 6, 1)
    rows = [(u, start + dt.timedelta(hours=h), None if (u + h) % 4 == 0 else h, h) for u in range(4) for h in range(0, 40 - 12 * u)]
    df = spark.createDataFrame(rows, "unit long, at timestamp_ntz, lag int, h int")
    for stream in pieces(spark, df, F.floor(F.col("h") / 16), 3, str(tmp_path)):
        told = hourly.gated(stream.select("unit", "at", "lag"), str(tmp_path / "job"), ["unit"], "at", ["lag"], "10 HOURS")
    got = {(r.batch, r.unit): (r.newest, r.status, tuple(r.warnings)) for r in told.collect()}
    want = {}
    for batch in range(3):
        seen = [r for r in rows if r[3] // 16 <= batch]
        top = max(r[1] for r in seen)
        for u in {r[0] for r in seen}:
            _, at, lag, _ = max((r for r in seen if r[0] == u), key=lambda r: r[1])
            warnings = ("stale_lag_history",) * (at < top - dt.timedelta(hours=10)) + ("missing_lag_history",) * (lag is None)
            want[batch, u] = (at, "degraded" if warnings else "ok", warnings)
    assert got == want


def test_a_table_may_be_one_file(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "t"))
    file = next(p for p in (tmp_path / "t").iterdir() if p.name.endswith(".parquet"))
    for path in (tmp_path / "t", file):
        stream = hourly.stream_files(spark, str(path), spark.range(1).schema)
        assert hourly.run_to_table(stream, "file").count() == 5
