import random

import pytest
from pyspark.sql import functions as F

from hourspark.functions.timestamps import epoch_micros
from hourspark.operators import ordered


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds a third of all rows."""
    random.seed(3)
    data = [(i, 0 if i % 3 == 0 else i % 17 + 1, random.randint(0, 5000), random.choice([None, 1.0, 2.5, 4.0])) for i in range(3000)]
    return spark.createDataFrame(data, "id long, k long, at long, v double").cache()


@pytest.mark.parametrize("width", [37, 1000, 10_000_000])
def test_running_equals_a_plain_window(hot, width):
    got = ordered.running(hot, ["k"], ["at", "id"], ordered.slice_of(F.col("at"), width), {
        "s": ("sum", F.col("v")), "n": ("count", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "l": ("last", F.col("v")),
    })
    w = "OVER (PARTITION BY k ORDER BY at, id ROWS UNBOUNDED PRECEDING)"
    want = hot.selectExpr("*", f"sum(v) {w} AS s", f"count(v) {w} AS n", f"max(v) {w} AS hi", f"min(v) {w} AS lo", f"last(v, true) {w} AS l")
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_neighbour_crosses_slices(hot):
    got = ordered.neighbour(hot, ["k"], ["at", "id"], ordered.slice_of(F.col("at"), 11), ["id", "v"])
    want = hot.selectExpr("*", "lag(struct(id, v)) OVER (PARTITION BY k ORDER BY at, id) AS prev")
    assert got.exceptAll(want).count() == 0


def test_row_numbers_over_all_rows(hot):
    got = ordered.numbered(hot, [], ["id"], F.floor(F.col("id") / 100))
    assert got.filter("rn <> id + 1").count() == 0


def test_rank_value_takes_the_element_at_the_floor(spark):
    for n in (1, 20, 21, 100):
        df = spark.range(n).select(F.col("id").alias("v"))
        assert ordered.rank_value(df, [], "v", 0.95, "p", 7.0).first().p == min(n - 1, int(0.95 * n))


def test_step_lookup_is_an_as_of_join(spark, rows):
    ref = spark.createDataFrame([("a", 10.0, 0.25), ("a", 20.0, 1.0), ("b", 5.0, 1.0)], "g string, x double, f double")
    ask = spark.createDataFrame([(1, "a", 9.0), (2, "a", 10.0), (3, "a", 19.9), (4, "a", 99.0), (5, "b", 5.0)], "id int, g string, x double")
    got = ordered.step_lookup(ref, ask, ["g"], "x", "f", 3.0)
    assert rows(got.select("id", "f"), "id") == [(1, None), (2, 0.25), (3, 0.25), (4, 1.0), (5, 1.0)]


def history(spark):
    start = "timestamp_ntz'2024-01-01 00:00:00'"
    data = [("ta-1", t, v) for t, v in ((0, 100), (1, 101), (24, 124), (168, 268), (169, 269))] + [("scats-1", 169, 900)]
    df = spark.createDataFrame(data, "unit string, t int, vehicle_count long")
    return df.select("unit", "t", "vehicle_count", (F.expr(start) + F.make_dt_interval(F.lit(0), F.col("t"), F.lit(0), F.lit(0))).alias("hour_start_utc"))


@pytest.mark.parametrize("slice_hours", [168, 200, 672])
def test_lags_are_exact_and_windows_strictly_past(spark, slice_hours):
    out = ordered.past_windows(history(spark), ["unit"], "hour_start_utc", "vehicle_count", slice_hours=slice_hours)
    at = {(r.unit, r.t): r for r in out.collect()}
    assert len(at) == 6
    day = at["ta-1", 24]
    assert (day.vehicle_count_lag_1h, day.vehicle_count_lag_24h, day.vehicle_count_lag_168h) == (None, 100, None)
    last = at["ta-1", 169]
    assert (last.vehicle_count_lag_1h, last.vehicle_count_lag_24h, last.vehicle_count_lag_168h) == (268, None, 101)
    assert (last.vehicle_count_rolling_past_24h_count, last.vehicle_count_rolling_past_24h_mean) == (1, 268.0)
    assert last.vehicle_count_rolling_past_168h_count == 3
    assert last.vehicle_count_rolling_past_168h_mean == pytest.approx((101 + 124 + 268) / 3)
    other = at["scats-1", 169]
    assert other.vehicle_count_lag_1h is None and other.vehicle_count_rolling_past_168h_count is None


def test_empty_window_counts_zero_on_request(spark):
    out = ordered.past_windows(history(spark), ["unit"], "hour_start_utc", "vehicle_count", null_when_empty=False)
    assert out.filter("unit = 'scats-1'").first().vehicle_count_rolling_past_168h_count == 0


def test_lag_join_agrees_with_the_window(spark):
    df = history(spark)
    a = ordered.past_windows(df, ["unit"], "hour_start_utc", "vehicle_count")
    b = ordered.shifted_lags(df, ["unit"], "hour_start_utc", "vehicle_count")
    assert b.exceptAll(a.select(*b.columns)).count() == 0


def test_results_do_not_depend_on_partitioning(spark, hot):
    one = ordered.numbered(hot.coalesce(1), ["k"], ["at", "id"], ordered.slice_of(F.col("at"), 50))
    many = ordered.numbered(hot.orderBy(F.rand(5)).repartition(13), ["k"], ["at", "id"], ordered.slice_of(F.col("at"), 400))
    assert one.exceptAll(many).count() == 0


def test_epoch_micros_keeps_fractions(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-02-29 23:59:59.123456' AS t, timestamp_ntz'1969-12-31 23:59:59.5' AS u")
    assert tuple(df.select(epoch_micros(F.col("t")), epoch_micros(F.col("u"))).first()) == (1709251199123456, -500000)
