import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourspark.operators import metrics, sampling
from hourspark.operators.quality import mark_known
from hourspark.plans import forecasting


def bundle(y, p):
    y, p = np.asarray(y, float), np.clip(np.asarray(p, float), 0, None)
    mu = np.maximum(p, 1e-12)
    dev = np.where(y > 0, y * (np.log(np.where(y > 0, y, 1)) - np.log(mu)) - (y - mu), mu)
    return len(y), y.mean(), np.abs(y - p).mean(), math.sqrt(((y - p) ** 2).mean()), 2 * dev.mean()


def test_scores_equal_their_definition(spark):
    data = [(0.0, 1.0), (3.0, 2.5), (10.0, 0.0), (4.0, -2.0), (5.0, float("nan")), (None, 2.0), (6.0, float("inf"))]
    got = metrics.score(spark.createDataFrame(data, "y double, p double"), "y", "p").first()
    want = bundle([0, 3, 10, 4], [1, 2.5, 0, -2])
    assert tuple(got) == pytest.approx(want)


def test_no_usable_pair_gives_nulls(spark):
    got = metrics.score(spark.createDataFrame([(1.0, None)], "y double, p double"), "y", "p").first()
    assert tuple(got) == (0, None, None, None, None)


def test_scopes_include_empty_levels_and_missing_strata(spark):
    df = spark.createDataFrame([("test", 1.0, 1.0, "a", None), ("test", 2.0, 1.0, None, 3.0)], "split string, y double, p double, q string, f double")
    out = metrics.score_scopes(df, "y", "p", ["split"], {"quality": F.col("q"), "seen": F.lit("seen")}, {"f": F.col("f").isNull()}, {"seen": ["seen", "unseen"]})
    got = {(r.scope, r.level): r.n for r in out.collect()}
    assert got == {("quality", "a"): 1, ("quality", "<MISSING>"): 1, ("seen", "seen"): 2, ("seen", "unseen"): 0, ("feature:f", "missing"): 1, ("feature:f", "present"): 1}


def test_winner_uses_validation_only_and_ties_go_to_the_first_candidate(spark):
    data = [("g", "base", "validation", 1.0, 2.0, 3.0), ("g", "lag_enhanced", "validation", 1.0, 2.0, 3.0), ("g", "lag_enhanced", "test", 0.1, 0.1, 0.1),
            ("h", "base", "validation", None, 1.0, 1.0), ("h", "lag_enhanced", "validation", 9.0, 9.0, 9.0)]
    scores = spark.createDataFrame(data, "group_id string, candidate string, split string, poisson_deviance double, mae double, rmse double")
    assert {r.group_id: r.candidate for r in metrics.winner(scores, ["group_id"], ["base", "lag_enhanced"]).collect()} == {"g": "base", "h": "lag_enhanced"}


def test_quotas_sum_to_the_rows_and_keep_every_stratum(spark):
    def quotas(counts, rows):
        df = spark.createDataFrame(list(enumerate(counts)), "s int, n long")
        return [r.quota for r in sampling.quotas(df, ["s"], "n", rows).orderBy("s").collect()]

    assert quotas([1, 1, 998], 10) == [1, 1, 8]
    assert sum(quotas([333, 333, 334], 100)) == 100
    assert quotas([5] * 4, 2) == [1] * 4
    assert quotas([10, 10, 10], 4) == [2, 1, 1]  # a missing row goes to the first of equals
    assert quotas([3, 3, 3, 3], 6) == [1, 1, 2, 2]  # what is too much comes off the first of equals


def test_preview_of_very_many_strata(spark):
    df = spark.range(30_000).select("id", F.floor(F.col("id") / 2).alias("s"))
    out = sampling.stratified_preview(df, ["s"], F.col("id").cast("string"), 16_000, ["id"])
    assert out.count() == 16_000 and out.select("s").distinct().count() == 15_000


def test_preview_does_not_depend_on_input_order(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("usual").alias("s"))
    a = sampling.stratified_preview(df, ["s"], F.col("id").cast("string"), 50, ["id"]).collect()
    b = sampling.stratified_preview(df.orderBy(F.rand(1)).repartition(7), ["s"], F.col("id").cast("string"), 50, ["id"]).collect()
    assert a == b and len(a) == 50 and sum(r.s == "rare" for r in a) == 5


def test_vocabulary_follows_the_text_order(spark):
    ids = ["scats:1", "scats:44", "ta:10", "ta:9", "x:5", "-1", "ärger", "z", "Z", "", *[f"site:{k}" for k in range(300)]]
    train = spark.createDataFrame([(x, len(x)) for x in reversed(ids)], "u string, n int")
    got = forecasting.encode(train, train, ["u", "n"]).select("u", "n", "u__code", "n__code").collect()
    assert {r.u: r.u__code for r in got} == {u: k for k, u in enumerate(sorted(ids, key=lambda x: x.encode()))}
    assert {r.n: r.n__code for r in got} == {n: k for k, n in enumerate(sorted({len(x) for x in ids}, key=str))}


def test_vocabulary_comes_from_training_only(spark):
    train = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "u string")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "i int, u string")
    got = {r.i: (r.u__code, r.u__unseen) for r in forecasting.encode(rows, train, ["u"]).collect()}
    assert got == {1: (0, False), 2: (1, False), 3: (None, True), 4: (None, False)}


def test_poisson_regression_learns_and_keeps_nulls_out_of_the_table(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 2, 2000)
    y = rng.poisson(np.exp(0.5 + 0.8 * x))
    df = spark.createDataFrame([(float(a), float(b), None if i % 7 == 0 else float(a)) for i, (a, b) in enumerate(zip(x, y))], "hour_sin double, n double, n_lag_1h double")
    df = mark_known(df, ["hour_sin", "n_lag_1h"])
    model = forecasting.fit_poisson(df, ["hour_sin", "n_lag_1h"], "n")
    done = forecasting.predict(model, df, ["hour_sin", "n_lag_1h"])
    flat = df.withColumn("prediction", F.lit(float(y.mean())))
    assert metrics.score(done, "n", "prediction").first().poisson_deviance < metrics.score(flat, "n", "prediction").first().poisson_deviance
    assert done.filter("n_lag_1h IS NULL").count() == df.filter("n_lag_1h IS NULL").count()


def test_candidates_are_scored_on_shared_keys(spark):
    data = [(1, "test", "base", 1.0, 1.0), (1, "test", "lag_enhanced", 1.0, 2.0), (2, "test", "base", 5.0, 1.0)]
    out = forecasting.evaluate(spark.createDataFrame(data, "k int, split string, candidate string, actual double, prediction double"), ["k"])
    assert {r.candidate: r.n for r in out.collect()} == {"base": 1, "lag_enhanced": 1}
