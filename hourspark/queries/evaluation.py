"""Forecast scores, winners, samples, encoding and fitted models over hourly event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourspark.functions.timestamps import MICROS_PER_HOUR, epoch_micros, floor_hour
from hourspark.operators import metrics, quality, sampling
from hourspark.operators.ordered import past_windows
from hourspark.plans import features as feats
from hourspark.plans import forecasting
from hourspark.queries import Tables, query, rounded
from hourspark.queries.timeseries import LAGGED, SPLIT_SQL, SPLITS, lagged_events
from hourspark.session import cut

SCORES = ["target_mean", "mae", "rmse", "poisson_deviance"]


def score_sql(y: str, p: str) -> str:
    """Scores of the pairs in which both sides are known."""
    pair = f"{y} IS NOT NULL AND {p} IS NOT NULL"
    mean = f"greatest({p}, 1e-12)"
    return f"""count(*) FILTER (WHERE {pair}) AS n, round(avg({y}::DOUBLE) FILTER (WHERE {pair}), 6) AS target_mean,
  round(avg(abs({y} - greatest({p}, 0))) FILTER (WHERE {pair}), 6) AS mae, round(sqrt(avg(({y} - greatest({p}, 0)) ** 2) FILTER (WHERE {pair})), 6) AS rmse,
  round(2 * avg(CASE WHEN {y} > 0 THEN {y} * (ln({y}::DOUBLE) - ln({mean})) - ({y} - {mean}) ELSE {mean} END) FILTER (WHERE {pair}), 6) AS poisson_deviance"""


PREDICTED = f"SELECT *, n_rolling_past_24h_mean AS prediction, {SPLIT_SQL} AS split FROM ({LAGGED}) l"


def predicted_events(t: Tables) -> DataFrame:
    split = feats.split_by_date(F.to_date("hour"), SPLITS, "post_test")
    return lagged_events(t).withColumn("prediction", F.col("n_rolling_past_24h_mean")).withColumn("split", split)


@query(f"WITH p AS ({PREDICTED}) SELECT {score_sql('p.n', 'prediction')} FROM p")
def metric_bundle(t: Tables) -> DataFrame:
    return rounded(metrics.score(predicted_events(t), "n", "prediction"), *SCORES)


@query(f"""WITH p AS ({PREDICTED}), u AS (SELECT user_id, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS seen FROM p GROUP BY 1),
  x AS (SELECT split, p.n AS y, prediction AS q, user_id, seen, n_lag_1h, n_lag_24h FROM p JOIN u USING (user_id)),
  c AS (SELECT split, y, q, unnest(['overall', 'unit', 'seen', 'missingness', 'feature:n_lag_1h', 'feature:n_lag_24h']) AS scope,
    unnest(['all', user_id::VARCHAR, CASE seen WHEN 1 THEN 'seen' ELSE 'unseen' END, CASE WHEN n_lag_1h IS NULL OR n_lag_24h IS NULL THEN 'missing' ELSE 'complete' END,
      CASE WHEN n_lag_1h IS NULL THEN 'missing' ELSE 'present' END, CASE WHEN n_lag_24h IS NULL THEN 'missing' ELSE 'present' END]) AS level FROM x),
  g AS (SELECT split, scope, level, {score_sql('y', 'q')} FROM c GROUP BY 1, 2, 3),
  spine AS (SELECT * FROM (SELECT DISTINCT split FROM p), (VALUES ('seen', 'seen'), ('seen', 'unseen'), ('missingness', 'complete'), ('missingness', 'missing'),
    ('feature:n_lag_1h', 'present'), ('feature:n_lag_1h', 'missing'), ('feature:n_lag_24h', 'present'), ('feature:n_lag_24h', 'missing')) v(scope, level))
  SELECT split, scope, level, coalesce(g.n, 0)::BIGINT AS n, target_mean, mae, rmse, poisson_deviance FROM spine FULL JOIN g USING (split, scope, level)""")
def metrics_by_scope(t: Tables) -> DataFrame:
    rows = predicted_events(t)
    seen = rows.filter("split = 'train'").select("user_id").distinct().withColumn("seen", F.lit(True))
    known = rows.join(seen, "user_id", "left")
    gone = {f: F.col(f).isNull() for f in ("n_lag_1h", "n_lag_24h")}
    scopes = {
        "overall": F.lit("all"), "unit": F.col("user_id"), "seen": F.when(F.col("seen"), "seen").otherwise("unseen"),
        "missingness": F.when(gone["n_lag_1h"] | gone["n_lag_24h"], "missing").otherwise("complete"),
    }
    out = metrics.score_scopes(known, "n", "prediction", ["split"], scopes, gone, {"seen": ["seen", "unseen"], "missingness": ["complete", "missing"]})
    return rounded(out, *SCORES)


@query(f"""WITH p AS ({PREDICTED}), b AS (SELECT split, n AS y, unnest(['lag_1h', 'lag_24h', 'lag_168h']) AS baseline, unnest([n_lag_1h, n_lag_24h, n_lag_168h])::DOUBLE AS v FROM p)
  SELECT split, baseline, {score_sql('y', 'v')}, count(v) AS available_rows, count(*) - count(v) AS missing_rows, round(count(v) / count(*), 6) AS coverage FROM b GROUP BY 1, 2""")
def baseline_metrics(t: Tables) -> DataFrame:
    lags = {f"lag_{k}h": f"n_lag_{k}h" for k in (1, 24, 168)}
    return rounded(metrics.score_baselines(predicted_events(t), "n", lags, ["split"], non_negative=True), *SCORES, "coverage")


CANDIDATES = ["base", "lag_enhanced", "daily"]
LONG_SQL = f"""c AS (SELECT user_id, hour, split, n AS y, unnest(['base', 'lag_enhanced', 'daily']) AS candidate, unnest([1.0::DOUBLE, n_rolling_past_24h_mean, n_lag_24h::DOUBLE]) AS q FROM ({PREDICTED}) p),
  g AS (SELECT user_id, split, candidate, {score_sql('y', 'q')} FROM c GROUP BY 1, 2, 3)"""


def candidate_rows(t: Tables) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(n).alias("candidate"), c.cast("double").alias("prediction"))
        for n, c in (("base", F.lit(1.0)), ("lag_enhanced", F.col("prediction")), ("daily", F.col("n_lag_24h")))
    ])
    return predicted_events(t).select("user_id", "hour", "split", F.col("n").alias("actual"), F.explode(cells).alias("c")).select(
        "user_id", "hour", "split", "actual", "c.candidate", "c.prediction",
    )


@query(f"""WITH {LONG_SQL} SELECT user_id, split, candidate, n, target_mean, mae, rmse, poisson_deviance FROM g WHERE split = 'validation'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY poisson_deviance NULLS LAST, mae NULLS LAST, rmse NULLS LAST, CASE candidate WHEN 'base' THEN 1 WHEN 'lag_enhanced' THEN 2 ELSE 3 END) = 1""")
def winner_per_group(t: Tables) -> DataFrame:
    scores = rounded(metrics.score(candidate_rows(t), "actual", "prediction", ["user_id", "split", "candidate"]), *SCORES)
    return metrics.winner(scores, ["user_id"], CANDIDATES)


@query(f"""WITH {LONG_SQL}, k AS (SELECT user_id, hour, split FROM c WHERE q IS NOT NULL GROUP BY ALL HAVING count(DISTINCT candidate) = 3)
  SELECT split, candidate, {score_sql('y', 'q')} FROM c JOIN k USING (user_id, hour, split) GROUP BY 1, 2""")
def matched_ablation(t: Tables) -> DataFrame:
    """All candidates scored on the keys that every one of them can answer."""
    usable = candidate_rows(t).filter("prediction IS NOT NULL")
    return rounded(forecasting.evaluate(usable, ["user_id", "hour"], CANDIDATES), *SCORES)


@query(f"""WITH p AS ({PREDICTED}), u AS (SELECT DISTINCT user_id FROM p WHERE split = 'train')
  SELECT user_id, hour, split, n::DOUBLE AS actual, round(CASE WHEN prediction IS NOT NULL THEN greatest(prediction, 0) END, 6) AS prediction, user_id IN (SELECT user_id FROM u) AS unit_seen_in_train,
  (n_lag_1h IS NULL)::INT + (n_lag_24h IS NULL)::INT AS missing_feature_count, CASE WHEN n_lag_1h IS NULL OR n_lag_24h IS NULL THEN 'missing' ELSE 'complete' END AS missingness_group,
  n_lag_168h::DOUBLE AS baseline_lag_168h FROM p""")
def prediction_table(t: Tables) -> DataFrame:
    rows = predicted_events(t)
    seen = rows.filter("split = 'train'").select("user_id").distinct().withColumn("seen", F.lit(True))
    out = metrics.prediction_table(
        rows.join(seen, "user_id", "left"), ["user_id", "hour", "split"], "n", "prediction", F.coalesce("seen", F.lit(False)),
        ["n_lag_1h", "n_lag_24h"], {"lag_168h": "n_lag_168h"},
    )
    return rounded(out, "prediction")


@query(f"""WITH p AS ({PREDICTED}), v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS code FROM (SELECT DISTINCT 'int:' || user_id AS token FROM p WHERE hour::DATE = DATE '2024-01-01'))
  SELECT user_id, hour, code AS user_id__code, code IS NULL AS user_id__unseen FROM p LEFT JOIN v ON token = 'int:' || user_id""")
def encode_unseen(t: Tables) -> DataFrame:
    """Codes from the vocabulary of the first day; users first met later are unseen."""
    rows = predicted_events(t)
    train = rows.filter(F.to_date("hour") == F.lit("2024-01-01").cast("date"))
    return forecasting.encode(rows.select("user_id", "hour"), train, ["user_id"]).select("user_id", "hour", "user_id__code", "user_id__unseen")


@query("""WITH c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT sum(n) AS total FROM c), q0 AS (SELECT event_type, day, n, greatest(1, round_even(n / total * 400, 0))::BIGINT AS quota FROM c, t)
  SELECT event_type, day, n, quota FROM q0""")
def stratum_quotas(t: Tables) -> DataFrame:
    """Unadjusted quotas of a 400-row preview over (event type, day)."""
    counts = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.withColumn("quota", F.greatest(F.lit(1), F.bround(F.col("n") / total * 400).cast("bigint")))


@query("""WITH RECURSIVE c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
  q AS (SELECT 0 AS step, event_type, n, greatest(1, round_even(n / total * 500, 0))::BIGINT AS quota FROM c, t
    UNION ALL SELECT step + 1, event_type, n, CASE WHEN sum(quota) OVER () > 500 AND row_number() OVER (ORDER BY quota DESC, event_type) = 1 THEN quota - 1
      WHEN sum(quota) OVER () < 500 AND row_number() OVER (ORDER BY n - quota DESC, event_type) = 1 THEN quota + 1 ELSE quota END FROM q WHERE step < 10),
  f AS (SELECT event_type, quota FROM q WHERE step = 10)
  SELECT event_id, event_type, user_id FROM events JOIN f USING (event_type) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sha256(event_id::VARCHAR || '|' || user_id), event_id) <= quota""")
def stratified_preview(t: Tables) -> DataFrame:
    key = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    return sampling.stratified_preview(t.events.select("event_id", "event_type", "user_id"), ["event_type"], key, 500, ["event_id"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY substr(sha256(o_orderkey::VARCHAR), 1, 16), o_orderkey::VARCHAR LIMIT 300")
def hash_sample(t: Tables) -> DataFrame:
    return sampling.hash_sample(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey").cast("string"), 300)


@query("SELECT o_orderkey FROM orders ORDER BY substr(sha256('42|' || o_orderkey), 1, 16) LIMIT 250")
def seeded_sample(t: Tables) -> DataFrame:
    return sampling.seeded_sample(t.orders.select("o_orderkey"), F.col("o_orderkey"), 250, seed=42)


FEATURES = ["n_lag_1h", "n_lag_24h", "n_lag_168h", "n_rolling_past_24h_mean", "n_rolling_past_168h_mean", "hour_sin", "hour_cos"]


def modelled(t: Tables) -> DataFrame:
    return predicted_events(t).drop("prediction").withColumns(
        feats.calendar_features(F.to_date("hour"), F.hour("hour"), "sunday")
    )


@query("""WITH p AS (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
  m AS (SELECT hour AS moment FROM p GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 3),
  x AS (SELECT m.moment, p.*, EXISTS (SELECT 1 FROM p b WHERE b.user_id = p.user_id AND b.hour = p.hour - INTERVAL 1 HOUR) AS lagged,
      EXISTS (SELECT 1 FROM p b WHERE b.user_id = p.user_id AND b.hour >= m.moment AND b.hour <= p.hour + INTERVAL 1 HOUR AND b.hour >= p.hour - INTERVAL 1 HOUR) AS near,
      EXISTS (SELECT 1 FROM p b WHERE b.user_id = p.user_id AND b.hour >= m.moment AND b.hour::DATE = p.hour::DATE) AS today FROM m JOIN p ON p.hour <= m.moment),
  c AS (SELECT count(*) FILTER (WHERE hour = moment) AS n, count(*) FILTER (WHERE hour = moment AND lagged) AS n_twice, count(*) FILTER (WHERE near) AS n_around, count(*) FILTER (WHERE today) AS day_total,
      0 AS n_lag_1h, 0 AS n_lag_24h, 0 AS n_lag_168h, 0 AS n_rolling_past_24h_mean, 0 AS n_rolling_past_168h_mean, 0 AS hour_sin, 0 AS hour_cos FROM x)
  SELECT name, name NOT IN ('n', 'n_twice') AS marked, changed::BIGINT AS changed, name IN ('n', 'n_twice') OR changed > 0 AS leaks FROM (UNPIVOT c ON COLUMNS(*) INTO NAME name VALUE changed)""")
def leakage_report(t: Tables) -> DataFrame:
    """Which columns of the modelled hours may not be features: those without a mark, and those whose mark is wrong.

    ``n_around`` and the joined ``day_total`` are marked as known in time and are not; only the data shows it.
    """
    rows = t.events.groupBy("user_id", floor_hour(F.col("ts").cast("timestamp_ntz")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    rows = cut(rows)

    def build(hours: DataFrame) -> DataFrame:
        lagged = past_windows(hours, ["user_id"], "hour", "n").withColumns(feats.calendar_features(F.to_date("hour"), F.hour("hour"), "sunday"))
        around = Window.partitionBy("user_id").orderBy(epoch_micros(F.col("hour"))).rangeBetween(-MICROS_PER_HOUR, MICROS_PER_HOUR)
        total = hours.groupBy("user_id", F.to_date("hour").alias("day")).agg(F.sum("n").alias("day_total"))
        out = lagged.withColumns({"n_twice": F.col("n_lag_1h") + F.col("n"), "day": F.to_date("hour")}).withColumn("n_around", F.avg("n").over(around))
        return quality.mark_known(out.join(total, ["user_id", "day"]), ["n_around", "day_total"])

    names = ["n", *FEATURES, "n_twice", "n_around", "day_total"]
    busy = rows.groupBy("hour").count().orderBy(F.col("count").desc(), "hour").limit(3).select(epoch_micros(F.col("hour")).alias("us"))
    unmarked = quality.leaking_features(build(rows), names)
    found = quality.leaks_on_data(build, rows, ["user_id"], "hour", "n", names, [r.us for r in busy.collect()])
    marked = ~F.col("name").isin(unmarked)
    return found.select("name", marked.alias("marked"), "changed", (~marked | (F.col("changed") > 0)).alias("leaks"))


@query()
def poisson_fit_predict(t: Tables) -> DataFrame:
    """Poisson regression trained on the train split, scored on validation and test."""
    rows = modelled(t)
    model = forecasting.fit_poisson(rows.filter("split = 'train'"), FEATURES, "n")
    done = forecasting.predict(model, rows.filter("split <> 'train'"), FEATURES)
    return rounded(metrics.score(done, "n", "prediction", ["split"]), *SCORES)


@query()
def tree_fit_predict(t: Tables) -> DataFrame:
    """Boosted trees stopped on the validation split, with the importance of each feature."""
    rows = modelled(t)
    model = forecasting.fit_trees(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), FEATURES, "n", rounds=8, depth=4)
    scores = metrics.score(forecasting.predict(model, rows.filter("split = 'test'"), FEATURES), "n", "prediction")
    ranked = F.lit(" > ".join(name for name, _ in forecasting.ranking(model, FEATURES)))
    return rounded(scores.withColumn("ranking", ranked), *SCORES)


# Models whose answers are known: a feature with two values splits the training rows into two groups, and both
# models must return what the group says: its mean, or the mean of its logarithms.
GROUP_SQL = f"""WITH p AS ({PREDICTED}), g AS (SELECT *, (dayofweek(hour) IN (0, 6))::INTEGER AS is_weekend FROM p)"""


def grouped(t: Tables) -> DataFrame:
    rows = predicted_events(t).drop("prediction")
    return quality.mark_known(rows.withColumn("is_weekend", F.dayofweek("hour").isin(1, 7).cast("int")), ["is_weekend"], quality.ALWAYS)


@query(f"""{GROUP_SQL}, m AS (SELECT is_weekend, avg(n) AS mean FROM g WHERE split = 'train' GROUP BY 1)
  SELECT split, is_weekend, count(*) AS rows, round(max(mean), 4) AS prediction FROM g JOIN m USING (is_weekend) GROUP BY 1, 2""")
def poisson_group_means(t: Tables) -> DataFrame:
    """Poisson regression on one indicator, without a ridge: predictions are the training means of its groups."""
    rows = grouped(t)
    model = forecasting.fit_poisson(rows.filter("split = 'train'"), ["is_weekend"], "n", ridge=0.0)
    done = forecasting.predict(model, rows, ["is_weekend"])
    return rounded(done.groupBy("split", "is_weekend").agg(F.count(F.lit(1)).alias("rows"), F.max("prediction").alias("prediction")), "prediction", digits=4)


@query(f"""{GROUP_SQL}, m AS (SELECT is_weekend, exp(avg(ln(n + 1.0::DOUBLE))) - 1 AS mean FROM g WHERE split = 'train' GROUP BY 1)
  SELECT split, is_weekend, count(*) AS rows, round(max(mean), 4) AS prediction, 'is_weekend' AS ranking FROM g JOIN m USING (is_weekend) GROUP BY 1, 2""")
def tree_group_means(t: Tables) -> DataFrame:
    """One tree of one split on the same indicator, and its ranking."""
    rows = grouped(t)
    model = forecasting.fit_trees(rows.filter("split = 'train'"), rows.filter("split = 'validation'"), ["is_weekend"], "n", rounds=1, depth=1)
    done = forecasting.predict(model, rows, ["is_weekend"])
    ranked = F.lit(" > ".join(name for name, _ in forecasting.ranking(model, ["is_weekend"])))
    out = done.groupBy("split", "is_weekend").agg(F.count(F.lit(1)).alias("rows"), F.max("prediction").alias("prediction"))
    return rounded(out.withColumn("ranking", ranked), "prediction", digits=4)
