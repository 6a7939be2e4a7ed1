"""Contracts, key checks, coverage and inventories over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.functions.timestamps import floor_hour, plus
from hourspark.operators import intervals, ordered, quality
from hourspark.operators.quality import Expectation
from hourspark.plans import features as feats
from hourspark.queries import Tables, query
from hourspark.queries.timeseries import HOURLY, LAGGED, hourly_events, lagged_events
from hourspark.sources import sinks


@query("""WITH c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS null_key_rows,
    count(*) FILTER (WHERE l_quantity IS NULL OR l_quantity < 0 OR l_quantity <> floor(l_quantity)) AS invalid_target_rows, count(*) FILTER (WHERE date_trunc('hour', l_shipdate) <> l_shipdate) AS non_hourly_rows,
    count(*) FILTER (WHERE l_tax > 0.07) AS high_tax, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_key_groups FROM lineitem)
  UNPIVOT c ON COLUMNS(*) INTO NAME name VALUE violations""")
def expectations_report(t: Tables) -> DataFrame:
    key = ["l_orderkey", "l_linenumber"]
    rules = [*quality.hourly_target_rules(key, "l_shipdate", "l_quantity"), Expectation("high_tax", F.col("l_tax") > 0.07)]
    return quality.report(t.lineitem, rules, key)


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return quality.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
  SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS shared_keys, count(*) FILTER (WHERE b.k IS NULL) AS left_only_keys, count(*) FILTER (WHERE a.k IS NULL) AS right_only_keys
  FROM a FULL JOIN b USING (k)""")
def key_alignment(t: Tables) -> DataFrame:
    return quality.key_alignment(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), ["k"])


@query("""WITH a AS (SELECT l_orderkey AS k, max(l_shipdate) AS at, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, o_orderdate AS at, o_custkey AS q FROM orders)
  SELECT k, a.at AS left_at, b.at AS right_at, a.q AS left_q, b.q AS right_q FROM a JOIN b USING (k) WHERE a.at IS DISTINCT FROM b.at OR a.q IS DISTINCT FROM b.q""")
def candidate_mismatches(t: Tables) -> DataFrame:
    left = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").alias("at"), F.sum("l_quantity").cast("bigint").alias("q"))
    right = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("q"))
    return quality.mismatches(left, right, ["k"], ["at", "q"])


@query("""WITH days AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31', INTERVAL 1 DAY))::DATE AS day), seen AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)
  SELECT day, day >= DATE '2001-10-01' AS allowed FROM days ANTI JOIN seen USING (day)""")
def coverage_gaps(t: Tables) -> DataFrame:
    spark = t.spark
    spine = quality.date_spine(spark.sql("SELECT DATE '1995-01-01' AS a, DATE '2001-12-31' AS b"), "a", "b")
    allowed = quality.date_spine(spark.sql("SELECT DATE '2001-10-01' AS a, DATE '2001-12-31' AS b"), "a", "b")
    return quality.coverage_gaps(spine, t.orders.select(F.to_date("o_orderdate").alias("day")), allowed)


@query("""WITH days AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2003-12-31', INTERVAL 1 DAY))::DATE AS day), seen AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders),
  marked AS (SELECT day, day IN (SELECT day FROM seen) AS observed, day >= DATE '2002-06-01' AS allowed FROM days),
  years AS (SELECT year(day) AS y FROM marked GROUP BY 1 HAVING count(*) FILTER (WHERE observed) = 0 AND count(*) FILTER (WHERE NOT allowed) > 0),
  r AS (SELECT count(*) AS missing_dates, count(*) FILTER (WHERE allowed) AS allowed_missing_dates, count(*) FILTER (WHERE NOT allowed) AS unexpected_missing_dates,
    (SELECT count(*) FROM years) AS missing_years, (SELECT count(*) FROM (SELECT unnest(['O', 'F', 'P', 'X']) AS s) WHERE s NOT IN (SELECT o_orderstatus FROM orders)) AS missing_sources
    FROM marked WHERE NOT observed)
  SELECT *, missing_sources > 0 OR missing_years > 0 OR unexpected_missing_dates > 0 AS partial FROM r""")
def coverage_report(t: Tables) -> DataFrame:
    spark = t.spark
    spine = quality.date_spine(spark.sql("SELECT DATE '1995-01-01' AS a, DATE '2003-12-31' AS b"), "a", "b")
    allowed = quality.date_spine(spark.sql("SELECT DATE '2002-06-01' AS a, DATE '2003-12-31' AS b"), "a", "b")
    sources = spark.createDataFrame([("O",), ("F",), ("P",), ("X",)], "source string")
    observed = t.orders.select(F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("source"))
    return quality.coverage_report(spine, observed, allowed, sources, observed)


@query("""WITH b AS (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events WHERE event_type = 'error'),
  s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM b) SELECT hour FROM s ANTI JOIN (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'error') USING (hour)""")
def hourly_spine_gaps(t: Tables) -> DataFrame:
    """Hours without any error event."""
    return quality.hourly_spine_gaps(t.events.filter("event_type = 'error'"), "ts")


@query(f"""WITH l AS ({LAGGED}) SELECT unnest(['n_lag_1h', 'n_lag_24h', 'n_lag_168h']) AS parameter,
  unnest([count(*) FILTER (WHERE n_lag_1h IS NULL), count(*) FILTER (WHERE n_lag_24h IS NULL), count(*) FILTER (WHERE n_lag_168h IS NULL)]) AS missing_count,
  unnest([max(hour) FILTER (WHERE n_lag_1h IS NOT NULL), max(hour) FILTER (WHERE n_lag_24h IS NOT NULL), max(hour) FILTER (WHERE n_lag_168h IS NOT NULL)]) AS valid_max FROM l""")
def parameter_quality(t: Tables) -> DataFrame:
    return quality.parameter_quality(lagged_events(t), "hour", ["n_lag_1h", "n_lag_24h", "n_lag_168h"])


@query("""SELECT p_type, count(*) FILTER (WHERE p_type <> lower(trim(p_type))) AS p_type_not_canonical, count(*) FILTER (WHERE p_name <> lower(trim(p_name))) AS p_name_not_canonical, count(*) AS rows FROM part GROUP BY 1""")
def canonical_values(t: Tables) -> DataFrame:
    return quality.violations(t.part, quality.canonical_value_rules(["p_type", "p_name"]), ["p_type"])


@query("""SELECT o_orderpriority, min(o_orderstatus) AS o_orderstatus, count(*) AS rows, count(DISTINCT o_orderstatus) <> 1 AS mixed FROM orders GROUP BY 1""")
def group_inventory(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(
        F.min("o_orderstatus").alias("o_orderstatus"), F.count(F.lit(1)).alias("rows"), (F.count_distinct("o_orderstatus") != 1).alias("mixed"),
    )


@query("""SELECT 'orders.parquet' AS file, count(*) AS rows, count(DISTINCT o_orderpriority) <> 1 AS mixed, FALSE AS outside_contract FROM orders""")
def partition_inventory(t: Tables) -> DataFrame:
    contract = t.orders.select("o_orderpriority", "o_orderstatus").distinct()
    found = quality.partition_inventory(t.orders, "o_orderpriority", "o_orderstatus", contract)
    return found.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "rows", "mixed", "outside_contract")


@query(f"""WITH l AS ({LAGGED}), x AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY hour DESC) = 1)
  SELECT user_id, hour AS newest, n_lag_1h, n_lag_24h, n_lag_168h, concat_ws(';', CASE WHEN hour < TIMESTAMP '2024-01-30 12:00:00' THEN 'stale_lag_history' END,
    CASE WHEN n_lag_1h IS NULL OR n_lag_24h IS NULL OR n_lag_168h IS NULL THEN 'missing_lag_history' END) AS warnings,
  CASE WHEN hour < TIMESTAMP '2024-01-30 12:00:00' OR n_lag_1h IS NULL OR n_lag_24h IS NULL OR n_lag_168h IS NULL THEN 'degraded' ELSE 'ok' END AS status FROM x""")
def freshness_status(t: Tables) -> DataFrame:
    as_of = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    out = quality.freshness(lagged_events(t), ["user_id"], "hour", ["n_lag_1h", "n_lag_24h", "n_lag_168h"], as_of)
    return out.withColumn("warnings", F.array_join("warnings", ";"))


@query(f"""WITH c AS (SELECT count(*) AS rows, 0::BIGINT AS as_of_mismatch FROM ({HOURLY})) UNPIVOT c ON COLUMNS(*) INTO NAME name VALUE violations""")
def as_of_guard(t: Tables) -> DataFrame:
    base = hourly_events(t).withColumn("feature_asof", plus(F.col("hour"), hours=-1))
    return quality.report(base, [quality.as_of_rule("hour", "feature_asof")])


@query("""WITH f AS (SELECT user_id, event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS a, ts + to_minutes(floor(value / 4)::INTEGER) AS b FROM events),
  p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM f WINDOW w AS (PARTITION BY user_id, event_type ORDER BY a, b))
  SELECT user_id, event_type, a, b, pa AS previous_a, pb AS previous_b FROM p WHERE a < pb AND (a <> pa OR b <> pb)""")
def interval_overlaps(t: Tables) -> DataFrame:
    start = floor_hour(F.col("ts")) + F.make_dt_interval(F.lit(0), F.lit(0), (F.floor(F.minute("ts") / 5) * 5).cast("int"), F.lit(0))
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor(F.col("value") / 4).cast("int"), F.lit(0))
    spans = t.events.select("user_id", "event_type", start.alias("a"), end.alias("b"))
    return intervals.overlaps(spans, ["user_id", "event_type"], "a", "b")


@query("""SELECT event_id, epoch_us(ts) % 300000000 <> 0 OR floor(value) % 5 <> 0 OR floor(value) <> 5 AS off_grid FROM events""")
def interval_shape(t: Tables) -> DataFrame:
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"), F.lit(0))
    return t.events.select("event_id", intervals.off_grid(F.col("ts"), end, F.lit(False)).alias("off_grid"))


@query("""SELECT CASE WHEN o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'train' WHEN o_orderdate::DATE BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'validation'
  WHEN o_orderdate::DATE BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'test' ELSE 'post_test' END AS split, count(*) AS rows FROM orders GROUP BY 1""")
def chrono_split_fixed(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    bounds = [("train", dt.date(1995, 1, 1), dt.date(1998, 12, 31)), ("validation", dt.date(1999, 1, 1), dt.date(1999, 12, 31)), ("test", dt.date(2000, 1, 1), dt.date(2000, 12, 31))]
    return t.orders.groupBy(feats.split_by_date(day, bounds, "post_test").alias("split")).agg(F.count(F.lit(1)).alias("rows"))


SPAN_SQL = """e AS (SELECT min(ts) AS lo, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM events), s AS (SELECT *, CASE WHEN epoch_us(ts) < epoch_us(lo) + span * 0.70::DOUBLE THEN 'train'
  WHEN epoch_us(ts) < epoch_us(lo) + span * 0.85::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM events, e)"""


@query(f"WITH {SPAN_SQL} SELECT event_id, split FROM s")
def chrono_split_span(t: Tables) -> DataFrame:
    return feats.split_by_span(t.events, "ts").select("event_id", "split")


@query(f"WITH {SPAN_SQL} SELECT split, min(ts::DATE) AS min_date, max(ts::DATE) AS max_date, count(*) AS rows FROM s GROUP BY 1")
def split_bounds(t: Tables) -> DataFrame:
    return feats.split_bounds(feats.split_by_span(t.events, "ts").withColumn("day", F.to_date("ts")), "day")


@query(f"""WITH {SPAN_SQL}, b AS (SELECT split, min(ts::DATE) AS lo, max(ts::DATE) AS hi, CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS p FROM s GROUP BY 1)
  SELECT a.split AS earlier, c.split AS later FROM b a JOIN b c ON c.p = a.p + 1 WHERE c.lo <= a.hi""")
def split_order_faults(t: Tables) -> DataFrame:
    """Neighbouring splits that share a date."""
    return feats.split_faults(split_bounds(t), ["train", "validation", "test"])


@query("""SELECT count(*) - count(DISTINCT event_id) AS key_loss, count(*) AS rows, 0::BIGINT AS left_only_keys, 0::BIGINT AS right_only_keys FROM events""")
def row_preservation(t: Tables) -> DataFrame:
    """A feature join must keep every target row and key."""
    typical = t.events.groupBy("user_id").agg(F.avg("value").alias("typical"))
    joined = t.events.join(typical, "user_id", "left")
    sides = quality.key_alignment(t.events, joined, ["event_id"])
    facts = joined.agg((F.count(F.lit(1)) - F.count_distinct("event_id")).alias("key_loss"), F.count(F.lit(1)).alias("rows"))
    return facts.withColumns({c: sides.select(c).scalar() for c in ("left_only_keys", "right_only_keys")})


@query("""WITH g AS (SELECT c_mktsegment AS group_id, CASE WHEN c_nationkey < 13 THEN 'base' ELSE 'lag_enhanced' END AS candidate, CASE WHEN c_acctbal < 9000 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM customer GROUP BY ALL),
  copies AS (SELECT group_id, candidate, split FROM g UNION ALL SELECT group_id, candidate, split FROM g WHERE group_id = 'MACHINERY' AND split = 'test'),
  spine AS (SELECT * FROM (SELECT DISTINCT group_id FROM g), (SELECT unnest(['base', 'lag_enhanced', 'third']) AS candidate), (SELECT unnest(['validation', 'test']) AS split)),
  seen AS (SELECT group_id, candidate, split, count(*) AS rows FROM copies GROUP BY ALL)
  SELECT group_id, candidate, split, coalesce(rows, 0)::BIGINT AS rows FROM spine LEFT JOIN seen USING (group_id, candidate, split) WHERE coalesce(rows, 0) <> 1""")
def score_completeness(t: Tables) -> DataFrame:
    scores = t.customer.groupBy(
        F.col("c_mktsegment").alias("group_id"), F.when(F.col("c_nationkey") < 13, "base").otherwise("lag_enhanced").alias("candidate"),
        F.when(F.col("c_acctbal") < 9000, "validation").otherwise("test").alias("split"),
    ).agg(F.count(F.lit(1)).alias("n"))
    twice = scores.unionByName(scores.filter("group_id = 'MACHINERY' AND split = 'test'"))
    return quality.score_gaps(twice, ["base", "lag_enhanced", "third"], ["validation", "test"])


@query("""SELECT count(*) AS rows, min(ts::DATE)::VARCHAR AS first, max(ts::DATE)::VARCHAR AS last, count(DISTINCT user_id) AS units FROM events""")
def manifest_facts(t: Tables) -> DataFrame:
    """Facts of a JSON manifest row, read back from its text."""
    made = sinks.manifest(t.events, {
        "first": F.to_date(F.min("ts")).cast("string"), "last": F.to_date(F.max("ts")).cast("string"), "units": F.count_distinct("user_id"),
    })
    return made.select(F.from_json("manifest", "rows bigint, first string, last string, units bigint").alias("m")).select("m.*")


@query("SELECT * FROM (SELECT o_orderdate, o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 250)")
def head_preview(t: Tables) -> DataFrame:
    from hourspark.operators.sampling import preview

    return preview(t.orders.select("o_orderdate", "o_orderkey", "o_custkey"), ["o_orderdate", "o_orderkey"], 250)


@query("SELECT 0::BIGINT AS faults")
def ordered_table_check(t: Tables) -> DataFrame:
    """Write the orders in global key order, then look for order faults in the written files."""
    from hourspark.session import run_dir

    path = run_dir(t.spark, "ordered")
    sinks.write_ordered(t.orders, path, ["o_orderdate", "o_orderkey"])
    return sinks.order_faults(t.spark.read.schema(t.orders.schema).parquet(path), ["o_orderdate", "o_orderkey"])


@query("""SELECT user_id, event_type AS label, ts AS seen_at, event_id AS n FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.col("event_type").alias("label"), F.col("ts").alias("seen_at"), F.col("event_id").alias("n"))
    return ordered.latest(rows, ["user_id"], ["seen_at", "n"])


@query("""SELECT user_id, event_type, count(*) AS rows FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-19' GROUP BY 1, 2""")
def partition_pruned_selection(t: Tables) -> DataFrame:
    """Rows written by (source, split) are selected by partition pruning, not by reading them all."""
    from hourspark.session import run_dir

    split = F.when(F.col("ts") < F.lit("2024-01-19").cast("timestamp_ntz"), "train").otherwise("test")
    path = run_dir(t.spark, "partitioned")
    sinks.write_table(t.events.select("user_id", "event_type", split.alias("split")), path, ["event_type", "split"])
    kept = t.spark.read.parquet(path).filter("event_type = 'click' AND split = 'train'")
    return kept.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("rows"))
