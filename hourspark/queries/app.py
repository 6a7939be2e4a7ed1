"""Walk history, searches, places, candidates and exports over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.operators import activity, candidates
from hourspark.queries import Tables, query, rounded
from hourspark.queries.spatial import AT_SQL, customer_trips, metres_sql

WALKS_SQL = "w AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS completed_at, o_totalprice / 4096 AS distance_km, o_totalprice / 16384 AS emissions_kg, o_orderstatus FROM orders)"


def walks(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("completed_at"),
        (F.col("o_totalprice") / 4096).alias("distance_km"), (F.col("o_totalprice") / 16384).alias("emissions_kg"), "o_orderstatus",
    )


@query(f"""WITH {WALKS_SQL}, c AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT * FROM w WHERE o_orderstatus = 'P' AND distance_km > 0 AND distance_km <= 100 AND emissions_kg BETWEEN 0 AND 50),
  a AS (SELECT * FROM w WHERE o_orderstatus <> 'P' UNION ALL SELECT g.* FROM g ANTI JOIN c USING (id))
  SELECT count(*) AS total_walks, round(sum(emissions_kg), 4) AS total_emissions_kg, round(sum(distance_km), 4) AS total_distance_km FROM a""")
def community_totals(t: Tables) -> DataFrame:
    claimed = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    guests, _ = activity.split_guest_walks(walks(t).filter("o_orderstatus = 'P'"))
    return rounded(activity.community_totals(walks(t).filter("o_orderstatus <> 'P'"), guests, claimed), "total_emissions_kg", "total_distance_km", digits=4)


@query(f"""WITH {WALKS_SQL} SELECT id, NOT (distance_km > 0 AND distance_km <= 100 AND emissions_kg BETWEEN 0 AND 50) AS quarantined FROM w""")
def guest_walk_quarantine(t: Tables) -> DataFrame:
    kept, held = activity.split_guest_walks(walks(t))
    mark = lambda df, v: df.select("id", F.lit(v).alias("quarantined"))
    return mark(kept, False).unionByName(mark(held, True))


@query("""WITH n AS (SELECT max(o_orderdate)::DATE AS today FROM orders), d AS (SELECT unnest(generate_series(today - INTERVAL 27 DAY, today::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM n),
  u AS (SELECT DISTINCT o_custkey AS user_id FROM orders), c AS (SELECT o_custkey AS user_id, o_orderdate::DATE AS day, count(*) AS k FROM orders GROUP BY 1, 2)
  SELECT user_id, day, least(coalesce(k, 0), 3)::INTEGER AS level FROM u CROSS JOIN d LEFT JOIN c USING (user_id, day)""")
def activity_calendar(t: Tables) -> DataFrame:
    today = t.orders.agg(F.to_date(F.max("o_orderdate")).alias("d")).first().d
    return activity.calendar(walks(t), "user_id", "completed_at", F.lit(today))


@query(f"""WITH {WALKS_SQL} SELECT user_id, count(*) AS walks, round(sum(emissions_kg), 4) AS emissions_kg, count(*) FILTER (WHERE date_trunc('month', completed_at) = DATE '2001-07-01') AS walks_this_month FROM w GROUP BY 1""")
def user_totals(t: Tables) -> DataFrame:
    return rounded(activity.user_totals(walks(t), "user_id", "completed_at", F.lit("2001-07-15 09:00:00").cast("timestamp_ntz")), "emissions_kg", digits=4)


@query(f"WITH {WALKS_SQL} SELECT user_id, id, completed_at, row_number() OVER (PARTITION BY user_id ORDER BY completed_at DESC, id DESC)::INTEGER AS rn FROM w QUALIFY rn <= 8")
def recent_per_user(t: Tables) -> DataFrame:
    return activity.newest_n(walks(t).select("user_id", "id", "completed_at"), "user_id", "completed_at", 8, ["id"])


@query("SELECT user_id, event_type AS label, ts AS searched_at, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def search_upsert(t: Tables) -> DataFrame:
    searches = t.events.select("user_id", F.col("event_type").alias("label"), F.col("ts").alias("searched_at"), F.col("event_id").alias("id"))
    return activity.upserted_searches(searches, tie=["id"])


@query("""WITH p AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'home' WHEN 'purchase' THEN 'work' ELSE 'favorite' END AS kind, ts AS created_at, event_id AS id FROM events)
  SELECT * FROM p WHERE kind = 'favorite' UNION ALL SELECT * FROM p WHERE kind <> 'favorite' QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY created_at DESC, id DESC) = 1""")
def slot_replace(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "home").when(F.col("event_type") == "purchase", "work").otherwise("favorite")
    places = t.events.select("user_id", kind.alias("kind"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return activity.current_places(places, tie=["id"])


@query("""WITH b AS (SELECT user_id, hour(ts) AS h, avg(value) AS flow FROM events GROUP BY 1, 2), s AS (SELECT user_id, h, flow FROM b WHERE h >= 9 AND (h - 9) % 2 = 0 AND h <= 19),
  f AS (SELECT user_id, count(*) AS slots, max(flow) AS busy, arg_min(h, flow) AS h, min(flow) AS flow FROM s GROUP BY 1)
  SELECT user_id, TIMESTAMP '2024-01-31 00:00:00' + to_hours(h::INTEGER) AS quietest_at, round(flow, 6) AS flow FROM f WHERE slots >= 2 AND busy > 0 AND h > 9 AND (busy - flow) / busy >= 0.15""")
def quietest_slot(t: Tables) -> DataFrame:
    hourly = t.events.groupBy("user_id", F.hour("ts").alias("h")).agg(F.avg("value").alias("flow"))
    day = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    slots = hourly.withColumn("at", day + F.make_dt_interval(F.lit(0), F.col("h"), F.lit(0), F.lit(0)))
    now = F.lit("2024-01-31 09:00:00").cast("timestamp_ntz")
    return rounded(activity.quietest_slot(slots, ["user_id"], "at", "flow", now), "flow")


@query("""WITH w AS (SELECT o_custkey AS user_id, 'walks' AS section, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 5)::INTEGER AS part, o_orderkey FROM orders),
  x AS (SELECT user_id, section, part, count(*) AS rows, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM w GROUP BY 1, 2, 3)
  SELECT * FROM x UNION ALL SELECT c_custkey, 'profile', 0, 1, c_custkey::VARCHAR FROM customer""")
def account_export(t: Tables) -> DataFrame:
    """Exported documents of five rows per part, read back to their row ids."""
    made = activity.account_export({
        "walks": (t.orders.withColumn("id", F.col("o_orderkey")), "o_custkey", "o_orderdate", "o_orderkey"),
        "profile": (t.customer.withColumn("id", F.col("c_custkey")), "c_custkey", None, "c_custkey"),
    }, part_rows=5)
    ids = F.array_sort(F.transform(F.from_json("document", "array<struct<id:bigint>>"), lambda r: r["id"]))
    return made.select("user_id", "section", "part", F.size(ids).cast("bigint").alias("rows"), F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))


# Candidates --------------------------------------------------------------------------------------

CANDIDATE_SQL = """k AS (SELECT o_custkey AS request_id, CASE o_orderstatus WHEN 'F' THEN 'fastest' WHEN 'O' THEN 'shaded' ELSE 'quieter' END AS id,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS seq, floor(avg(o_totalprice) / 100) / 10 AS minutes, floor(avg(o_orderkey % 100)) / 100 AS shade,
    CASE WHEN max(o_orderkey) % 9 <> 0 THEN floor(avg(o_totalprice) / 500)::DOUBLE END AS crowd FROM orders GROUP BY ALL)"""


def order_candidates(t: Tables) -> DataFrame:
    """Each customer's orders by status as the candidates of one request."""
    kind = F.when(F.col("o_orderstatus") == "F", "fastest").when(F.col("o_orderstatus") == "O", "shaded").otherwise("quieter")
    seq = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    price = F.avg("o_totalprice")
    return t.orders.groupBy(F.col("o_custkey").alias("request_id"), kind.alias("id"), seq.alias("seq")).agg(
        (F.floor(price / 100) / 10).alias("minutes"), (F.floor(F.avg(F.pmod("o_orderkey", F.lit(100)))) / 100).alias("shade"),
        F.when(F.pmod(F.max("o_orderkey"), F.lit(9)) != 0, F.floor(price / 500).cast("double")).alias("crowd"),
    ).withColumn("ok", F.lit(True))


@query(f"""WITH {CANDIDATE_SQL}, f AS (SELECT request_id, count(*) AS n, count(crowd) AS nc, arg_min(seq, minutes * 10 + seq) AS quick, arg_max(seq, shade * 1000 - seq) AS shady, arg_min(seq, crowd * 10 + seq) AS calm,
    count(DISTINCT shade) AS ds, count(DISTINCT crowd) AS dc FROM k GROUP BY 1)
  SELECT request_id, id, seq, concat_ws(';', CASE WHEN minutes = min_m AND seq = first_m THEN 'fastest' END, CASE WHEN n >= 2 AND ds > 1 AND seq = first_s THEN 'most_shaded' END,
    CASE WHEN n >= 2 AND nc >= 2 AND dc > 1 AND seq = first_c THEN 'least_crowded' END) AS tags
  FROM (SELECT k.*, n, nc, ds, dc, min(minutes) OVER r AS min_m, first_value(seq) OVER (PARTITION BY request_id ORDER BY minutes, seq) AS first_m, first_value(seq) OVER (PARTITION BY request_id ORDER BY shade DESC, seq) AS first_s,
    first_value(seq) OVER (PARTITION BY request_id ORDER BY crowd NULLS LAST, seq) AS first_c FROM k JOIN f USING (request_id) WINDOW r AS (PARTITION BY request_id))""")
def candidate_tags(t: Tables) -> DataFrame:
    return candidates.tagged(order_candidates(t)).select("request_id", "id", "seq", F.array_join("tags", ";").alias("tags"))


@query(f"""WITH {CANDIDATE_SQL}, p AS (SELECT request_id, max(CASE WHEN id = 'fastest' THEN shade END) AS fs, max(CASE WHEN id = 'shaded' THEN shade END) AS ss, max(CASE WHEN id = 'fastest' THEN crowd END) AS fc,
    max(CASE WHEN id = 'shaded' THEN crowd END) AS sc, max(CASE WHEN id = 'quieter' THEN crowd END) AS qc FROM k GROUP BY 1),
  a AS (SELECT *, coalesce(abs(ss - fs) >= 0.04, FALSE) AS take_s FROM p),
  b AS (SELECT *, coalesce(abs(qc - fc) / CASE WHEN abs(fc) > 0.01 THEN abs(fc) WHEN fc IS NOT NULL THEN 0.01 END >= 0.08 AND (NOT take_s OR abs(qc - sc) / CASE WHEN abs(sc) > 0.01 THEN abs(sc) WHEN sc IS NOT NULL THEN 0.01 END >= 0.08), FALSE) AS take_q FROM a)
  SELECT request_id, id FROM k JOIN b USING (request_id) WHERE id = 'fastest' OR (id = 'shaded' AND take_s) OR (id = 'quieter' AND take_q)""")
def accept_candidates(t: Tables) -> DataFrame:
    return candidates.accepted(order_candidates(t)).select("request_id", "id")


@query(f"""WITH {CANDIDATE_SQL}, i AS (SELECT request_id, list(id ORDER BY seq) AS ids FROM k GROUP BY 1),
  f AS (SELECT c_custkey AS request_id, CASE WHEN c_acctbal >= 0 THEN c_mktsegment = 'BUILDING' END AS q, (c_nationkey * 4)::INTEGER AS h, CASE WHEN c_nationkey <> 7 THEN floor(c_acctbal / 100)::INTEGER END AS b FROM customer)
  SELECT request_id, CASE WHEN coalesce(q, FALSE) AND list_contains(ids, 'quieter') THEN 'quieter' WHEN coalesce(h, 0) >= 60 AND list_contains(ids, 'shaded') THEN 'shaded'
    WHEN coalesce(b, 100) < 40 AND list_contains(ids, 'shaded') THEN 'shaded' WHEN coalesce(b, 100) < 40 AND list_contains(ids, 'quieter') THEN 'quieter'
    WHEN list_contains(ids, 'fastest') THEN 'fastest' ELSE ids[1] END AS recommended FROM i LEFT JOIN f USING (request_id)""")
def recommend(t: Tables) -> DataFrame:
    preferences = t.customer.select(
        F.col("c_custkey").alias("request_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment") == "BUILDING").alias("prefer_quieter"),
        (F.col("c_nationkey") * 4).alias("heat_sensitivity"), F.when(F.col("c_nationkey") != 7, F.floor(F.col("c_acctbal") / 100).cast("int")).alias("comfort_balance"),
    )
    return candidates.recommendation(order_candidates(t), preferences)


@query(f"""WITH {AT_SQL}, r AS (SELECT a.c_custkey AS request_id, {metres_sql('a.lon', 'a.lat', 'b.lon', 'b.lat').replace('6371000.0', '6371.0')} AS km FROM c a JOIN c b ON b.c_custkey = a.c_custkey + 1)
  SELECT request_id, floor(km * 1000 + 0.5) / 1000 AS distance_km, floor(km * 1000 / 80 + 0.5) AS minutes FROM r""")
def straight_line(t: Tables) -> DataFrame:
    return candidates.straight_line(customer_trips(t)).select("request_id", "distance_km", "minutes")


@query("SELECT c_custkey, c_acctbal, c_name FROM customer ORDER BY c_acctbal NULLS LAST, c_custkey")
def resort_by_distance(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_acctbal", "c_name").orderBy(F.col("c_acctbal").asc_nulls_last(), "c_custkey")


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY 1, 2, 3")
def places_by_creation(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderdate", "o_orderkey").orderBy("o_custkey", "o_orderdate", "o_orderkey")
