"""Text, number and label expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.functions import geo, labels, numbers, text
from hourspark.functions.timestamps import floor_hour
from hourspark.queries import Tables, query, rounded
from hourspark.sources.feeds import series_long


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN json_extract_string(props, '$.k')::BIGINT > 0 THEN json_extract_string(props, '$.k')::DOUBLE END AS k_positive FROM events""")
def json_props(t: Tables) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return t.events.select("event_id", k.alias("k"), F.when(k > 0, k.cast("double")).alias("k_positive"))


@query("""WITH d AS (SELECT DISTINCT date_trunc('hour', ts) AS stamp, event_type, sum(value) OVER (PARTITION BY event_type, date_trunc('hour', ts)) AS v FROM events)
  SELECT event_type AS parameter, stamp, CASE WHEN v > 300.005 THEN NULL ELSE round(v, 4) END AS value FROM d""")
def json_hourly_series(t: Tables) -> DataFrame:
    """Hourly sums packed as provider payloads (one map of stamps per parameter), then read back."""
    hourly = t.events.groupBy("event_type", floor_hour(F.col("ts")).alias("h")).agg(F.sum("value").alias("v"))
    stamped = hourly.select("event_type", F.regexp_replace(F.substring(F.col("h").cast("string"), 1, 13), "[- ]", "").alias("k"), F.to_date("h").alias("d"),
                            F.when(F.col("v") > 300.005, F.lit(-999.0)).otherwise(F.round("v", 4)).cast("string").alias("v"))
    # One payload per parameter and day, as the provider answers one request per interval.
    payloads = stamped.groupBy("event_type", "d").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")).select(F.to_json(F.struct(
        F.struct(F.lit(-999.0).alias("fill_value")).alias("header"), F.struct(F.create_map("event_type", "m").alias("parameter")).alias("properties"),
    )).alias("payload"))
    return series_long(payloads).select("parameter", "stamp", "value")


@query("""SELECT l_orderkey, l_linenumber, regexp_replace(l_quantity::VARCHAR, '^([+-]?\\d+)\\.0+$', '\\1') AS quantity_id, count(*) AS copies FROM lineitem GROUP BY 1, 2, 3""")
def canonical_ids(t: Tables) -> DataFrame:
    shown = F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" "))
    return t.lineitem.groupBy("l_orderkey", "l_linenumber", text.canonical_id(shown).alias("quantity_id")).agg(F.count(F.lit(1)).alias("copies"))


@query("""SELECT o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN FALSE END AS flag, o_orderstatus IN ('O', 'P') AS fault, count(*) AS rows FROM orders GROUP BY 1, 2""")
def bool_text(t: Tables) -> DataFrame:
    value = F.concat(F.lit(" "), F.col("o_orderstatus"))
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("rows")).select(
        "o_orderstatus", "o_orderpriority", text.bool_text(value).alias("flag"), text.bool_text_fault(value).alias("fault"), "rows",
    )


@query("""SELECT c_custkey, c_acctbal AS number, FALSE AS fault, c_acctbal <> floor(c_acctbal) AS integer_fault, TRUE AS name_fault FROM customer""")
def strict_numbers(t: Tables) -> DataFrame:
    value = F.col("c_acctbal").cast("string")
    return t.customer.select(
        "c_custkey", numbers.strict_number(value).alias("number"), numbers.strict_number_fault(value).alias("fault"),
        numbers.strict_number_fault(value, integer=True).alias("integer_fault"), numbers.strict_number_fault(F.col("c_name")).alias("name_fault"),
    )


@query("""SELECT o_orderkey, o_custkey || ':' || strftime(o_orderdate, '%Y%m%d') || ':' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') AS hour_key,
  'v1:' || length(o_orderpriority) || ':' || o_orderpriority || ':' || length(o_custkey::VARCHAR) || ':' || o_custkey || ':' || epoch_us(o_orderdate) AS observation_key FROM orders""")
def observation_keys(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", text.hour_key(F.col("o_custkey"), F.to_date("o_orderdate"), F.pmod("o_orderkey", F.lit(24))).alias("hour_key"),
        text.prefixed_key(F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderdate")).alias("observation_key"),
    )


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS observation_key FROM orders")
def key_fallback(t: Tables) -> DataFrame:
    """An existing complete and unique key is kept."""
    keyed = t.orders.withColumn("observation_key", F.col("o_orderkey"))
    return text.with_observation_key(keyed, "o_orderpriority", "o_custkey", "o_orderdate").select("o_orderkey", "observation_key")


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity)::DOUBLE AS quantity,
  concat_ws(';', CASE WHEN l_returnflag = 'A' THEN 'alarm' END, CASE WHEN l_linenumber > 5 THEN 'coordinate_missing' END, CASE WHEN l_linestatus = 'O' THEN 'partial' END) AS quality_flag
  FROM lineitem GROUP BY ALL""")
def quality_flags(t: Tables) -> DataFrame:
    flags = text.flag_string({
        "partial": F.col("l_linestatus") == "O", "alarm": F.col("l_returnflag") == "A", "coordinate_missing": F.col("l_linenumber") > 5,
    })
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.sum("l_quantity").alias("quantity")).withColumn("quality_flag", flags)


@query("""SELECT user_id, count(*) AS rows, to_json({'from_raw': list_sort(list(DISTINCT event_type)), 'hours': list_sort(list(DISTINCT hour(ts)))})::VARCHAR AS lineage FROM events GROUP BY 1""")
def lineage_json(t: Tables) -> DataFrame:
    sets = lambda c: F.array_sort(F.collect_set(c))
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), sets("event_type").alias("from_raw"), sets(F.hour("ts")).alias("hours")).select(
        "user_id", "rows", F.to_json(F.struct("from_raw", "hours")).alias("lineage"),
    )


@query("""SELECT c_custkey, 'int:' || c_custkey AS key_token, 'str:' || c_mktsegment AS segment_token, 'bool:' || CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'False' END AS owes_token,
  CASE WHEN c_acctbal < 0 THEN '<MISSING>' ELSE 'int:' || c_nationkey END AS nation_token, lower(c_mktsegment) || '|' || 'customer#' || lpad(c_custkey::VARCHAR, 9, '0') AS group_id FROM customer""")
def typed_tokens(t: Tables) -> DataFrame:
    df = t.customer.withColumn("owes", F.col("c_acctbal") < 0).withColumn("nation", F.when(~F.col("owes"), F.col("c_nationkey")))
    token = lambda c: text.typed_token(df, c)
    return df.select(
        "c_custkey", token("c_custkey").alias("key_token"), token("c_mktsegment").alias("segment_token"), token("owes").alias("owes_token"),
        token("nation").alias("nation_token"), text.group_id(F.concat(F.lit(" "), F.col("c_mktsegment")), F.col("c_name")).alias("group_id"),
    )


@query("""SELECT event_id,
  CASE WHEN value < 10 THEN 'Feels cold' WHEN value < 17 THEN 'Feels cool' WHEN value < 23 THEN 'Feels mild' WHEN value < 28 THEN 'Feels warm' ELSE 'Feels hot' END AS feels,
  CASE WHEN value / 10 < 3 THEN 'Low UV' WHEN value / 10 < 6 THEN 'Moderate UV' WHEN value / 10 < 8 THEN 'High UV' WHEN value / 10 < 11 THEN 'Very high UV' ELSE 'Extreme UV' END AS uv,
  CASE WHEN value <= 50 THEN 'Good air quality' WHEN value <= 100 THEN 'Moderate air quality' WHEN value <= 150 THEN 'Unhealthy for sensitive groups'
    WHEN value <= 200 THEN 'Unhealthy air quality' WHEN value <= 300 THEN 'Very unhealthy air quality' ELSE 'Hazardous air quality' END AS air,
  value >= 28 AS advisory, value >= 33 AS extreme, CASE WHEN value >= 33 THEN 2.2 WHEN value >= 28 THEN 1.6 ELSE 1.0 END::DOUBLE AS shade_multiplier FROM events""")
def band_labels(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select(
        "event_id", labels.temperature_label(v).alias("feels"), labels.uv_label(v / 10).alias("uv"), labels.air_label(v).alias("air"), labels.heat_context(v).alias("h"),
    ).select("event_id", "feels", "uv", "air", "h.*")


@query("""WITH m AS (SELECT user_id, avg(value) AS typical FROM events GROUP BY 1)
  SELECT event_id, CASE WHEN value / typical >= 1.3 THEN 'Busier than usual' WHEN value / typical <= 0.7 THEN 'Quieter than usual' ELSE 'Typical crowds' END AS crowd FROM events JOIN m USING (user_id)""")
def crowd_labels(t: Tables) -> DataFrame:
    typical = t.events.groupBy("user_id").agg(F.avg("value").alias("typical"))
    return t.events.join(typical, "user_id").select("event_id", labels.crowd_label(F.col("value"), F.col("typical")).alias("crowd"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'car|taxi|van|truck|bus|motor|vehicle|ute|rigid|fire_engine') THEN 'vehicle'
  WHEN regexp_matches(lower(p_name), 'cycl|bicycle|bike|escooter') THEN 'cyclist' WHEN regexp_matches(lower(p_name), 'pedestrian|person|walker') THEN 'pedestrian' ELSE 'other' END AS mode,
  CASE WHEN lower(trim(p_type)) IN ('car', 'taxi', 'van', 'bus', 'minibus', 'motorbike', 'rigid', 'truck', 'emergency_car', 'emergency_van', 'fire_engine') THEN TRUE
  WHEN lower(trim(p_type)) IN ('cyclist', 'pedestrian', 'escooter') THEN FALSE END AS motor FROM part""")
def class_modes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", labels.mode_of(F.col("p_name")).alias("mode"), labels.is_motor(F.col("p_type")).alias("motor"))


@query("""SELECT o_orderkey, floor(o_totalprice / 1000 * 0.19 * 100 + 0.5) / 100 AS emissions_kg, floor(o_totalprice / 80 + 0.5) AS minutes,
  round(ln(1 + floor(o_totalprice)), 6) AS log1p_target FROM orders""")
def emissions_and_minutes(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return rounded(t.orders.select(
        "o_orderkey", labels.emissions_kg(price / 1000).alias("emissions_kg"), numbers.half_up(labels.walk_minutes(price)).alias("minutes"),
        F.log1p(F.floor(price)).alias("log1p_target"),
    ), "log1p_target")


@query("""WITH f(unit, per) AS (VALUES ('plastic_bottle', 0.08::DOUBLE), ('tree_day', 0.0575::DOUBLE), ('streaming_hour', 0.036::DOUBLE), ('phone_charge', 0.0084::DOUBLE), ('bulb_hour', 0.004::DOUBLE))
  SELECT event_id, unit, floor(value / 1000 / per + 0.5)::BIGINT AS units FROM events, f WHERE value > 0 AND floor(value / 1000 / per + 0.5) >= 1""")
def emissions_equivalents(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(labels.co2_comparisons(F.col("value") / 1000)).alias("c")).select("event_id", "c.unit", "c.units")


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND p_size < 25 THEN 'food' WHEN p_type = 'ECONOMY' THEN 'landmark' WHEN p_type = 'SMALL' THEN 'park'
  WHEN p_type = 'STANDARD' THEN 'shop' WHEN p_size > 40 THEN 'address' ELSE 'place' END AS category,
  CASE WHEN p_size > 40 THEN p_size || ', ' || p_brand WHEN p_name = '' THEN 'Melbourne, Victoria' ELSE p_brand END AS address FROM part""")
def place_categories(t: Tables) -> DataFrame:
    key = F.when(F.col("p_type") == "ECONOMY", "amenity").when(F.col("p_type") == "SMALL", "leisure").when(F.col("p_type") == "STANDARD", "shop")
    value = F.when(F.col("p_size") < 25, "cafe").otherwise("bank")
    number = F.when(F.col("p_size") > 40, F.col("p_size").cast("string"))
    return t.part.select(
        "p_partkey", labels.place_category(key, value, number, F.lit(None).cast("string")).alias("category"),
        text.join_distinct([number, F.col("p_brand"), F.col("p_brand"), F.lit("")], default="Melbourne, Victoria").alias("address"),
    )


@query("""SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'scats-intersection' WHEN user_id % 4 = 1 THEN 'transport-activity-countline' WHEN user_id % 4 = 2 THEN 'transport-activity-countline' END AS variant,
  user_id % 4 <> 3 AS known FROM events""")
def variant_routing(t: Tables) -> DataFrame:
    group = F.element_at(F.array(*[F.lit(g) for g in ("scats", "transport_activity", "countline", "tram")]), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    variant = labels.variant_of(group)
    return t.events.select("event_id", variant.alias("variant"), variant.isNotNull().alias("known"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END, 'x' || c_custkey) AS display_name FROM customer""")
def display_names(t: Tables) -> DataFrame:
    third = F.pmod("c_custkey", F.lit(3))
    raw = F.to_json(F.struct(
        F.when(third == 0, F.col("c_name")).alias("display_name"), F.when(third == 1, F.col("c_mktsegment")).alias("full_name"),
        F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("name"),
    ))
    return t.customer.select("c_custkey", text.display_name(raw).alias("display_name"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.05 THEN NULL ELSE l_extendedprice END AS reading, CASE WHEN l_quantity < 10 THEN NULL ELSE l_quantity END AS slot, count(*) AS copies
  FROM lineitem GROUP BY ALL""")
def sentinels(t: Tables) -> DataFrame:
    raw = F.when(F.col("l_discount") > 0.05, F.lit(-999.0)).otherwise(F.col("l_extendedprice")).cast("string")
    slot = F.when(F.col("l_quantity") < 10, F.lit(-1.0)).otherwise(F.col("l_quantity"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", numbers.sentinel_to_null(raw, -999.0).alias("reading"), numbers.negative_to_null(slot).alias("slot"),
    ).groupBy("l_orderkey", "l_linenumber", "l_partkey", "reading", "slot").agg(F.count(F.lit(1)).alias("copies"))


@query("""WITH p AS (SELECT c_custkey, -37.0 - (c_custkey % 997) / 997.0::DOUBLE AS lat, 144.0 + (c_custkey % 991) / 991.0::DOUBLE AS lon FROM customer)
  SELECT c_custkey, round(lat, 6) AS lat, round(lon, 6) AS lon, TRUE AS valid, printf('coord:%.4f:%.4f', round(lat, 4), round(lon, 4)) AS site,
  round(lat, 6) BETWEEN -37.86 AND -37.0 AND round(lon, 6) BETWEEN 144.1 AND 144.9 AS inside FROM p""")
def coordinates(t: Tables) -> DataFrame:
    lat = -37.0 - F.pmod("c_custkey", F.lit(997)) / F.lit(997.0)
    lon = 144.0 + F.pmod("c_custkey", F.lit(991)) / F.lit(991.0)
    shown = F.concat(F.round(lat, 6).cast("string"), F.lit(", "), F.round(lon, 6).cast("string"))
    read = t.customer.select("c_custkey", text.text_point(shown).alias("p"), lat.alias("_lat"), lon.alias("_lon"))
    lat4, lon4 = F.round("_lat", 4), F.round("_lon", 4)
    site = F.regexp_replace(geo.site_id(lat4, lon4), r"(\.\d{4})000", "$1")
    return read.select(
        "c_custkey", "p.lat", "p.lon", geo.valid_coordinate(F.col("p.lat"), F.col("p.lon")).alias("valid"), site.alias("site"),
        geo.in_box(F.col("p.lat"), F.col("p.lon"), (144.1, -37.86, 144.9, -37.0)).alias("inside"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_tax < 0.04 AND l_linenumber + 2 = l_linenumber + l_quantity AS valid, count(*) AS copies FROM lineitem GROUP BY ALL""")
def direction_checks(t: Tables) -> DataFrame:
    from hourspark.plans.crowd import directions_valid

    first = F.when(F.col("l_tax") < 0.04, F.col("l_linenumber").cast("bigint"))
    ok = directions_valid(first, F.lit(2).cast("bigint"), F.col("l_linenumber") + F.col("l_quantity").cast("bigint"))
    return t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_suppkey", ok.alias("valid")).agg(F.count(F.lit(1)).alias("copies"))


@query("SELECT event_id, (value / 3)::FLOAT::DOUBLE AS value, (event_type = 'error')::TINYINT AS is_error FROM events")
def downcast_features(t: Tables) -> DataFrame:
    wide = t.events.select("event_id", (F.col("value") / 3).alias("value"), (F.col("event_type") == "error").alias("is_error"))
    return numbers.downcast(wide, ["value"], ["is_error"]).withColumn("value", F.col("value").cast("double"))
