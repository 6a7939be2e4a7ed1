"""Graph jobs over networks derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.functions.timestamps import epoch_micros
from hourspark.operators import graph, ordered, paths
from hourspark.plans import routing
from hourspark.queries import Tables, query, rounded
from hourspark.queries.spatial import metres_sql, spread, spread_sql, suppliers
from hourspark.session import cut

# Orders and customers share one id space: orders lie above this.
ORDER_BASE = 2_000_000_000
PLACE_AT = {"lon": (7919, 10007, 144.9, 0.2), "lat": (104729, 10009, -37.9, 0.15)}
PLACE_SQL = ", ".join(f"{spread_sql('id', *a)} AS {n}" for n, a in PLACE_AT.items())


def place(df: DataFrame) -> DataFrame:
    return df.withColumns({n: spread(F.col("id"), *a) for n, a in PLACE_AT.items()})


@query(f"""WITH e AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_partkey <> l_suppkey),
  n AS (SELECT id, {PLACE_SQL} FROM (SELECT p_partkey AS id FROM part))
  SELECT src, dst, round({metres_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 4) AS weight_m FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst""")
def edge_dedup(t: Tables) -> DataFrame:
    """Undirected part-supplier pairs on shared ids, without loops, weighted by their metres."""
    pairs = graph.undirected(t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))
    return rounded(graph.weigh(pairs, place(t.part.select(F.col("p_partkey").alias("id")))), "weight_m", digits=4)


def event_chain(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Events as nodes, each linked to the one before it of the same user."""
    part = ordered.slice_of(epoch_micros(F.col("ts")), ordered.DAY_MICROS)
    linked = ordered.neighbour(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], part, ["event_id"])
    links = linked.filter("prev is not null").select(F.col("prev.event_id").alias("src"), F.col("event_id").alias("dst"))
    return t.events.select(F.col("event_id").alias("id")), links


@query("SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id) AS component FROM events")
def components(t: Tables) -> DataFrame:
    return graph.components(*event_chain(t))


def customer_stars(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers and their orders; a customer without orders stays alone."""
    nodes = t.customer.select(F.col("c_custkey").alias("id")).unionByName(t.orders.select((F.col("o_orderkey") + ORDER_BASE).alias("id")))
    return nodes, t.orders.select((F.col("o_orderkey") + ORDER_BASE).alias("src"), F.col("o_custkey").alias("dst"))


@query("""WITH c AS (SELECT c_custkey AS component, 1 + (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS nodes FROM customer)
  SELECT max(nodes) AS largest, sum(nodes)::BIGINT AS total, round(max(nodes) / sum(nodes), 6) AS ratio FROM c""")
def component_ratio(t: Tables) -> DataFrame:
    return rounded(graph.largest_ratio(graph.components(*customer_stars(t))), "ratio")


@query(f"""WITH c AS (SELECT c_custkey AS component, 1 + count(o_orderkey) AS nodes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
  best AS (SELECT component FROM c ORDER BY nodes DESC, component LIMIT 1),
  kept AS (SELECT component AS old FROM best UNION ALL SELECT o_orderkey + {ORDER_BASE} FROM orders, best WHERE o_custkey = component),
  ids AS (SELECT old, row_number() OVER (ORDER BY old) - 1 AS id FROM kept)
  SELECT s.id AS src, d.id AS dst FROM orders JOIN ids s ON s.old = o_orderkey + {ORDER_BASE} JOIN ids d ON d.old = o_custkey""")
def largest_component_edges(t: Tables) -> DataFrame:
    nodes, edges = customer_stars(t)
    nodes = cut(nodes)
    return graph.largest_component(nodes, edges, graph.components(nodes, edges))[1]


@query(f"""WITH RECURSIVE seq AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  line AS (SELECT user_id, rn, row_number() OVER (ORDER BY user_id, rn) AS ordinal, 144.95::DOUBLE + (event_id * 7919 % 61) / 6200.0::DOUBLE AS lon, -37.82::DOUBLE + (event_id * 104729 % 59) / 7900.0::DOUBLE AS lat FROM seq),
  used AS (SELECT a.* FROM line a WHERE EXISTS (SELECT 1 FROM line b WHERE b.user_id = a.user_id AND abs(b.rn - a.rn) = 1)),
  v AS (SELECT lon, lat, row_number() OVER (ORDER BY min(ordinal)) AS i FROM used GROUP BY lon, lat),
  near AS (SELECT a.i, b.i AS j, {metres_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS d FROM v a JOIN v b ON b.i < a.i AND abs(b.lat - a.lat) < 0.0003 AND abs(b.lon - a.lon) < 0.0003 WHERE d < 20),
  lead(i, leads) USING KEY (i) AS (SELECT 1::BIGINT, TRUE UNION SELECT l.i + 1, NOT EXISTS (SELECT 1 FROM near JOIN recurring.lead r ON r.i = near.j WHERE near.i = l.i + 1 AND r.leads) FROM lead l WHERE l.i < (SELECT max(i) FROM v)),
  snap AS (SELECT v.i, coalesce((SELECT arg_min(j, (d, j)) FROM near JOIN lead r ON r.i = j AND r.leads WHERE near.i = v.i), v.i) AS leader FROM v),
  step AS (SELECT DISTINCT least(x.leader, y.leader) AS src, greatest(x.leader, y.leader) AS dst FROM used a JOIN used b ON b.user_id = a.user_id AND b.rn = a.rn + 1
    JOIN v p ON p.lon = a.lon AND p.lat = a.lat JOIN v q ON q.lon = b.lon AND q.lat = b.lat JOIN snap x ON x.i = p.i JOIN snap y ON y.i = q.i WHERE x.leader <> y.leader)
  SELECT count(*) AS edges, round(sum({metres_sql('s.lon', 's.lat', 't.lon', 't.lat')}), 2) AS metres, (SELECT count(*) FROM lead WHERE leads) AS nodes FROM step JOIN v s ON s.i = src JOIN v t ON t.i = dst""")
def street_graph(t: Tables) -> DataFrame:
    """Each user's events as one line on a coarse grid of points: snapped nodes and weighted edges."""
    part = ordered.slice_of(epoch_micros(F.col("ts")), ordered.DAY_MICROS)
    seq = ordered.numbered(t.events.select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], part)
    # Positions repeat and crowd: 61 x 59 spots, about 14 m apart, so that snapping has work to do.
    spot = lambda c, n, step: F.floor(F.pmod(F.col(c) * step, F.lit(n)))
    # A user's vertices follow those of all users before, however many there are.
    counts = seq.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    upto = ordered.running(counts, [], ["user_id"], F.floor(F.col("user_id") / F.lit(2**16)), {"upto": ("sum", F.col("n"))})
    line = seq.join(upto, "user_id").select(
        "user_id", (F.col("upto") - F.col("n") + F.col("rn")).alias("ordinal"), "rn",
        (144.95 + spot("event_id", 61, 7919) / 6200.0).alias("lon"), (-37.82 + spot("event_id", 59, 104729) / 7900.0).alias("lat"),
    )
    after = line.select("user_id", (F.col("rn") - 1).alias("rn"), *[F.col(c).alias(f"{c}_b") for c in ("ordinal", "lon", "lat")])
    segments = line.withColumnsRenamed({c: f"{c}_a" for c in ("ordinal", "lon", "lat")}).join(after, ["user_id", "rn"])
    nodes, edges = graph.build_graph(cut(segments))
    counted = edges.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight_m"), 2).alias("metres"))
    return counted.withColumn("nodes", nodes.agg(F.count(F.lit(1)).alias("n")).scalar())


# Trade network: nations linked by the lines shipped between them -----------------------------------


def trade(t: Tables) -> DataFrame:
    """Directed edges between customer nations and supplier nations with a weight and a shade in [0, 1]."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.supplier, F.col("l_suppkey") == F.col("s_suppkey")
    ).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    pairs = lines.groupBy(F.col("s_nationkey").cast("bigint").alias("src"), F.col("c_nationkey").cast("bigint").alias("dst")).agg(
        F.round(F.sum("l_quantity"), 0).alias("q"), F.round(F.avg("l_discount") * 10, 4).alias("shade")
    ).filter("src <> dst")
    # Rarely used links are short, so routes take several hops.
    return cut(pairs.select("src", "dst", (F.col("q") % 997 + 3).alias("weight_m"), "shade"))


TRADE_SQL = """e AS (SELECT src, dst, q % 997 + 3 AS w, shade FROM (SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, round(sum(l_quantity), 0) AS q, round(avg(l_discount) * 10, 4) AS shade
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE src <> dst)"""


def nation_requests(t: Tables) -> DataFrame:
    """Every pair of different nations, enumerated from the nation table by a sequence of its keys."""
    n = t.nation.select(F.col("n_nationkey").cast("bigint").alias("start_node"))
    top = t.nation.agg(F.max("n_nationkey").cast("bigint").alias("m")).scalar()
    return n.withColumn("end_node", F.explode(F.sequence(F.lit(0).cast("bigint"), top))).withColumn(
        "request_id", F.col("start_node") * 1000 + F.col("end_node")
    )


@query(f"""WITH RECURSIVE {TRADE_SQL}, sp(s, n, cost) USING KEY (s, n) AS (
    SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0::DOUBLE FROM nation
    UNION SELECT p.s, e.dst, min(p.cost + e.w * (1 + 1.4::DOUBLE * (1 - e.shade))) FROM sp p JOIN e ON e.src = p.n LEFT JOIN recurring.sp r ON r.s = p.s AND r.n = e.dst
      WHERE r.cost IS NULL OR p.cost + e.w * (1 + 1.4::DOUBLE * (1 - e.shade)) < r.cost GROUP BY 1, 2)
  SELECT a.n_nationkey::BIGINT AS start_node, b.n_nationkey::BIGINT AS end_node, round(cost, 6) AS cost FROM nation a CROSS JOIN nation b LEFT JOIN sp ON sp.s = a.n_nationkey AND sp.n = b.n_nationkey""")
def biased_paths(t: Tables) -> DataFrame:
    """Shade-biased cheapest routes between all pairs of nations."""
    requests = cut(nation_requests(t))
    ends = paths.arrivals(requests, paths.shortest_paths(requests, trade(t), shade_bias=1.4))
    return rounded(requests.join(ends, "request_id").select("start_node", "end_node", "cost"), "cost")


_COST = "p.cost + e.w * (1 + 1.4::DOUBLE * (1 - e.shade))"


@query(f"""WITH RECURSIVE {TRADE_SQL}, sp(s, n, cost, metres, lit, path) USING KEY (s, n) AS (
    SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, n_nationkey::VARCHAR FROM nation
    UNION SELECT p.s, e.dst, min({_COST}), arg_min(p.metres + e.w, {_COST}), arg_min(p.lit + e.w * e.shade, {_COST}), arg_min(p.path || '-' || e.dst, {_COST})
      FROM sp p JOIN e ON e.src = p.n LEFT JOIN recurring.sp r ON r.s = p.s AND r.n = e.dst WHERE r.cost IS NULL OR {_COST} < r.cost GROUP BY 1, 2)
  SELECT s * 1000 + n AS request_id, path, round(cost, 6) AS cost, round(metres, 6) AS metres, round(lit / nullif(metres, 0), 6) AS shade_avg FROM sp""")
def route_paths(t: Tables) -> DataFrame:
    """The node sequences of the same routes with their length and mean shade."""
    requests, edges = cut(nation_requests(t)), trade(t)
    found = paths.shortest_paths(requests, edges, shade_bias=1.4)
    steps = cut(paths.path_steps(requests, found))
    nodes = steps.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "node"))), lambda x: x["node"].cast("string")), "-").alias("path"))
    shade = graph.path_shade(steps, edges)
    return rounded(nodes.join(paths.arrivals(requests, found), "request_id").join(shade, "request_id", "left"), "cost", "metres", "shade_avg")


@query()
def planned_routes(t: Tables) -> DataFrame:
    """Route candidates over the trade network, for a trip from each supplier to its best customers' nation."""
    nodes = cut(place(t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"))))
    sold = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "l_suppkey", "c_nationkey"
    ).agg(F.sum("l_quantity").alias("q")).groupBy("l_suppkey").agg(F.max_by("c_nationkey", F.struct("q", "c_nationkey")).alias("best"))
    ends = t.supplier.join(sold, F.col("s_suppkey") == F.col("l_suppkey"))
    # A trip starts up to 200 m beside its nation's place.
    beside = F.pmod("s_suppkey", F.lit(7)) * 0.0003
    at = lambda key, side: nodes.select(F.col("id").alias(key), F.col("lon").alias(f"{side}_lon"), F.col("lat").alias(f"{side}_lat"))
    trips = ends.join(at("s_nationkey", "from"), "s_nationkey").join(at("best", "to"), "best").select(
        F.col("s_suppkey").alias("request_id"), (F.col("from_lon") + beside).alias("from_lon"), "from_lat", "to_lon", "to_lat",
        F.pmod("s_acctbal", F.lit(40.0)).alias("temperature_c"),
    )
    flows = t.supplier.select(F.col("s_suppkey").alias("site_id"), F.greatest("s_acctbal", F.lit(0.0)).alias("flow"))
    found, _ = routing.plan_routes(cut(trips), nodes, trade(t), suppliers(t), flows)
    return rounded(found.withColumns({"tags": F.array_join("tags", ";"), "warnings": F.array_join("warnings", ";")}), "distance_km", "minutes", "shade", "crowd")


# Roads of thousands of hops ------------------------------------------------------------------------


def order_ring(t: Tables) -> DataFrame:
    """Directed edges both ways along all orders, from the last back to the first, and a dead end at every seventh."""
    o = t.orders.select("o_orderkey", (F.pmod("o_custkey", F.lit(97)) + 3).cast("double").alias("weight_m"), (F.pmod("o_orderkey", F.lit(10)) / 10.0).alias("shade"))
    linked = ordered.neighbour(o, [], ["o_orderkey"], F.floor(F.col("o_orderkey") / F.lit(2**16)), ["o_orderkey", "weight_m", "shade"])
    road = linked.filter("prev IS NOT NULL").select(F.col("prev.o_orderkey").alias("src"), F.col("o_orderkey").alias("dst"), "prev.weight_m", "prev.shade")
    whole = o.agg(F.max("o_orderkey").alias("src"), F.min("o_orderkey").alias("dst")).select("src", "dst", F.lit(5.0).alias("weight_m"), F.lit(0.0).alias("shade"))
    spurs = o.filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("src"), (-F.col("o_orderkey")).alias("dst"), "weight_m", "shade")
    return cut(graph.mirrored(road.unionByName(whole).unionByName(spurs)))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, o_custkey % 97 + 3 AS w, (o_orderkey % 10) / 10.0::DOUBLE AS shade, n_regionkey::BIGINT AS request_id
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
  p AS (SELECT *, w * (1 + 1.4::DOUBLE * (1 - shade)) AS c, row_number() OVER (ORDER BY o_orderkey) AS k FROM o),
  q AS (SELECT *, sum(c) OVER (ORDER BY k) - c AS pos, sum(w) OVER (ORDER BY k) - w AS m FROM p),
  ring AS (SELECT max(pos) + 5 * 2.4::DOUBLE AS cost, max(m) + 5 AS metres, max(k) AS hops FROM q),
  e AS (SELECT request_id, arg_min((pos, m, k), o_orderkey) AS a, arg_max((pos, m, k), (o_totalprice, o_orderkey)) AS b FROM q GROUP BY 1),
  d AS (SELECT request_id, abs(a[1] - b[1]) AS cost, abs(a[2] - b[2]) AS metres, abs(a[3] - b[3]) AS hops FROM e)
  SELECT request_id, round(least(d.cost, ring.cost - d.cost), 4) AS cost, CASE WHEN d.cost <= ring.cost - d.cost THEN d.metres ELSE ring.metres - d.metres END::DOUBLE AS metres,
    CASE WHEN d.cost <= ring.cost - d.cost THEN d.hops ELSE ring.hops - d.hops END::BIGINT AS hops FROM d, ring""")
def long_routes(t: Tables) -> DataFrame:
    """Shade-biased routes along the ring of all orders, a trip per region: thousands of hops and few junctions."""
    placed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    trips = placed.groupBy(F.col("n_regionkey").cast("bigint").alias("request_id")).agg(
        F.min("o_orderkey").alias("start_node"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("end_node")
    )
    trips = cut(trips)
    found = paths.shortest_paths(trips, order_ring(t), shade_bias=1.4)
    steps = paths.path_steps(trips, found).groupBy("request_id").agg(F.max("seq").alias("hops"))
    return rounded(paths.arrivals(trips, found).join(steps, "request_id"), "cost", digits=4)
