"""Nearest sites, rasters and corridor penalties over pseudo-coordinates computed from keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.operators import space, spatial
from hourspark.queries import Tables, query, rounded

BOX = (144.90, -37.90, 145.10, -37.75)
GRID = spatial.grid_of(BOX, 400.0)


def spread(key: Column, step: int, modulus: int, start: float, width: float) -> Column:
    """A coordinate spread over [start, start + width) by a key."""
    return F.lit(start) + F.pmod(key * step, F.lit(modulus)) / F.lit(float(modulus)) * F.lit(width)


def spread_sql(key: str, step: int, modulus: int, start: float, width: float) -> str:
    return f"({start}::DOUBLE + ({key} * {step} % {modulus}) / {float(modulus)}::DOUBLE * {width}::DOUBLE)"


CUSTOMER_AT = {"lon": (7919, 10007, 144.9, 0.2), "lat": (104729, 10009, -37.9, 0.15)}
SUPPLIER_AT = {"lon": (6151, 9973, 144.9, 0.2), "lat": (15485863, 9967, -37.9, 0.15)}


def customers(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", *[spread(F.col("c_custkey"), *a).alias(n) for n, a in CUSTOMER_AT.items()])


def suppliers(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("site_id"), *[spread(F.col("s_suppkey"), *a).alias(n) for n, a in SUPPLIER_AT.items()])


def metres_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"(2 * 6371000.0::DOUBLE * asin(sqrt(sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) ** 2)))"
    )


AT_SQL = f"""c AS (SELECT c_custkey, {', '.join(f'{spread_sql("c_custkey", *a)} AS {n}' for n, a in CUSTOMER_AT.items())} FROM customer),
  s AS (SELECT s_suppkey AS site_id, {', '.join(f'{spread_sql("s_suppkey", *a)} AS {n}' for n, a in SUPPLIER_AT.items())} FROM supplier),
  d AS (SELECT c_custkey, site_id, {metres_sql('c.lon', 'c.lat', 's.lon', 's.lat')} AS m FROM c, s)"""


@query(f"""WITH {AT_SQL} SELECT c_custkey, site_id, round(m, 4) AS distance_m,
  CASE WHEN m / 1000 > 0.5 THEN 'nearest_sensor_distance_km_' || round(m / 1000, 2) || '_exceeds_proxy_radius' END AS warning FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY m, site_id) = 1""")
def nearest_site(t: Tables) -> DataFrame:
    met = space.nearest(customers(t), suppliers(t), "site_id")
    return rounded(met.select("c_custkey", "site_id", "distance_m", spatial.far_site_warning(F.col("distance_m")).alias("warning")), "distance_m", digits=4)


@query(f"""WITH {AT_SQL}, n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY m, site_id) = 1)
  SELECT c_custkey, CASE WHEN m <= 400 THEN site_id END AS site_id, round(CASE WHEN m <= 400 THEN m END, 4) AS distance_m FROM n""")
def grid_snap(t: Tables) -> DataFrame:
    met = space.nearest(customers(t), suppliers(t), "site_id", radius_m=400.0)
    return rounded(met.select("c_custkey", "site_id", "distance_m"), "distance_m", digits=4)


@query(f"WITH {AT_SQL} SELECT c_custkey, site_id, round(m, 4) AS distance_m FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY m, site_id) = 1")
def nearest_site_by_grid(t: Tables) -> DataFrame:
    """The same search with coarser cubes."""
    met = space.nearest(customers(t), suppliers(t), "site_id", edge_m=600.0)
    return rounded(met.select("c_custkey", "site_id", "distance_m"), "distance_m", digits=4)


POINTS_AT = {"lon": (48611, 100003, 144.88, 0.24), "lat": (611953, 99991, -37.92, 0.19)}


def order_points(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", "o_custkey", *[spread(F.col("o_custkey") * 97 + F.pmod("o_orderkey", F.lit(89)) * F.pmod("o_orderkey", F.lit(13)), *a).alias(n) for n, a in POINTS_AT.items()]
    )


POINT_KEY = "(o_custkey * 97 + (o_orderkey % 89) * (o_orderkey % 13))"
DENSITY_SQL = f"""p AS (SELECT o_orderkey, o_custkey, {', '.join(f'{spread_sql(POINT_KEY, *a)} AS {n}' for n, a in POINTS_AT.items())} FROM orders),
  g AS (SELECT *, trunc((lat - {GRID['min_lat']!r}::DOUBLE) / {GRID['cell_deg_lat']!r}::DOUBLE)::INTEGER AS r, trunc((lon - {GRID['min_lon']!r}::DOUBLE) / {GRID['cell_deg_lon']!r}::DOUBLE)::INTEGER AS c FROM p),
  cells AS (SELECT least(r, {GRID['rows'] - 1}) AS row, least(c, {GRID['cols'] - 1}) AS col, count(*) AS points FROM g
    WHERE lon BETWEEN {GRID['min_lon']!r} AND {GRID['max_lon']!r} AND lat BETWEEN {GRID['min_lat']!r} AND {GRID['max_lat']!r} GROUP BY 1, 2),
  norm AS (SELECT points AS p95 FROM (SELECT points, row_number() OVER (ORDER BY points) AS rn, count(*) OVER () AS n FROM cells) WHERE rn = least(n, floor(0.95::DOUBLE * n) + 1)),
  density AS (SELECT row, col, points, printf('%.4f', least(1.0::DOUBLE, points / greatest(1, p95)))::DOUBLE AS density FROM cells, norm)"""


@query(f"WITH {DENSITY_SQL} SELECT row, col, points, round(density, 4) AS density FROM density")
def cell_density(t: Tables) -> DataFrame:
    return rounded(spatial.density(order_points(t), GRID), "density", digits=4)


@query(f"""WITH {DENSITY_SQL} SELECT o_orderkey, CASE WHEN r BETWEEN 0 AND {GRID['rows'] - 1} AND c BETWEEN 0 AND {GRID['cols'] - 1} THEN round(coalesce(density, 0), 4) END AS density
  FROM g LEFT JOIN density d ON d.row = g.r AND d.col = g.c""")
def point_density(t: Tables) -> DataFrame:
    points = order_points(t)
    found = spatial.point_density(points, spatial.density(points, GRID), GRID)
    return rounded(found.select("o_orderkey", "density"), "density", digits=4)


@query(f"""WITH {DENSITY_SQL}, nodes AS (SELECT o_orderkey AS id, coalesce(CASE WHEN r BETWEEN 0 AND {GRID['rows'] - 1} AND c BETWEEN 0 AND {GRID['cols'] - 1} THEN density END, 0) AS density
    FROM g LEFT JOIN density d ON d.row = g.r AND d.col = g.c)
  SELECT src, dst, printf('%.4f', (x.density + y.density) / 2)::DOUBLE AS shade FROM (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst""")
def edge_shade(t: Tables) -> DataFrame:
    points = order_points(t)
    nodes = spatial.point_density(points, spatial.density(points, GRID), GRID, outside=0.0).withColumnRenamed("o_orderkey", "id")
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return spatial.edge_shade(edges, nodes)


PAD = spatial.CORRIDOR_PAD_M / 111320.0


@query(f"""WITH {AT_SQL}, r AS (SELECT a.c_custkey AS request_id, a.lat AS la, a.lon AS lo, b.lat AS lb, b.lon AS lp FROM c a JOIN c b ON b.c_custkey = a.c_custkey + 1),
  m AS (SELECT *, least(la, lb) AS s0, greatest(la, lb) AS n0, least(lo, lp) AS w0, greatest(lo, lp) AS e0, (least(la, lb) + greatest(la, lb)) / 2 AS mid FROM r),
  k AS (SELECT *, {PAD!r}::DOUBLE / greatest(0.2::DOUBLE, cos(radians(mid))) AS pad FROM m),
  x AS (SELECT request_id, site_id, {metres_sql('(w0 - pad + e0 + pad) / 2', 'mid', 's.lon', 's.lat')} AS md FROM k JOIN s ON s.lat BETWEEN s0 - {PAD!r}::DOUBLE AND n0 + {PAD!r}::DOUBLE AND s.lon BETWEEN w0 - pad AND e0 + pad)
  SELECT request_id, site_id, row_number() OVER (PARTITION BY request_id ORDER BY md, site_id)::INTEGER AS rank FROM x QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY md, site_id) <= 12""")
def corridor_sites(t: Tables) -> DataFrame:
    return spatial.corridor_sites(customer_trips(t), suppliers(t), "site_id").select("request_id", "site_id", "rank")


def customer_trips(t: Tables) -> DataFrame:
    """Each customer walks to the next one."""
    at = customers(t)
    start = at.select(F.col("c_custkey").alias("request_id"), F.col("lon").alias("from_lon"), F.col("lat").alias("from_lat"))
    end = at.select((F.col("c_custkey") - 1).alias("request_id"), F.col("lon").alias("to_lon"), F.col("lat").alias("to_lat"))
    return start.join(end, "request_id")


@query(f"""WITH {AT_SQL}, r AS (SELECT a.c_custkey AS request_id, a.lat AS la, a.lon AS lo, b.lat AS lb, b.lon AS lp FROM c a JOIN c b ON b.c_custkey = a.c_custkey + 1),
  m AS (SELECT *, least(la, lb) AS s0, greatest(la, lb) AS n0, least(lo, lp) AS w0, greatest(lo, lp) AS e0, (least(la, lb) + greatest(la, lb)) / 2 AS mid FROM r),
  k AS (SELECT *, {PAD!r}::DOUBLE / greatest(0.2::DOUBLE, cos(radians(mid))) AS pad FROM m),
  b AS (SELECT request_id, s0 - {PAD!r}::DOUBLE AS south, n0 + {PAD!r}::DOUBLE AS north, w0 - pad AS west, e0 + pad AS east, mid, (w0 - pad + e0 + pad) / 2 AS mid_lon FROM k),
  x AS (SELECT b.*, site_id, s.lon AS slon, s.lat AS slat, row_number() OVER (PARTITION BY request_id ORDER BY {metres_sql('mid_lon', 'mid', 's.lon', 's.lat')}, site_id) AS rank
    FROM b JOIN s ON s.lat BETWEEN south AND north AND s.lon BETWEEN west AND east QUALIFY rank <= 12),
  near AS (SELECT c_custkey AS node, site_id, m FROM d WHERE m <= 180),
  y AS (SELECT request_id, node, x.site_id, m, rank FROM x JOIN near USING (site_id) JOIN c ON c.c_custkey = node AND c.lat BETWEEN south AND north AND c.lon BETWEEN west AND east)
  SELECT request_id, node, round(s_acctbal, 4) AS penalty FROM y JOIN supplier ON s_suppkey = site_id QUALIFY row_number() OVER (PARTITION BY request_id, node ORDER BY m, rank DESC) = 1""")
def node_penalties(t: Tables) -> DataFrame:
    nodes = customers(t).withColumnRenamed("c_custkey", "id")
    flows = t.supplier.select(F.col("s_suppkey").alias("site_id"), F.col("s_acctbal").alias("flow"))
    return rounded(spatial.node_penalties(customer_trips(t), nodes, suppliers(t), flows), "penalty", digits=4)


@query("SELECT c_custkey, c_acctbal >= 0 AS is_saved FROM customer")
def saved_place_matches(t: Tables) -> DataFrame:
    from hourspark.operators.activity import saved_matches

    # Customers in credit have saved their own place, at four decimals.
    here = customers(t).withColumn("user_id", F.col("c_custkey"))
    creditors = here.join(t.customer.filter("c_acctbal >= 0").select("c_custkey"), "c_custkey", "left_semi")
    places = creditors.withColumns({"lat": F.round("lat", 4), "lon": F.round("lon", 4)})
    return saved_matches(here, places).select("c_custkey", "is_saved")
