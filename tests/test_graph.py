import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from hourspark.operators import graph, paths, space, spatial
from hourspark.plans import routing
from hourspark.session import cut


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


SQUARE = [(144.96, -37.81), (144.961, -37.81), (144.961, -37.811), (144.96, -37.811), (144.97, -37.82)]


@pytest.fixture(scope="module")
def square(spark):
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(SQUARE)], "id long, lon double, lat double")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 0.0), (0, 3, 0.0)], "src long, dst long, shade double")
    return nodes, graph.mirrored(graph.weigh(edges, nodes)).cache()


def test_paths_on_the_square(spark, square):
    nodes, edges = square
    asked = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (3, 2, 2), (4, 0, 4)], "request_id long, start_node long, end_node long")
    state = paths.shortest_paths(asked, edges)
    got = {r.request_id: r.metres for r in paths.arrivals(asked, state).collect()}
    assert got[1] == pytest.approx(metres(SQUARE[0], SQUARE[1])) and got[3] == 0.0 and got[4] is None
    # Both ways round are equal to about a millimetre.
    assert got[2] == pytest.approx(metres(SQUARE[0], SQUARE[1]) + metres(SQUARE[1], SQUARE[2]), abs=0.01)
    steps = paths.path_steps(asked, state)
    assert [r.node for r in steps.filter("request_id = 1").orderBy("seq").collect()] == [0, 1]
    assert [r.node for r in steps.filter("request_id = 3").collect()] == [2]
    shaded = paths.shortest_paths(asked, edges, shade_bias=1.4)
    assert [r.node for r in paths.path_steps(asked, shaded).filter("request_id = 2").orderBy("seq").collect()] == [0, 1, 2]
    assert graph.path_shade(paths.path_steps(asked, shaded), edges).filter("request_id = 2").first().shade_avg == pytest.approx(1.0)


def dijkstra(adj, start, bias, penalty, weight):
    cost, queue = {start: 0.0}, [(0.0, start)]
    while queue:
        c, n = heapq.heappop(queue)
        if c > cost[n]:
            continue
        for m, w, s in adj.get(n, ()):
            new = c + w * (1 + bias * (1 - s)) + weight * penalty.get(m, 0.0)
            if new < cost.get(m, math.inf):
                cost[m] = new
                heapq.heappush(queue, (new, m))
    return cost


def test_paths_equal_a_priority_queue_search(spark):
    random.seed(11)
    n, adj, data = 40, {}, []
    for _ in range(110):
        a, b, w, s = random.randrange(n), random.randrange(n), random.uniform(1, 100), random.random()
        if a != b:
            data.append((a, b, w, s))
            adj.setdefault(a, []).append((b, w, s))
    penalty = {i: random.uniform(0, 50) for i in range(0, n, 3)}
    edges = spark.createDataFrame(data, "src long, dst long, weight_m double, shade double")
    asked = spark.createDataFrame([(i, random.randrange(n), random.randrange(n)) for i in range(30)], "request_id long, start_node long, end_node long")
    fines = asked.select("request_id").crossJoin(spark.createDataFrame(list(penalty.items()), "node long, penalty double"))
    state = paths.shortest_paths(asked, edges, shade_bias=1.4, penalties=fines, penalty_weight=0.6)
    got = {r.request_id: r.cost for r in paths.arrivals(asked, state).collect()}
    length = {(a, b): [] for a, b, _, _ in data}
    for r in asked.collect():
        want = dijkstra(adj, r.start_node, 1.4, penalty, 0.6).get(r.end_node)
        assert got[r.request_id] == (want if want is None else pytest.approx(want))
    steps = {}
    for r in paths.path_steps(asked, state).collect():
        steps.setdefault(r.request_id, {})[r.seq] = r.node
    for r in asked.collect():
        if got[r.request_id] is not None:
            path = [steps[r.request_id][i] for i in range(len(steps[r.request_id]))]
            assert path[0] == r.start_node and path[-1] == r.end_node and all(p in length for p in zip(path, path[1:]))


def test_paths_over_long_roads_dead_ends_and_rings(spark):
    """Junctions joined by roads of many vertices, trees that hang on, a ring apart, penalties along the roads."""
    rng, pairs, fresh = random.Random(8), [], iter(range(100, 10**6))
    road = lambda a, b, n: pairs.extend(zip([a, *(m := [next(fresh) for _ in range(n)])], [*m, b]))
    for _ in range(16):
        road(*rng.sample(range(10), 2), rng.randrange(0, 30))
    for _ in range(5):  # dead ends that fork
        tip, at = next(fresh), rng.randrange(10)
        road(at, tip, rng.randrange(0, 6))
        road(tip, next(fresh), 3)
        road(tip, next(fresh), 0)
    ring = next(fresh)
    road(ring, ring, 7)
    data, adj = [], {}
    for a, b in {(min(p), max(p)) for p in pairs if p[0] != p[1]}:
        w, s = rng.uniform(1, 100), rng.random()
        for x, y in ((a, b), (b, a)):
            data.append((x, y, w, s))
            adj.setdefault(x, []).append((y, w, s))
    nodes = sorted(adj)
    edges = spark.createDataFrame(data, "src long, dst long, weight_m double, shade double")
    trips = [(i, rng.choice(nodes), rng.choice(nodes)) for i in range(6)] + [(7, 0, 0), (8, 0, ring), (9, 1, 99_999_999)]
    asked = spark.createDataFrame(trips, "request_id long, start_node long, end_node long")
    penalty = {i: {n: rng.uniform(0, 80) for n in rng.sample(nodes, len(nodes) // 4)} for i, *_ in trips}
    fines = spark.createDataFrame([(i, n, p) for i, some in penalty.items() for n, p in some.items()], "request_id long, node long, penalty double")
    found = paths.shortest_paths(asked, edges, shade_bias=1.4, penalties=fines, penalty_weight=0.6)
    assert found.network.roads.count() < len(data) // 3
    got = {r.request_id: (r.cost, r.metres) for r in paths.arrivals(asked, found).collect()}
    steps = {}
    for r in paths.path_steps(asked, found).collect():
        assert r.seq not in steps.setdefault(r.request_id, {})
        steps[r.request_id][r.seq] = r.node
    length = {(a, b): (w, s) for a, b, w, s in data}
    for i, a, b in trips:
        want = dijkstra(adj, a, 1.4, penalty[i], 0.6).get(b)
        if want is None:
            assert got[i] == (None, None) and i not in steps
            continue
        path = [steps[i][k] for k in range(len(steps[i]))]
        assert path[0] == a and path[-1] == b
        walked = [length[p] for p in zip(path, path[1:])]
        assert got[i][0] == pytest.approx(want) and got[i][1] == pytest.approx(sum(w for w, _ in walked))
        assert want == pytest.approx(sum(w * (1 + 1.4 * (1 - s)) for w, s in walked) + 0.6 * sum(penalty[i].get(n, 0.0) for n in path[1:]))


def test_paths_over_thinned_roads(spark, monkeypatch):
    monkeypatch.setattr(paths, "FEW", 3)
    test_paths_over_long_roads_dead_ends_and_rings(spark)


def test_long_roads_are_contracted_in_a_few_times_their_rows(spark, monkeypatch):
    """A road of 4,000 vertices and a ring apart; doubling writes all of its rows a dozen times over."""
    n, written = 4_000, []
    pairs = [(k, k + 1) for k in range(n)] + [(10**6 + k, 10**6 + (k + 1) % 50) for k in range(50)]
    edges = spark.createDataFrame([(x, y, 1.0, 0.5) for a, b in pairs for x, y in ((a, b), (b, a))], "src long, dst long, weight_m double, shade double")

    def counted(df):
        written.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(paths, "cut", counted)
    monkeypatch.setattr(paths, "FEW", 64, raising=False)
    network = paths.contracted(edges, spark.createDataFrame([(0,), (n,)], "node long"))
    assert {(r.src, r.dst, r.metres, r.hops) for r in network.roads.collect()} == {(0, n, float(n), n), (n, 0, float(n), n)}
    assert sum(written) < 10 * 2 * len(pairs)
    top = network.roads.select("road", F.lit(0).cast("long").alias("at"), F.col("src").alias("from"))
    firsts = {(r["from"], r["at"], r.src, r.dst) for r in network.expanded(top).join(network.edges, "road").collect()}
    assert firsts == {(0, k, k, k + 1) for k in range(n)} | {(n, k, n - k, n - k - 1) for k in range(n)}


def test_the_log_keeps_the_least_and_few_tables(spark):
    log = paths.Log(["node"])
    for k in range(9):
        log.add(spark.createDataFrame([(n, float(10 - k), k) for n in range(k, 5 + k)], "node int, cost double, hop int").coalesce(1))
    assert len(log.tables) <= 4
    assert {(r.node, r.cost) for r in log.best().collect()} == {(n, 10.0 - min(n, 8)) for n in range(13)}


def greedy(points, tolerance):
    leaders, out = [], {}
    high, wide = tolerance / 111320.0, tolerance / (111320.0 * math.cos(math.radians(-37.81)))
    cell = lambda p: (math.floor(p[1] / high), math.floor(p[0] / wide))
    for i, p in enumerate(points):
        near = [(metres(p, points[j]), j) for j in leaders if abs(cell(p)[0] - cell(points[j])[0]) <= 1 and abs(cell(p)[1] - cell(points[j])[1]) <= 1]
        best = min((d for d in near if d[0] < tolerance), default=None)
        out[i] = best[1] if best else i
        if not best:
            leaders.append(i)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_snapping_equals_the_sequential_rule(spark, seed):
    random.seed(seed)
    points = [(144.96 + random.random() * 0.0015, -37.81 + random.random() * 0.0012) for _ in range(150)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "ordinal long, lon double, lat double")
    got = {r.ordinal: r.leader for r in graph.leaders(df, 20.0).collect()}
    assert got == greedy(points, 20.0)


def test_a_long_line_settles_in_few_rounds(spark, monkeypatch):
    """Vertices 14 m apart, each in question until the one before is settled: tiles follow the order."""
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or cut(df))
    line = spark.range(10_000).select(F.col("id").alias("ordinal"), (140.0 + F.col("id") * 0.00016).alias("lon"), F.lit(-37.81).alias("lat"))
    got = {r.ordinal: r.leader for r in graph.leaders(line, 20.0).collect()}
    assert got == {i: i - i % 2 for i in range(10_000)}
    assert len(written) <= 3 * 40


def test_tiles_halve_until_they_are_small(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE_VERTICES", 12)
    monkeypatch.setattr(graph, "LEAST_TILE_M", 64.0)
    random.seed(3)
    points = [(144.96 + random.random() * 0.003, -37.81 + random.random() * 0.002) for _ in range(200)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "ordinal long, lon double, lat double")
    assert graph._tile_edge(graph.cubes(df, "lon", "lat", 20.2)) == 64.0
    assert {r.ordinal: r.leader for r in graph.leaders(df, 20.0).collect()} == greedy(points, 20.0)


def test_graph_from_segments(spark):
    lines = [[(144.96, -37.81), (144.961, -37.81), (144.961, -37.811)], [(144.96100001, -37.81000001), (144.96, -37.81)], [(144.96, -37.81005), (144.96, -37.811)]]
    data = [((f << 20) + i, *a, (f << 20) + i + 1, *b) for f, line in enumerate(lines) for i, (a, b) in enumerate(zip(line, line[1:]))]
    segments = spark.createDataFrame(data, "ordinal_a long, lon_a double, lat_a double, ordinal_b long, lon_b double, lat_b double")
    nodes, edges = graph.build_graph(segments)
    assert [tuple(r) for r in nodes.orderBy("id").collect()] == [(0, 144.96, -37.81), (1, 144.961, -37.81), (2, 144.961, -37.811), (3, 144.96, -37.811)]
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(0, 1), (0, 3), (1, 2)]
    assert edges.filter("src = 0 AND dst = 1").first().weight_m == pytest.approx(metres(lines[0][0], lines[0][1]))


def test_components_of_random_graphs(spark):
    random.seed(5)
    n = 200
    pairs = [(random.randrange(n), random.randrange(n)) for _ in range(120)] + [(i, i + 1) for i in range(150, 190)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.range(n)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = graph.components(nodes, edges)
    assert {r.id: r.component for r in got.collect()} == {i: find(i) for i in range(n)}
    sizes = {}
    for i in range(n):
        sizes[find(i)] = sizes.get(find(i), 0) + 1
    assert graph.largest_ratio(got).first().ratio == pytest.approx(max(sizes.values()) / n)
    kept, moved = graph.largest_component(nodes, edges, got)
    assert [r.id for r in kept.orderBy("id").collect()] == list(range(max(sizes.values())))
    assert moved.filter("src >= 0 AND dst >= 0").count() == sum(find(a) == min(k for k, v in sizes.items() if v == max(sizes.values())) for a, b in pairs)


def test_nearest_equals_brute_force(spark):
    random.seed(9)
    spot = lambda: (144.9 + random.random() * 0.05, -37.85 + random.random() * 0.05)
    points, sites = [spot() for _ in range(120)], [spot() for _ in range(60)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "i int, lon double, lat double")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(sites)], "site int, lon double, lat double")
    want = {i: min((metres(x, y), j) for j, y in enumerate(sites)) for i, x in enumerate(points)}
    free = {r.i: r.site for r in space.nearest(p, s, "site").collect()}
    few = {r.i: r.site for r in space.nearest(p, s, "site", edge_m=200.0).collect()}
    assert free == few == {i: j for i, (d, j) in want.items()}
    near = {r.i: r.site for r in space.nearest(p, s, "site", radius_m=400.0).collect()}
    assert near == {i: (j if d <= 400 else None) for i, (d, j) in want.items()}


def test_nearest_far_north_over_the_date_line_and_without_a_place(spark):
    p = spark.createDataFrame([(0, 20.0, 69.0), (1, 179.999, 10.0), (2, None, 10.0), (3, -179.999, -69.0)], "i int, lon double, lat double")
    s = spark.createDataFrame([(7, 20.0095, 69.0), (8, -179.9985, 10.0), (9, 179.9915, -69.0)], "site int, lon double, lat double")
    got = {r.i: r.site for r in space.nearest(p, s, "site", radius_m=400.0).collect()}
    assert got == {0: 7, 1: 8, 2: None, 3: 9}
    free = {r.i: r.site for r in space.nearest(p, s, "site", edge_m=200.0).collect()}
    assert free == got


def test_nearest_with_far_points_and_crowded_sites(spark, monkeypatch):
    """Sites in two crowded towns; points in them, between them, far away and at the poles: few tables are written."""
    rng = random.Random(4)
    town = lambda lon, lat, n, w: [(lon + rng.random() * w, lat + rng.random() * w) for _ in range(n)]
    sites = town(144.9, -37.8, 300, 0.02) + town(145.0, -37.8, 200, 0.3) + [(10.0, 89.9), (-170.0, 89.95), (0.0, -90.0)] + [(144.95, -37.81)] * 2
    points = town(144.9, -37.8, 60, 0.05) + town(146.0, -39.0, 20, 2.0) + town(10.0, 50.0, 30, 1.0) + [(20.0, 89.99), (-20.0, 90.0), (77.0, -89.999), (144.95, -37.81), (-35.0, 37.8)]
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "i int, lon double, lat double")
    s = spark.createDataFrame([(i, *x) for i, x in enumerate(sites)], "site int, lon double, lat double")
    written, cut = [], space.cut
    monkeypatch.setattr(space, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = {r.i: (r.site, r.distance_m) for r in space.nearest(p, s, "site").collect()}
    for i, x in enumerate(points):
        d, j = min((metres(x, y), j) for j, y in enumerate(sites))
        assert got[i][1] == pytest.approx(d, abs=1e-6) and (got[i][0] == j or metres(x, sites[got[i][0]]) - d < 1e-6), i
    assert len(written) <= 7
    # No look meets more than a few cubes a point, though 500 sites lie within two kilometres of each other.
    for front in written[3:]:
        assert front.groupBy("lon", "lat").count().agg({"count": "max"}).first()[0] <= 120


def test_nearest_never_broadcasts_cubes(spark, monkeypatch):
    """Written cubes look small to the optimizer, which would send them through the driver."""
    rng = random.Random(3)
    rows = lambda n: [(i, i % 3, 144.9 + rng.random() * 0.1, -37.8 + rng.random() * 0.1) for i in range(n)]
    p, s = (spark.createDataFrame(rows(n), f"{name} int, g int, lon double, lat double") for n, name in ((60, "i"), (90, "site")))
    plans, cut = [], space.cut
    monkeypatch.setattr(space, "cut", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or cut(df))
    found = space.nearest(p, s, "site", by=["g"])
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line and "level" in line]
    assert joins and not [x for x in joins if "BroadcastHashJoin [level" not in x and "Broadcast" in x]


def test_points_never_meet_at_wide_cubes(spark):
    """The smallest occupied cube around a point is found for cubes, each once, however many points it holds."""
    rng = random.Random(6)
    rows = lambda n, w: [(i, 144.9 + rng.random() * w, -37.8 + rng.random() * w) for i in range(n)] + [(n, 145.0, -38.0)] * 50
    p, s = (space.cubes(spark.createDataFrame(rows(n, w), f"{name} int, lon double, lat double"), "lon", "lat", 25.0) for n, w, name in ((150, 0.5, "i"), (40, 0.01, "site")))
    top = space._levels(25.0)
    whole = space.pyramid(s, "site", [], 25.0)
    level = {tuple(r)[:4]: r.r_site for r in whole.select("level", *space.AXES, "r_site").collect()}
    want = {}
    for r in p.select(*space.AXES).distinct().collect():
        want[tuple(r)] = next((k, level[k, *(c >> k for c in r)]) for k in range(top + 1) if (k, *(c >> k for c in r)) in level)
    found = space._own_cubes(p, whole, [], top)
    assert {(r.cx, r.cy, r.cz): (r.r.level, r.r.r_site) for r in found.collect()} == want
    assert found.count() == len(want) == p.select(*space.AXES).distinct().count()


def test_wide_cubes_are_cut_where_sites_crowd(spark, monkeypatch):
    """With 600 m cubes and 400 sites in two of them, a point meets the sites of small cubes only."""
    rng = random.Random(5)
    spots = lambda n: [(i, 144.9 + rng.random() * 0.008, -37.8 + rng.random() * 0.004) for i in range(n)]
    points, sites = spots(40), spots(400)
    p, s = (spark.createDataFrame(rows, f"{name} int, lon double, lat double") for rows, name in ((points, "i"), (sites, "site")))
    written, cut = [], space.cut
    monkeypatch.setattr(space, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = {r.i: r.site for r in space.nearest(p, s, "site", edge_m=600.0).collect()}
    for i, *x in points:
        assert got[i] == min((metres(x, y), j) for j, *y in sites)[1]
    assert max(f.filter("small").agg({"n": "max"}).first()[0] or 0 for f in written[3:]) <= space.LEAF_SITES


def test_nearest_within_groups(spark):
    rng = random.Random(6)
    rows = lambda n: [(i, rng.randrange(4), 144.9 + rng.random() * 0.1, -37.8 + rng.random() * 0.1) for i in range(n)]
    points, sites = rows(80), [r for r in rows(40) if r[1] != 3]
    p, s = (spark.createDataFrame(r, f"{n} int, g int, lon double, lat double") for r, n in ((points, "i"), (sites, "site")))
    got = {r.i: r.site for r in space.nearest(p, s, "site", by=["g"]).collect()}
    for i, g, *x in points:
        assert got[i] == min(((metres(x, y), j) for j, h, *y in sites if h == g), default=(0, None))[1]
    assert {r.site for r in space.nearest(p, s.limit(0), "site").collect()} == {None}


def test_sites_in_boxes_equal_brute_force(spark, monkeypatch):
    """A street, a town, a continent and empty boxes; 3,000 sites in towns: no box looks at all of its cells."""
    rng = random.Random(12)
    towns = [(rng.uniform(110, 155), rng.uniform(-44, -12)) for _ in range(12)]
    sites = [(x + rng.gauss(0, 0.2), y + rng.gauss(0, 0.2)) for x, y in towns for _ in range(250)]
    boxes = [(110.0, -45.0, 156.0, -10.0), (-180.0, -90.0, 180.0, 90.0), (0.0, 0.0, 1.0, 1.0)]
    for x, y in towns:
        w = rng.choice([0.02, 0.3, 3.0])
        boxes.append((x - w, y - w / 2, x + w / 3, y + w))
    told = spark.createDataFrame([(i, s, n, w, e, (s + n) / 2, (w + e) / 2) for i, (w, s, e, n) in enumerate(boxes)], "request_id int, south double, north double, west double, east double, mid_lat double, mid_lon double")
    placed = spark.createDataFrame([(i, *x) for i, x in enumerate(sites)] + [(9_999, None, 1.0)], "site int, lon double, lat double")
    looked, cut = [], space.cut
    monkeypatch.setattr(space, "cut", lambda df: looked.append(cut(df)) or looked[-1])
    got = {}
    for r in space.nearest_in_box(told, placed, "site", 12).collect():
        got.setdefault(r.request_id, {})[r.rank] = r.site
    for i, (w, s, e, n) in enumerate(boxes):
        held = sorted((metres(((w + e) / 2, (s + n) / 2), p), j) for j, p in enumerate(sites) if w <= p[0] <= e and s <= p[1] <= n)[:12]
        assert [got.get(i, {}).get(k + 1) for k in range(len(held))] == [j for _, j in held] and len(got.get(i, {})) == len(held)
    assert len(looked) <= 2 + space.LEVELS
    assert max(f.groupBy("request_id").count().agg({"count": "max"}).first()[0] for f in looked[2:]) < 300


def test_crowded_sites_in_boxes(spark, monkeypatch):
    """3,000 sites in a cell of 0.01 degrees, some of them at one place: no box meets all of them."""
    rng = random.Random(13)
    sites = [(144.91 + rng.random() * 0.01, -37.81 + rng.random() * 0.01) for _ in range(2_900)] + [(144.915, -37.805)] * 100
    boxes = [(x - 0.006, y - 0.005, x + 0.006, y + 0.005) for x, y in rng.sample(sites, 12) + [(144.915, -37.805), (144.93, -37.805)]]
    told = spark.createDataFrame([(i, s, n, w, e, (s + n) / 2, (w + e) / 2) for i, (w, s, e, n) in enumerate(boxes)], "request_id int, south double, north double, west double, east double, mid_lat double, mid_lon double")
    placed = spark.createDataFrame([(i, *x) for i, x in enumerate(sites)], "site int, lon double, lat double")
    looked, cut = [], space.cut
    monkeypatch.setattr(space, "cut", lambda df: looked.append(cut(df)) or looked[-1])
    got = {}
    for r in space.nearest_in_box(told, placed, "site", 12).collect():
        got.setdefault(r.request_id, {})[r.rank] = r.site
    for i, (w, s, e, n) in enumerate(boxes):
        held = sorted((metres(((w + e) / 2, (s + n) / 2), p), j) for j, p in enumerate(sites) if w <= p[0] <= e and s <= p[1] <= n)[:12]
        assert [got.get(i, {}).get(k + 1) for k in range(len(held))] == [j for _, j in held], i
    crowds = [f.filter("small").agg({"n": "max"}).first()[0] for f in looked if "small" in f.columns]
    assert max([0, *(c for c in crowds if c)]) <= 100


def test_snap_distance_and_limit(spark, square):
    nodes, _ = square
    asked = spark.createDataFrame([(1, 144.9601, -37.8101), (2, 151.2, -33.87)], "q int, lon double, lat double")
    got = {r.q: (r.id, r.distance_m) for r in space.nearest(asked, nodes, "id", radius_m=400.0).collect()}
    assert got[1][0] == 0 and got[1][1] < 50 and got[2] == (None, None)


def test_density_uses_the_95_percent_cell(spark):
    grid = spatial.grid_of((144.96, -37.82, 144.97, -37.81), 400.0)
    counts = [1] * 19 + [7]
    data = [(grid["min_lon"] + (c % 4 + 0.5) * grid["cell_deg_lon"], grid["min_lat"] + (c // 4 + 0.5) * grid["cell_deg_lat"]) for c, n in enumerate(counts) for _ in range(n)]
    cells = spatial.density(spark.createDataFrame(data, "lon double, lat double"), grid)
    assert {r.density for r in cells.collect()} == {1.0, round(1 / 7, 4)}
    ask = spark.createDataFrame([(data[-1][0], data[-1][1]), (144.9, -37.81), (grid["max_lon"] - 1e-6, grid["min_lat"] + 1e-6)], "lon double, lat double")
    assert [r.density for r in spatial.point_density(ask, cells, grid).collect()].count(None) == 1


def test_node_penalties_equal_brute_force(spark):
    """Twelve requests over crowded sites; ids of several places, rows that come twice and nodes without a place."""
    rng = random.Random(14)
    spots = lambda n: [(144.95 + rng.random() * 0.012, -37.81 + rng.random() * 0.009) for _ in range(n)]
    ends = [(i, *a, *b) for i, (a, b) in enumerate(zip(spots(12), spots(12)))]
    sites = [(i, *x) for i, x in enumerate(spots(60))]
    nodes = [(i, *x) for i, x in enumerate(spots(300))]
    flows = [(i, None if i % 9 == 0 else float(rng.randrange(1_000))) for i in range(60)]
    trips = spark.createDataFrame(ends, "request_id int, from_lon double, from_lat double, to_lon double, to_lat double")
    tables = spark.createDataFrame(sites, "site_id int, lon double, lat double"), spark.createDataFrame(flows, "site_id int, flow double")
    of = lambda rows: spark.createDataFrame(rows, "id int, lon double, lat double")
    chosen = {}
    for r in spatial.corridor_sites(trips, tables[0], "site_id").collect():
        if flows[r.site_id][1] is not None:
            chosen.setdefault(r.request_id, []).append(r)

    def by_hand(rows):
        best = {}
        for q, near in chosen.items():
            for i, *x in rows:
                for r in near:
                    d = metres(x, (r.lon, r.lat)) if x[0] is not None else math.inf
                    if d <= 180 and r.west <= x[0] <= r.east and r.south <= x[1] <= r.north:
                        best[q, i] = min(best.get((q, i), (math.inf,)), (d, -r.rank, flows[r.site_id][1]))
        return {k: v[2] for k, v in best.items()}

    plain = spatial.node_penalties(trips, of(nodes), *tables)
    assert "min_by" not in plain._jdf.queryExecution().optimizedPlan().toString()  # pairs of requests and nodes are not dealt again
    assert {(r.request_id, r.node): r.penalty for r in plain.collect()} == by_hand(nodes)
    odd = nodes + nodes[:40] + [(i, *x) for i, x in enumerate(spots(20))] + [(900, None, None)]
    rows = spatial.node_penalties(trips, of(odd), *tables).collect()
    assert {(r.request_id, r.node): r.penalty for r in rows} == by_hand(odd) and len(rows) == len(by_hand(odd))


def test_planned_routes_on_the_square(spark, square):
    nodes, edges = square
    trips = spark.createDataFrame([(1, 144.9601, -37.8101, 144.9611, -37.8111, 30.0), (2, 144.96, -37.81, 151.2, -33.87, 20.0)],
                                  "request_id long, from_lon double, from_lat double, to_lon double, to_lat double, temperature_c double")
    sites = spark.createDataFrame([(7, 144.961, -37.81), (8, 144.96, -37.811)], "site_id long, lon double, lat double")
    flows = spark.createDataFrame([(7, 1000.0), (8, 10.0)], "site_id long, flow double")
    wish = spark.createDataFrame([(1, False, 80, None)], "request_id long, prefer_quieter boolean, heat_sensitivity int, comfort_balance int")
    out, paths = routing.plan_routes(trips, nodes, edges, sites, flows, wish)
    got = {(r.request_id, r.id): r for r in out.collect()}
    assert {k for k in got if k[0] == 1} >= {(1, "fastest"), (1, "shaded")}
    assert got[1, "shaded"].recommended and "most_shaded" in got[1, "shaded"].tags and "fastest" in got[1, "fastest"].tags
    lost = got[2, "fastest"]
    assert (lost.status, lost.warnings, lost.tags) == ("unavailable", ["destination_outside_graph_coverage"], ["estimated"])
    assert [r.node for r in paths.filter("request_id = 1 AND id = 'shaded'").orderBy("seq").collect()] == [0, 1, 2]


def test_hub_and_chain_components(spark):
    """One node carries most edges, and a long chain needs many pointer steps."""
    hub = spark.range(3000).select(F.lit(1_000_000).cast("long").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(5000, 5400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    nodes = spark.range(3000).unionByName(spark.range(5000, 5402)).unionByName(spark.createDataFrame([(1_000_000,)], "id long"))
    got = {r.component: r.nodes for r in graph.component_sizes(graph.components(nodes, hub.unionByName(chain))).collect()}
    assert got == {0: 3001, 5000: 401, 5401: 1}


def test_crowded_copies_snap_once(spark):
    """A third of all vertices share one spot and collapse before anything is compared."""
    data = [(i, 144.96, -37.81) if i % 3 == 0 else (i, 144.95 + (i % 500) * 0.001, -37.8) for i in range(3000)]
    df = spark.createDataFrame(data, "ordinal long, lon double, lat double")
    seen = graph.first_seen(df)
    assert seen.count() == 501 and seen.filter("lon = 144.96 AND lat = -37.81").first().ordinal == 0
    assert graph.leaders(seen, 20.0).filter("leader <> ordinal").count() == 0


def test_penalty_tasks_hold_little_at_a_time():
    """A batch of 10,000 requests is dealt to cubes in slices, with the rows it has when each request comes alone."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    class Rows:
        schema = T.StructType([T.StructField("request_id", T.LongType())])

        def mapInArrow(self, deal, kind):  # noqa: N802
            return deal

    deal, rng, n = spatial._spread(Rows()), np.random.default_rng(3), 10_000
    sizes = rng.integers(0, 13, n)
    ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    place = lambda low, wide: pa.array(low + rng.random(sizes.sum()) * wide)
    near = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([place(144.9, 0.01), place(-37.8, 0.01)], ["lon", "lat"]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), near], ["request_id", "near"])
    tracemalloc.start()
    rows = [r for out in deal(iter([batch])) for r in zip(*(out.column(c).to_pylist() for c in ("request_id", *space.AXES)), np.diff(out.column("near").offsets).tolist())]
    tracemalloc.stop()
    tracemalloc.start()
    for _ in deal(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    alone = [r for i in range(300) for out in deal(iter([batch.slice(i, 1)])) for r in zip(*(out.column(c).to_pylist() for c in ("request_id", *space.AXES)), np.diff(out.column("near").offsets).tolist())]
    assert rows[:len(alone)] == alone and len(alone) > 300
    assert list(deal(iter([batch.slice(0, 0)]))) == []


def test_sites_and_steps_of_all_requests_are_not_broadcast(spark, monkeypatch):
    """Small files can hold many rows: what grows with the requests is joined by sorting."""
    written = []
    monkeypatch.setattr(space, "cut", lambda df, real=space.cut: written.append(df) or real(df))
    trips = spark.createDataFrame([(i, 144.95, -37.81, 144.96, -37.8) for i in range(3)], "request_id int, from_lon double, from_lat double, to_lon double, to_lat double")
    sites = spark.createDataFrame([(i, 144.95 + i * 1e-4, -37.81 + i * 1e-4) for i in range(60)], "site_id int, lon double, lat double")
    spatial.corridor_sites(trips, sites, "site_id")
    told = next(df for df in written if "reach" in df.columns)
    hinted = told._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in hinted[:hinted.index("Generate")]
    edges = spark.createDataFrame([(1, 2, 5.0, 0.5), (2, 3, 5.0, 1.0)], "src int, dst int, weight_m double, shade double")
    steps = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (7, 2, 3)], "request_id int, seq int, node int")
    shade = graph.path_shade(steps, edges)
    assert "strategy=merge" in shade._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in shade.collect()] == [(7, 0.75)]
