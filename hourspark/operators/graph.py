"""Street-graph jobs: snapping, edges, components and the shade of paths.

The iterative jobs write every round to the reliable checkpoint folder, so a lost executor costs
one round and the plan stays short.
"""

from __future__ import annotations

import math
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.functions.numbers import half_even
from hourspark.functions.geo import EARTH_M, haversine_m
from hourspark.operators.ordered import numbered
from hourspark.operators.space import AXES, around, cubes
from hourspark.session import cut

SNAP_M = 20.0
# Ordinals number about a million per line, so a slice holds some 16,000 lines.
ORDINAL_SLICE = 2**34


def first_seen(vertices: DataFrame) -> DataFrame:
    """Distinct vertices at 7 decimals with the smallest ordinal and the raw coordinates seen there."""
    return vertices.groupBy(half_even(F.col("lon"), 7).alias("key_lon"), half_even(F.col("lat"), 7).alias("key_lat")).agg(
        F.min("ordinal").alias("ordinal"), F.min_by(F.struct("lon", "lat"), F.col("ordinal")).alias("p")
    ).select("key_lon", "key_lat", "ordinal", "p.lon", "p.lat")


TILE_M, TILE_VERTICES = 8_192.0, 50_000  # tiles are halved until none has more vertices, down to LEAST_TILE_M
LEAST_TILE_M = 256.0


def leaders(vertices: DataFrame, tolerance_m: float = SNAP_M) -> DataFrame:
    """Adds ``leader``: the ordinal of the vertex each vertex snaps onto, its own if none.

    Taken in ordinal order, a vertex snaps onto the nearest earlier leader closer than the tolerance, else it
    leads itself.  A vertex is settled as soon as an earlier leader is that close, or no earlier vertex that
    close is open.  A round settles what it can in tiles of many vertices, each a task that follows the order
    as far as nothing beyond the tile is in question; the next round's tiles lie half a tile further.
    """
    placed = cut(cubes(vertices.select("ordinal", "lon", "lat"), "lon", "lat", tolerance_m * 1.01))
    edge, shift = _tile_edge(placed), 0.0
    open_rows, found = placed.withColumn("leads", F.lit(False)), None
    while True:
        rows = open_rows
        if found is not None:
            beside = around(open_rows.select(*AXES).distinct()).distinct()
            rows = rows.unionByName(found.join(beside, list(AXES), "left_semi").withColumn("leads", F.lit(True)))
        judged = cut(_tiled(rows, edge, shift, tolerance_m).groupBy("tx", "ty", "tz").applyInPandas(_judge(tolerance_m), "ordinal long, leads boolean"))
        fresh = cut(placed.join(judged.filter("leads").select("ordinal"), "ordinal"))
        found = fresh if found is None else cut(found.unionByName(fresh))
        open_rows = cut(open_rows.join(judged, "ordinal", "left_anti"))
        if open_rows.isEmpty():
            break
        shift = edge / 2 - shift
    rest = placed.join(found.select("ordinal"), "ordinal", "left_anti")
    near = around(found.withColumnsRenamed({"ordinal": "l_ordinal", "lon": "l_lon", "lat": "l_lat"}).select("l_ordinal", "l_lon", "l_lat", *AXES))
    met = rest.join(near, list(AXES)).withColumn("d", haversine_m(F.col("lon"), F.col("lat"), F.col("l_lon"), F.col("l_lat")))
    close = met.filter((F.col("d") < tolerance_m) & (F.col("l_ordinal") < F.col("ordinal")))
    snapped = close.groupBy("ordinal").agg(F.min_by("l_ordinal", F.struct("d", "l_ordinal")).alias("leader"))
    return vertices.join(snapped, "ordinal", "left").select(*vertices.columns, F.coalesce("leader", "ordinal").alias("leader"))


def _tile_edge(placed: DataFrame) -> float:
    edge = TILE_M
    while edge > LEAST_TILE_M:
        tiles = placed.groupBy(*[F.floor(F.col(c) / edge).alias(c) for c in "xyz"]).count()
        if (tiles.agg(F.max("count")).first()[0] or 0) <= TILE_VERTICES:
            break
        edge /= 2
    return edge


def _tiled(rows: DataFrame, edge: float, shift: float, tolerance_m: float) -> DataFrame:
    """Rows in their tile (``home``) and in those that lie within the tolerance."""
    tile = lambda c, by: F.floor((F.col(c) + F.lit(shift + by)) / F.lit(edge))
    home = F.lit(True)
    for c in "xyz":
        rows = rows.withColumn(f"t{c}", F.explode(F.array_distinct(F.array(tile(c, -tolerance_m * 1.01), tile(c, tolerance_m * 1.01)))))
        home &= F.col(f"t{c}") == tile(c, 0.0)
    return rows.withColumn("home", home)


def _judge(tolerance_m: float):  # type: ignore[no-untyped-def]
    """The settled vertices of a tile, in ordinal order."""
    far = 2 * math.sin(tolerance_m / (2 * EARTH_M)) * EARTH_M

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ordinal")
        spots, cells = rows[["x", "y", "z"]].to_numpy(), rows[list(AXES)].to_numpy()
        leads, home, ordinals = rows["leads"].to_numpy(), rows["home"].to_numpy(), rows["ordinal"].to_numpy()
        held: dict[tuple, list[tuple[int, bool]]] = {}  # leaders and open vertices by cube
        out = []
        for k in range(len(rows)):
            cell, covered, open_before = tuple(cells[k]), False, False
            if not leads[k]:
                for near in product(*((c - 1, c, c + 1) for c in cell)):
                    for j, leader in held.get(near, ()):
                        if (leader or not open_before) and math.dist(spots[k], spots[j]) < far:
                            covered, open_before = covered or leader, open_before or not leader
                if home[k] and (covered or not open_before):
                    out.append((ordinals[k], not covered))
            if not covered:
                held.setdefault(cell, []).append((k, bool(leads[k] or (home[k] and not open_before))))
        return pd.DataFrame(out, columns=["ordinal", "leads"])

    return judge


def build_graph(segments: DataFrame, tolerance_m: float = SNAP_M) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a street network.

    ``segments`` has ordinal_a, lon_a, lat_a, ordinal_b, lon_b, lat_b; ordinals are longs in input
    order.  Nodes are numbered 0.. in first-seen order; edges are undirected, without loops, once
    per pair, weighted by the metres between their nodes.
    """
    ends = [
        segments.select(F.col(f"ordinal_{s}").alias("ordinal"), F.col(f"lon_{s}").alias("lon"), F.col(f"lat_{s}").alias("lat"))
        for s in "ab"
    ]
    keyed = cut(leaders(cut(first_seen(ends[0].unionByName(ends[1]))), tolerance_m))
    own = keyed.filter("leader = ordinal").select("ordinal", "lon", "lat")
    nodes = cut(
        numbered(own, [], ["ordinal"], F.floor(F.col("ordinal") / F.lit(ORDINAL_SLICE)), "n").select(
            (F.col("n") - 1).alias("id"), "ordinal", "lon", "lat"
        )
    )
    ids = keyed.join(nodes.select(F.col("ordinal").alias("leader"), "id"), "leader").select("key_lon", "key_lat", "id")
    resolved = segments.select(
        *[half_even(F.col(f"{c}_{s}"), 7).alias(f"{c}_{s}") for s in "ab" for c in ("lon", "lat")]
    ).distinct()
    for s in "ab":
        resolved = resolved.join(
            ids.withColumnsRenamed({"key_lon": f"lon_{s}", "key_lat": f"lat_{s}", "id": f"id_{s}"}),
            [f"lon_{s}", f"lat_{s}"],
        )
    pairs = undirected(resolved.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
    return nodes.select("id", "lon", "lat"), weigh(pairs, nodes)


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs with src < dst, loops dropped."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def weigh(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``weight_m``, the metres between the two nodes."""
    ends = nodes.select("id", "lon", "lat")
    return edges.join(ends.withColumnsRenamed({"id": "src", "lon": "a_lon", "lat": "a_lat"}), "src").join(
        ends.withColumnsRenamed({"id": "dst", "lon": "b_lon", "lat": "b_lat"}), "dst"
    ).select(
        *edges.columns, haversine_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")).alias("weight_m")
    )


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of undirected edges."""
    turned = edges.select(*[
        F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns
    ])
    return edges.unionByName(turned)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node id reachable from each node.

    Each round every super-node points to its smallest neighbour, chains of pointers are followed
    to their end, and the edges are rewritten between super-nodes and de-duplicated.  A hub loses
    its parallel edges in the first round, and the neighbour minimum is combined map-side.
    """
    owner = cut(nodes.select("id", F.col("id").alias("component")))
    links = cut(undirected(edges.select("src", "dst")))
    while not links.isEmpty():
        smallest = mirrored(links).groupBy("src").agg(F.min("dst").alias("to")).filter("to < src")
        parents = _roots(cut(smallest))
        owner = cut(_rename(owner, parents, "component"))
        links = cut(undirected(_rename(_rename(links, parents, "src"), parents, "dst")))
    return owner


def _rename(df: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    named = parents.withColumnsRenamed({"src": column, "to": "_to"})
    return df.join(named, column, "left").withColumn(column, F.coalesce("_to", column)).select(*df.columns)


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (src, to) pointers to their ends by doubling."""
    while True:
        onward = parents.select(F.col("src").alias("to"), F.col("to").alias("_next"))
        stepped = cut(parents.join(onward, "to", "left").select("src", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")))
        parents = stepped.select("src", "to")
        if stepped.filter("moved").isEmpty():
            return parents


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


def largest_ratio(labelled: DataFrame) -> DataFrame:
    """One row: nodes in the largest component, all nodes and the ratio of the two."""
    return component_sizes(labelled).agg(F.max("nodes").alias("largest"), F.sum("nodes").alias("total")).withColumn(
        "ratio", F.col("largest") / F.col("total")
    )


def largest_component(nodes: DataFrame, edges: DataFrame, labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The largest component (smallest label on a tie), its nodes renumbered 0.. in id order."""
    best = component_sizes(labelled).agg(
        F.max_by("component", F.struct(F.col("nodes"), -F.col("component"))).alias("c")
    ).scalar()
    kept = nodes.join(labelled.filter(F.col("component") == best).select("id"), "id", "left_semi")
    renumbered = cut(numbered(kept, [], ["id"], F.floor(F.col("id") / F.lit(2**20)), "n").withColumn("n", F.col("n") - 1))
    ids = renumbered.select("id", "n")
    out = edges
    for end in ("src", "dst"):
        out = out.join(ids.withColumnsRenamed({"id": end, "n": f"_{end}"}), end)
    moved = out.select(*[F.col(f"_{c}").alias(c) if c in ("src", "dst") else F.col(c) for c in edges.columns])
    return renumbered.select(F.col("n").alias("id"), *[c for c in nodes.columns if c != "id"]), moved


def path_shade(steps: DataFrame, edges: DataFrame, key: list[str] = ("request_id",)) -> DataFrame:
    """Length-weighted mean shade along each route; null if a step has none or the route has no length."""
    ahead = steps.select(*key, (F.col("seq") - 1).alias("seq"), F.col("node").alias("dst"))
    moves = steps.withColumnRenamed("node", "src").join(ahead.hint("merge"), [*key, "seq"])
    met = moves.join(edges.select("src", "dst", "weight_m", "shade"), ["src", "dst"], "left")
    whole = F.count_if(F.col("shade").isNull()) == 0
    return met.groupBy(*key).agg(
        F.when(whole, F.sum(F.col("weight_m") * F.col("shade")) / F.nullif(F.sum("weight_m"), F.lit(0.0))).alias("shade_avg")
    )
