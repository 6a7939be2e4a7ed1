"""Cheapest routes of many searches at once over a network that is made short first.

Roads without a junction are contracted to one road each, and dead ends that no search asks for are left out, so the
rounds of a search follow junctions and not vertices.  A search keeps a log of improvements: a round writes what it
improves and what waits, never what is settled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourspark.session import cut

SKIP = 16  # hops between the nodes that skip pointers lead to
BUCKET_ROADS = 8.0  # a round settles nodes up to so many mean roads beyond a search's cheapest one
FEW = 2**17  # through nodes that are joined by doubling; more are thinned out first
ROAD = ["road", "src", "dst", "metres", "glare", "hops"]


# Network ------------------------------------------------------------------------------------------


@dataclass
class Network:
    """``roads``: road, src, dst, metres, glare (metres in full sun), hops (first edges in it).

    ``parts`` names for each contraction, the last first, the roads it joined: road, part, before (hops of the road
    before the part).  ``edges`` are the first edges: road, src, dst.
    """

    roads: DataFrame
    parts: list[DataFrame]
    edges: DataFrame

    def expanded(self, rows: DataFrame) -> DataFrame:
        """Rows with ``road`` and ``at`` (hops before it), once for each first edge in the road."""
        for k, parts in enumerate(self.parts, 1):
            named = rows.join(parts, "road", "left")
            rows = named.withColumns({"road": F.coalesce("part", "road"), "at": F.col("at") + F.coalesce("before", F.lit(0))}).drop("part", "before")
            if k % 4 == 0:
                rows = cut(rows)
        return rows


def _ends(roads: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each node with its kind: through (two neighbours, joined with each both ways), dead (none or one) or neither."""
    out = roads.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("low_out"), F.max("dst").alias("high_out"))
    into = roads.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("low_in"), F.max("src").alias("high_in"))
    both = out.join(into, "node", "full").join(anchors.withColumn("kept", F.lit(True)), "node", "left")
    same = (F.col("low_out") == F.col("low_in")) & (F.col("high_out") == F.col("high_in"))
    through = same & (F.col("n_out") == 2) & (F.col("n_in") == 2) & (F.col("low_out") < F.col("high_out"))
    dead = F.col("n_out").isNull() | F.col("n_in").isNull() | (same & (F.col("low_out") == F.col("high_out")))
    free = F.col("kept").isNull()
    return both.select("node", F.coalesce(through & free, F.lit(False)).alias("through"), F.coalesce(dead & free, F.lit(False)).alias("dead"))


def _thinned(roads: DataFrame, through: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(roads, parts of each round): roads joined over most of the ``through`` nodes, until FEW are left.

    A node is a row with its two roads in.  A round takes out the nodes whose hash is less than those of their through
    neighbours, a third of them or more and never two in a row, and tells each neighbour by which road it is reached
    now.  So the rows of all rounds together are a few times the roads.  Roads into other nodes are rows of their own.
    """
    ends = [through.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_free")) for c in ("src", "dst")]
    flagged = roads.join(ends[0], "src", "left").join(ends[1], "dst", "left")
    flagged = cut(flagged.select(*ROAD, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("src_free", "dst_free")]))
    whole = [flagged.where("NOT src_free AND NOT dst_free").select(*ROAD)]
    way = ["road", "metres", "glare", "hops"]
    side = F.struct(F.col("src").alias("node"), F.col("src_free").alias("free"), *way)
    nodes = cut(flagged.where("dst_free").groupBy(F.col("dst").alias("node")).agg(F.min(side).alias("a"), F.max(side).alias("b")))
    exits = flagged.where("src_free AND NOT dst_free").select(F.col("dst").alias("node"), side.alias("a"))
    of = lambda rows, s: rows.select(f"{s}.road", F.col(f"{s}.node").alias("src"), F.col("node").alias("dst"), *[f"{s}.{c}" for c in way[1:]])

    def extended(s: str, by: Column) -> Column:
        """Side ``s`` after the road ``by``, if any, and then which road this is a part of and the hops before it."""
        now = [by["node"].alias("node"), by["free"].alias("free"), by["road"].alias("road"), *[(by[c] + F.col(s)[c]).alias(c) for c in way[1:]]]
        same = [F.col(s)[c].alias(c) for c in ("node", "free", *way)]
        part = F.struct(*now, F.col(s)["road"].alias("part"), by["hops"].alias("before"))
        return F.when(by.isNotNull(), part).otherwise(F.struct(*same, F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("before"))).alias(s)

    parts: list[DataFrame] = []
    while nodes.where("a.node <> b.node").count() > FEW:
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(parts))), F.col(c))
        lower = [~F.col(f"{s}.free") | (rank("node") < rank(f"{s}.node")) for s in "ab"]
        least = (F.col("a.node") != F.col("b.node")) & lower[0] & lower[1]
        told = [
            nodes.where(least).select(F.col(f"{to}.node").alias("node"), F.col(f"{to}.free").alias("free"), F.col("node").alias("old"),
                                      F.struct(*[F.col(f"{by}.{c}").alias(c) for c in ("node", "free", *way)]).alias("by"))
            for to, by in ("ab", "ba")
        ]
        news = told[0].unionByName(told[1])
        news_of = news.where("free").groupBy("node").agg(*[f(F.struct("old", "by")).alias(m) for f, m in ((F.min, "m1"), (F.max, "m2"))])  # two at most
        by = lambda s: F.when(F.col("m1.old") == F.col(f"{s}.node"), F.col("m1.by")).when(F.col("m2.old") == F.col(f"{s}.node"), F.col("m2.by"))
        nodes = cut(nodes.where(~least).join(news_of, "node", "left").select("node", extended("a", by("a")), extended("b", by("b"))))
        led = exits.withColumn("old", F.col("a.node")).join(news.where("NOT free").select("node", "old", "by"), ["node", "old"], "left")
        exits = cut(led.select("node", extended("a", F.col("by"))))
        joined = [rows.where(f"{s}.part IS NOT NULL").select(f"{s}.road", f"{s}.part", f"{s}.before") for rows, s in ((nodes, "a"), (nodes, "b"), (exits, "a"))]
        later = joined[0].unionByName(joined[1]).unionByName(joined[2])
        parts.append(later.unionByName(later.select("road", F.col("road").alias("part"), F.lit(0).cast("long").alias("before"))))
        whole.append(of(exits.where("NOT a.free"), "a"))
        exits = exits.where("a.free")
    for rows in (of(nodes, "a"), of(nodes, "b"), of(exits, "a"), *whole[1:]):
        whole[0] = whole[0].unionByName(rows)
    return cut(whole[0]), parts


def _contracted(roads: DataFrame, through: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roads, parts) with every run of roads over ``through`` nodes as one road, named as its first one."""
    inner = through.select(F.col("node").alias("dst"))
    leads = roads.join(inner, "dst", "left_semi")
    ahead = roads.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("road").alias("to"))
    # The end of each road's run, by doubling: a run of n roads takes about log2(n) rounds.
    run = leads.join(ahead, "dst").filter("far <> src").select("road", "to", "metres", "glare", "hops", F.lit(None).cast("long").alias("end"), F.col("road").alias("last"))
    free = roads.join(inner, "dst", "left_anti").select("road", F.lit(None).cast("long").alias("to"), "metres", "glare", "hops", F.col("dst").alias("end"), F.col("road").alias("last"))
    ended, run = [cut(free)], cut(run)
    # Rounds beyond the logarithm of all roads only go round rings that no junction touches; these are left out.
    for _ in range(max(1, run.count()).bit_length() + 1):
        if run.isEmpty():
            break
        onward = run.unionByName(ended[0]) if len(ended) == 1 else run.unionByName(ended[0]).unionByName(ended[1])
        next_ = onward.select(F.col("road").alias("to"), *[F.col(c).alias(f"n_{c}") for c in ("to", "metres", "glare", "hops", "end", "last")])
        step = cut(run.join(next_, "to").select("road", F.col("n_to").alias("to"), *[(F.col(c) + F.col(f"n_{c}")).alias(c) for c in ("metres", "glare", "hops")], F.col("n_end").alias("end"), F.col("n_last").alias("last")))
        done = step.filter("to IS NULL")
        ended = [ended[0], done if len(ended) == 1 else cut(ended[1].unionByName(done))]
        run = step.filter("to IS NOT NULL")
    whole = ended[0] if len(ended) == 1 else ended[0].unionByName(ended[1])
    starts = roads.join(through.select(F.col("node").alias("src")), "src", "left_anti").select("road", "src")
    joined = cut(starts.join(whole, "road").filter("src <> end").select("road", "src", F.col("end").alias("dst"), "metres", "glare", "hops"))
    # Seen backwards, a road's run ends where the run that it is part of begins.
    named = roads.select("road", "src", "dst", "hops")
    turned = named.select(F.col("road").alias("back"), F.col("src").alias("dst"), F.col("dst").alias("src"))
    pairs = cut(named.join(turned, ["src", "dst"]).select("road", "back", "hops"))
    runs = whole.select(F.col("road").alias("back"), F.col("last").alias("back_first"), F.col("hops").alias("so_far"))
    first = pairs.select(F.col("road").alias("first"), F.col("back").alias("back_first"))
    inside = leads.select("road").unionByName(roads.join(through.select(F.col("node").alias("src")), "src", "left_semi").select("road")).distinct()
    parts = pairs.join(inside, "road", "left_semi").join(runs, "back").join(first, "back_first")
    return joined, cut(parts.select(F.col("first").alias("road"), F.col("road").alias("part"), (F.col("so_far") - F.col("hops")).alias("before")))


def contracted(edges: DataFrame, anchors: DataFrame) -> Network:
    """The network of directed ``edges`` (src, dst, weight_m and maybe shade) between ``anchors`` (node).

    Contraction and the removal of dead ends go on until neither changes anything.  All cheapest routes
    between anchors are kept, whatever the shade bias and the penalties of nodes.
    """
    shade = F.coalesce("shade", F.lit(0.0)) if "shade" in edges.columns else F.lit(0.0)
    numbered = edges.filter("src <> dst").withColumn("road", F.monotonically_increasing_id())
    roads = cut(numbered.select("road", "src", "dst", F.col("weight_m").alias("metres"), (F.col("weight_m") * (1.0 - shade)).alias("glare"), F.lit(1).cast("long").alias("hops")))
    anchors = cut(anchors.distinct())
    first, parts = roads.select("road", "src", "dst"), []
    while True:
        kinds = cut(_ends(roads, anchors))
        dead, through = kinds.filter("dead").select("node"), kinds.filter("through").select("node")
        if not dead.isEmpty():
            for end in ("src", "dst"):
                roads = roads.join(dead.withColumnRenamed("node", end), end, "left_anti")
            roads = cut(roads.select("road", "src", "dst", "metres", "glare", "hops"))
            kinds = cut(_ends(roads, anchors))
            through = kinds.filter("through").select("node")
        elif through.isEmpty():
            return Network(roads, parts[::-1], first)
        if through.count() > FEW:
            roads, joined = _thinned(roads, cut(through))
            parts += joined
        elif not through.isEmpty():
            roads, joined = _contracted(roads, cut(through))
            parts.append(joined)


# Searches -----------------------------------------------------------------------------------------


class Log:
    """Improvements in tables whose sizes fall by half at least, so that a row is rewritten a few times at most."""

    def __init__(self, keys: list[str]):
        self.keys, self.tables = keys, []

    def add(self, table: DataFrame) -> None:
        self.tables.append((table, table.count()))
        while len(self.tables) > 1 and self.tables[-2][1] < 2 * self.tables[-1][1]:
            (a, _), (b, _) = self.tables[-2:]
            merged = cut(self._least(a.unionByName(b)))
            self.tables[-2:] = [(merged, merged.count())]

    def _least(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        least = rows.groupBy(*self.keys).agg(F.min(F.struct(*rest)).alias("b"))
        return least.select(*self.keys, *[F.col(f"b.{c}").alias(c) for c in rest])

    def rows(self) -> DataFrame:
        out = self.tables[0][0]
        for table, _ in self.tables[1:]:
            out = out.unionByName(table)
        return out

    def best(self) -> DataFrame:
        return self._least(self.rows())


@dataclass
class Found:
    """``state``: the key columns, node, cost, metres, prev, road (from prev), hop and skip of all visited junctions."""

    state: DataFrame
    network: Network
    key: list[str]


def shortest_paths(
    searches: DataFrame, edges: DataFrame, key: list[str] = ("request_id",), shade_bias: Column | float = 0.0,
    penalties: DataFrame | None = None, penalty_weight: Column | float = 0.0, bucket_roads: float = BUCKET_ROADS,
) -> Found:
    """Cheapest routes of many searches at once.

    ``searches`` has the columns of ``key``, start_node and end_node (and what ``shade_bias`` and ``penalty_weight``
    refer to); ``edges`` are directed with src, dst, weight_m and shade; ``penalties`` has the columns it shares with
    ``searches``, node and penalty.  Cost of a step is ``weight * (1 + bias * (1 - shade)) + penalty_weight *
    penalty(dst)``; metres add up unbiased.  In a round each search steps on from its cheapest waiting junctions,
    up to a bucket's width apart, while these are cheaper than its best known arrival.
    """
    key = list(key)
    number = lambda v: (F.lit(float(v)) if isinstance(v, (int, float)) else v).cast("double")
    asked = cut(searches.filter(F.col("start_node").isNotNull() & F.col("end_node").isNotNull()).select(
        *key, F.col("start_node").cast("bigint").alias("start_node"), F.col("end_node").cast("bigint").alias("end_node"),
        number(shade_bias).alias("bias"), number(penalty_weight).alias("pull"),
    ))
    network = contracted(edges, asked.select(F.explode(F.array("start_node", "end_node")).alias("node")))
    roads = network.roads
    on_road, at_node = _penalties(network, penalties, key)
    mean = roads.agg(F.avg(F.col("metres") + F.col("glare"))).first()[0] or 0.0
    none = F.lit(None).cast("bigint")
    begin = F.col("start_node").alias("node"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("metres"), none.alias("prev"), none.alias("road"), F.lit(0).alias("hop"), none.alias("skip")
    log, columns = Log([*key, "node"]), [*key, "node", "cost", "metres", "prev", "road", "hop", "skip"]
    waiting = cut(asked.select(*key, *begin))
    log.add(waiting)
    bounds = cut(asked.filter("start_node = end_node").select(*key, F.lit(0.0).alias("bound")))
    ends = asked.select(*key, F.col("end_node").alias("node"))
    waiting = waiting.join(ends, [*key, "node"], "left_anti")
    while not waiting.isEmpty():
        least = F.min("cost").over(Window.partitionBy(*key))
        split = cut(waiting.withColumn("now", F.col("cost") <= least + bucket_roads * mean))
        front = split.filter("now").select(*key, "cost", "metres", "hop", "skip", F.col("node").alias("from_node"))
        steps = front.join(asked.select(*key, "bias", "pull"), key).join(
            roads.select(F.col("src").alias("from_node"), F.col("dst").alias("node"), "road", F.col("metres").alias("r_metres"), "glare"), "from_node"
        )
        fine = F.lit(0.0)
        for extra, on, name in ((on_road, "road", "r_penalty"), (at_node, "node", "penalty")):
            if extra is not None:
                shared = [k for k in key if k in extra.columns]
                steps = steps.join(extra.select(*shared, on, name), [*shared, on], "left")
                fine = fine + F.coalesce(name, F.lit(0.0))
        offer = F.col("cost") + F.col("r_metres") + F.col("bias") * F.col("glare") + F.col("pull") * fine
        told = F.struct(
            offer.alias("cost"), (F.col("metres") + F.col("r_metres")).alias("metres"), F.col("from_node").alias("prev"), "road", (F.col("hop") + 1).alias("hop"),
            F.when(F.col("hop") % SKIP == 0, F.col("from_node")).otherwise(F.col("skip")).alias("skip"),
        )
        offers = steps.groupBy(*key, "node").agg(F.min(told).alias("o")).select(*key, "node", "o.*")
        offers = cut(offers.join(bounds, key, "left").filter("bound IS NULL OR cost < bound").select(*columns))
        known = log.rows().join(offers.select(*key, "node"), [*key, "node"], "left_semi").groupBy(*key, "node").agg(F.min("cost").alias("known"))
        better = cut(offers.join(known, [*key, "node"], "left").filter("known IS NULL OR cost < known").select(*columns))
        log.add(better)
        reached = better.join(ends, [*key, "node"], "left_semi").select(*key, F.col("cost").alias("bound"))
        bounds = cut(bounds.unionByName(reached).groupBy(*key).agg(F.min("bound").alias("bound")))
        later = split.filter("NOT now").join(better.select(*key, "node"), [*key, "node"], "left_anti").select(*columns)
        news = better.join(ends, [*key, "node"], "left_anti").select(*columns)
        waiting = cut(later.unionByName(news).join(bounds, key, "left").filter("bound IS NULL OR cost < bound").select(*columns))
    return Found(cut(log.best()), network, key)


def _penalties(network: Network, penalties: DataFrame | None, key: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """(of the nodes inside each road, of each node), per search as far as the penalties are."""
    if penalties is None:
        return None, None
    shared = [k for k in key if k in penalties.columns]
    at_node = penalties.groupBy(*shared, "node").agg(F.max("penalty").alias("penalty"))
    if not network.parts:
        return None, at_node
    whole = network.roads.filter("hops > 1").select("road", F.col("road").alias("top"), F.lit(0).cast("long").alias("at"), F.col("dst").alias("last"))
    inside = network.expanded(whole).join(network.edges, "road").filter("dst <> last").select(F.col("top").alias("road"), F.col("dst").alias("node"))
    on_road = at_node.join(inside, "node").groupBy(*shared, "road").agg(F.sum("penalty").alias("r_penalty"))
    return cut(on_road), at_node


def arrivals(searches: DataFrame, found: Found) -> DataFrame:
    """Cost and metres of every search; null where the ends are not connected."""
    ends = searches.select(*found.key, F.col("end_node").alias("node"))
    return ends.join(found.state.hint("merge"), [*found.key, "node"], "left").select(*found.key, "cost", "metres")


def path_steps(searches: DataFrame, found: Found) -> DataFrame:
    """(key, seq, node) of each found route, from start (0) to end.

    Skip pointers lead from the end to the start in steps of SKIP junctions; from all junctions met that way the
    ones between are followed at the same time.  Only rows of the routes themselves are written.
    """
    key = found.key
    # Ids and hops compress to a small part of their size: tables of all searches are never broadcast.
    state = found.state.select(*key, "node", "prev", "road", "hop", "skip").hint("merge")
    ends = searches.select(*key, F.col("end_node").alias("node"))
    reached = cut(ends.join(state, [*key, "node"]))
    met, tips = reached, reached
    while True:
        tips = cut(tips.filter("hop > 0").select(*key, F.col("skip").alias("node")).join(state, [*key, "node"]))
        if tips.isEmpty():
            break
        met = met.unionByName(tips)
    on_path, tips = cut(met), met
    met = on_path
    for _ in range(SKIP - 1):
        # A junction whose hop is a multiple of SKIP has been met already.
        tips = cut(tips.filter(f"hop > 0 AND hop % {SKIP} <> 1").select(*key, F.col("prev").alias("node")).join(state, [*key, "node"]))
        if tips.isEmpty():
            break
        on_path = on_path.unionByName(tips)
    on_path = cut(on_path)
    hops = found.network.roads.select("road", "hops")
    passed = cut(on_path.filter("hop > 0").join(hops, "road"))
    before = F.sum("hops").over(Window.partitionBy(*key).orderBy("hop")) - F.col("hops")
    firsts = found.network.expanded(passed.select(*key, "road", before.alias("at"))).join(found.network.edges, "road")
    start = on_path.filter("hop = 0").select(*key, F.lit(0).cast("long").alias("seq"), "node")
    return start.unionByName(firsts.select(*key, (F.col("at") + 1).alias("seq"), F.col("dst").alias("node")))
