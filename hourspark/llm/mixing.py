"""Mixing sources to target weights by weighted fair queueing.

Each shuffled document (and its second copy) has a virtual finish time: the words of its source up to and with
it, divided by the source's target.  The mix is the beginning of the global order by finish time, up to the
total budget.  Running totals are exact at any size: rows are cut into slices of the shuffle order (or of the
finish time), slice sums are added up, and rows are summed within their slice only, so that a source with most
rows is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourspark.llm.common import WORD, done_with, free_name, raw_text, row_order, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5  # words to take, as a multiple of all words
MOST = 2  # copies of a document at most
SLICE_ROWS = 20_000
MOST_PARTS = 1_000  # ranges of a step towards the end of the budget
SEED = 20_240_501


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: str) -> Column:
    """A never-null text that sorts as the source does by code point, nulls last."""
    return F.coalesce(F.concat(F.lit("a"), F.col(source)), F.lit("b"))


def cycled_weights(sources: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Give the sources ``s``, in order, the weights in turn.

    The rank is the number of sources in earlier ranges plus the row number within its own range.
    """
    laid = written(sources.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "sources")
    parts = laid.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = laid.join(F.broadcast(parts.select("part", before.alias("before"))), "part")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("s")) - 1 + F.col("before")
    turn = F.pmod(rank, F.lit(len(weights))).cast("int")
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).drop("part", "before")


def with_targets(weighted: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target`` to sources (s, source_size, weight).

    The budget is shared by weight; a share stops at ``most`` times its source's size, and what is above is shared
    among the others again until none is above.  Each round brings three scalars to the driver.
    """
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, stopped = 0.0, -1
    most_words = F.col("source_size") * most
    while True:
        capped = most_words <= F.col("weight") * level
        n, words, rest = weighted.agg(
            F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == stopped or not rest:
            break
        stopped, level = n, (share * total - most * words) / rest
    target = F.when(most_words <= F.col("weight") * level, most_words.cast("double")).otherwise(F.col("weight") * level)
    return weighted.withColumn("target", F.least(target, most_words.cast("double")))


def _slices(rows: int) -> int:
    return max(1, -(-rows // SLICE_ROWS))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE,
        weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (md5 of the text), size, source_size, target, copies, taken.

    A null text has no words, a null source is a source of its own, null ids sort last.  The order within a
    source depends on the seed, id, text and size alone, so reruns agree; rows that repeat all of them are
    interchangeable.  Texts without words cost nothing and go with their neighbours (taken is 0).  An empty
    table gives no rows.  Other columns are not read.
    """
    spread = F.xxhash64(F.lit(seed), F.col("o"), F.col("key"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), row_order(doc_id).alias("o"), F.md5(F.coalesce(raw_text(text), F.lit(b""))).alias("key"),
        source_key(source).alias("s"), word_count(text).alias("size"),
    )
    sizes = written(rows.withColumn("turn", spread), "sizes")
    slices = _slices(sizes.count())
    rows = sizes.withColumn("slice", F.floor((F.col("turn") / 2.0**64 + 0.5) * slices))
    sources = with_targets(written(cycled_weights(rows.groupBy("s").agg(F.sum("size").alias("source_size")), weights), "weighted"), share)
    sums = rows.groupBy("s", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.join(sources, "s").select("s", "slice", "source_size", "target", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("s", "slice").orderBy("turn", "o", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = rows.withColumn("upto", F.sum("size").over(within)).join(written(sums, "sums"), ["s", "slice"])
    queue = written(queue.withColumn("upto", F.col("upto") + F.col("before")).drop("before", "slice"), "queue")
    done_with(sizes)

    finish = [F.when(F.col("target") > 0, (F.col("upto") + F.col("source_size") * k) / F.col("target")).otherwise(0.0) for k in range(MOST)]
    place = [F.struct(f.alias("finish"), "s", "turn", "o", "key", "size") for f in finish]
    last = _last_taken(queue.where("size > 0").select(F.explode(F.array(*place)).alias("p")).select("p.*"), sources, slices)
    if last is None:
        copies = F.lit(MOST)
    else:
        edge = F.struct(*(F.lit(last[c]).alias(c) for c in ("finish", "s", "turn", "o", "key", "size")))
        copies = sum((p <= edge).cast("int") for p in place)
    return queue.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("s", "upto", "turn")


def _last_taken(queue: DataFrame, sources: DataFrame, slices: int):  # type: ignore[no-untyped-def]
    """The last row of the global order that the total budget holds, None if it holds all.

    Only about SLICE_ROWS rows around the end of the budget are ordered row by row.
    """
    budget = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0] + 0.5
    cut = queue.withColumn("slice", F.floor(F.col("finish") * slices))
    sums = cut.groupBy("slice").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = written(sums.withColumn("upto", upto), "finish")
    over = sums.where(F.col("upto") > budget).orderBy("slice").first()
    if over is None:
        return None
    order = ["finish", "s", "turn", "o", "key", "size"]
    inside = cut.where((F.col("slice") <= over["slice"]) & (F.col("slice") >= over["slice"] - 1)).select(*order)
    start = over["upto"] - over["words"] - (sums.where(F.col("slice") == over["slice"] - 1).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])
    last, spent = None, []
    while True:  # many sources may end at the same time: cut by the whole order until few rows are left
        inside = written(inside, "edge")
        spent.append(inside)
        rows = inside.count()
        if rows <= SLICE_ROWS:
            break
        parts = min(MOST_PARTS, -(-2 * rows // SLICE_ROWS))
        dealt = written(inside.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "edge-parts")
        spent.append(dealt)
        for part in dealt.groupBy("part").agg(F.sum("size").alias("words"), F.max(F.struct(*order)).alias("last")).orderBy("part").collect():
            if start + part["words"] > budget:
                break
            start, last = start + part["words"], part["last"]
        inside = dealt.where(F.col("part") == part["part"]).drop("part")
    upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.lit(start)
    held = inside.withColumn("upto", upto).where(F.col("upto") <= budget).drop("upto")
    final = held.orderBy(*(F.col(c).desc() for c in order)).first()
    done_with(*spent)
    return final or last or {"finish": -1.0, "s": "", "turn": 0, "o": 0, "key": "", "size": 0}


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    order, key, times = (free_name(docs.columns, x) for x in ("order", "key", "times"))
    plan = mix(docs, doc_id, text, source).groupBy(row_order().alias(order), F.col("key").alias(key)).agg(F.max("copies").alias(times))
    mine = docs.withColumns({order: row_order(doc_id), key: F.md5(F.coalesce(raw_text(text), F.lit(b"")))})
    held = mine.join(written(plan.where(F.col(times) > 0), "taken"), [order, key])
    return held.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array_repeat(F.lit(1), F.col(times))).alias(times)).drop(times)
