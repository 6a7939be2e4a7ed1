"""Sharding by longest-processing-time: whole groups of equal texts to the least-loaded shard.

Groups of at least a 1/8192 of all bytes are scheduled one by one, the many small ones in 65,536 bundles by text
hash, at every size of the table: so the heap sees at most 73,728 units, largest first, whatever the corpus
holds, and shards differ by no more than about one bundle or one large group.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourspark.llm.common import raw_text, row_order, written

SHARDS = 8
LARGE_PART = 8_192  # groups of one in so many bytes are units of their own; there are as many at most
BUNDLES = 65_536
SLICE_ROWS = 50_000


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none), and one for its row."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def text_crc(text: str = "text") -> Column:
    return F.crc32(F.coalesce(raw_text(text), F.lit(b"")))


def schedule(units: pd.DataFrame, shards: int = SHARDS) -> pd.DataFrame:
    """Longest-processing-time: units (unit, size), largest first, each to the shard with the least so far."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, unit in sorted(zip(units["size"], units["unit"], strict=True), key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out.append((unit, shard))
        heapq.heappush(heap, (load + size, shard))
    return pd.DataFrame(out, columns=["unit", "shard"]).astype({"unit": "int64", "shard": "int32"})


def sharded(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    Equal texts (null counts as empty) share a shard; shard sizes are as near equal as whole groups allow.  slot
    counts a shard's rows from 0 in an order fixed by id and text; rows that repeat both are interchangeable.
    Null ids are ordinary rows; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), row_order(doc_id).alias("o"), text_size(text).alias("size"), text_crc(text).alias("text_crc32"),
        F.xxhash64(F.coalesce(raw_text(text), F.lit(b""))).alias("h"),
    )
    rows = written(rows, "sizes")
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = rows.groupBy("h").agg(F.sum("size").alias("size"))
    is_large = F.col("size") * LARGE_PART >= F.lit(total)
    # a bundle's number is below BUNDLES; a large group's hash is moved out of that range
    bundle = F.pmod("h", F.lit(BUNDLES))
    own = F.when((F.col("h") >= 0) & (F.col("h") < BUNDLES), F.col("h") - BUNDLES).otherwise(F.col("h"))
    unit = F.when(is_large, own).otherwise(bundle)
    units = written(groups.groupBy(unit.alias("unit")).agg(F.sum("size").alias("size")), "units")
    placed = units.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: schedule(pdf, shards), "unit long, shard int")
    placed = written(placed, "placed")
    large = placed.where((F.col("unit") < 0) | (F.col("unit") >= BUNDLES)).select(F.col("unit").alias("own"), F.col("shard").alias("own_shard"))
    small = placed.where((F.col("unit") >= 0) & (F.col("unit") < BUNDLES)).select(F.col("unit").alias("bundle"), F.col("shard").alias("bundle_shard"))
    # both sides hold at most LARGE_PART and BUNDLES rows of two numbers
    dealt = rows.withColumns({"own": own, "bundle": bundle}).join(F.broadcast(large), "own", "left").join(F.broadcast(small), "bundle", "left")
    spread = F.xxhash64("o", "h")
    dealt = dealt.select("doc_id", "o", "size", "text_crc32", "h", F.coalesce("own_shard", "bundle_shard").alias("shard"),
                         F.pmod(spread, F.lit(max(1, -(-count // SLICE_ROWS)))).alias("slice"))
    dealt = written(dealt, "dealt")
    sums = dealt.groupBy("shard", "slice").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("shard", "slice", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("o", "h", "size", "text_crc32"))
    slot = (F.col("before") + F.col("within") - 1).cast("long").alias("slot")
    return dealt.withColumn("within", within).join(sums, ["shard", "slice"]).select("doc_id", "size", "text_crc32", "shard", slot)
