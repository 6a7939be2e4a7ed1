"""Near copies by word shingles: all pairs of Jaccard similarity SIMILARITY or more.

SimHash fingerprints of the shingles are compared first, and the pairs within a few bits are checked.  What they leave
apart is found exactly by prefixes: two sets that are so similar share an element of their prefixes, the first elements
in any one order of all shingles.  The order only decides the cost.  A first order puts shingles that a sample of texts
shares last; texts that meet in very full blocks all the same are dealt again in the order of the exact counts among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourspark.llm.common import done_with, free_name, raw_text, row_order, small_batches, written
from hourspark.llm.components import rooted
from hourspark.llm.simhash import close_links, majority

SHINGLE_WORDS = 5
SIMILARITY = (4, 5)  # as a fraction, so that limits are exact
SAMPLE = 20_000  # texts whose shared shingles are put last, about
SHARED = 400_000  # such shingles, at most; the others keep their places by hash
TRIED = 3  # texts that a text is compared with first, and in each further round
ROUNDS = 8  # further rounds, at most; they go on while one pair of WORTH is similar
WORTH = 32
# In a block of more texts, pairs that are not joined yet meet by size.
PAIRED_BLOCK = 64
DEALT_BLOCK = 4_096  # the texts of a block fuller than this are dealt again by exact counts
BANDS = 16  # size classes to a doubling of the size, in full blocks


def shingles(raw: bytes | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles (A-Z lowered); none without a word."""
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    runs = [b" ".join(words)] if len(words) < SHINGLE_WORDS else map(b" ".join, zip(*(words[k:] for k in range(SHINGLE_WORDS))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64).view(np.int64))


def prefix_size(n: int) -> int:
    part, whole = SIMILARITY
    return n - -(-part * n // whole) + 1 if n else 0


def sketch(items: np.ndarray) -> np.ndarray:
    """A bit for each of a power of two of classes (one for each item, about): whether an odd number falls in it."""
    longs = 1 << max(0, (len(items) - 1).bit_length() - 6)
    odd = np.bincount(items & (64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _shared(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of texts hold, ascending, and how many hold them."""
    every = max(1, -(-docs.count() // SAMPLE))
    raws = docs.select(raw_text(text).alias("raw")).where(F.pmod(F.xxhash64("raw"), F.lit(every)) == 0).distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item": np.concatenate([np.zeros(0, np.int64), *map(shingles, batch["raw"])])})

    seen = raws.mapInPandas(cut, "item long").groupBy("item").count().where("count > 1")
    rows = seen.orderBy(F.col("count").desc(), "item").limit(SHARED).toPandas().sort_values("item")
    return rows["item"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def _marked(docs: DataFrame, text: str, own: str) -> DataFrame:
    """``docs`` with a struct ``own`` of the hash ``node`` of each text's shingle set, its size, prefix, sketch and SimHash."""
    shared = docs.sparkSession.sparkContext.broadcast(_shared(docs, text))  # bounded by SHARED

    @F.pandas_udf("node long, n int, prefix array<long>, bits array<long>, fp long")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, counts = shared.value
        for batch in batches:
            rows = []
            for items in map(shingles, batch):
                late = np.zeros(len(items), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, items), len(names) - 1)
                    late = np.where(names[at] == items, counts[at], 0)
                first = items[np.lexsort((items, late))[: prefix_size(len(items))]]
                rows.append((np.array([xxhash.xxh64_intdigest(items.tobytes())], np.uint64).view(np.int64)[0], len(items), first, sketch(items), majority(items.view(np.uint64))))
            yield pd.DataFrame(rows, columns=["node", "n", "prefix", "bits", "fp"])

    return docs.withColumn(own, marks(raw_text(text)))


def _sets(texts: DataFrame) -> DataFrame:
    """(node, n, items) of distinct (node, raw)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            items = [shingles(x) for x in batch["raw"]]
            yield pd.DataFrame({"node": batch["node"], "n": [len(x) for x in items], "items": items})

    return texts.mapInPandas(cut, "node long, n int, items array<long>")


def _met(dealt: DataFrame) -> DataFrame:
    """The rows of ``dealt`` (item, node, n, at) whose item several of them have, with their ``count``."""
    return dealt.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("item"))).where("count > 1")


def _exact_prefixes(sets: DataFrame) -> DataFrame:
    """(item, node, n, at) of the prefixes of ``sets`` in the order of how many of them hold an item.

    Items of one set alone come first and meet nobody, so only the others are ranked, behind their number.
    """
    part, whole = SIMILARITY
    held = sets.select("node", "n", F.explode("items").alias("item"))
    held = _met(held)
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    at = alone + F.row_number().over(Window.partitionBy("node").orderBy("count", "item")) - 1
    size = F.col("n") - F.ceil(F.lit(part) * F.col("n") / F.lit(whole)) + 1
    return held.withColumn("at", at.cast("int")).where(F.col("at") < size).select("item", "node", "n", "at")


def _may_be_similar(l: str = "l", r: str = "r") -> Column:
    """Of rows l and r that meet at their first common item: whether the sizes and the items left can suffice."""
    part, whole = SIMILARITY
    n, m = (F.col(f"{x}.n").cast("long") for x in (l, r))
    left = F.least(n - F.col(f"{l}.at"), m - F.col(f"{r}.at"))
    return (part * F.greatest(n, m) <= whole * F.least(n, m)) & ((part + whole) * left >= part * (n + m))


def _first_tries(met: DataFrame) -> DataFrame:
    """For each text up to TRIED pairs, with the texts that hold the items of its blocks first, so have fewest of their own."""
    rows = met.select("item", F.struct("at", "node", "n").alias("r"))
    rows = rows.withColumn("l", F.min("r").over(Window.partitionBy("item"))).where((F.col("l.node") != F.col("r.node")) & _may_be_similar())
    pairs = rows.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    return pairs.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("a"))).where(F.col("k") <= TRIED).drop("k")


def _open(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``blocks`` whose block holds several components, with ``root`` and the block's largest one, ``most_of``."""
    named = blocks.join(roots, "node", "left").select("item", "node", "n", "at", "count", F.coalesce("root", "node").alias("root"))
    held = named.groupBy("item", "root").agg(F.count(F.lit(1)).alias("own"))
    most = held.groupBy("item").agg(F.max(F.struct("own", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    return named.join(most.select("item", F.col("m.root").alias("most_of")), "item")


def _more_tries(rest: DataFrame, turn: int) -> DataFrame:
    """For each text outside the largest component of a block up to TRIED pairs, with one text of that component and one
    of the others: those that hold the item first, others each ``turn``."""
    rows = rest.select("item", "most_of", F.struct(F.floor(F.col("at") / F.lit(turn + 1)).alias("late"), F.xxhash64("node", F.lit(turn)).alias("k"), "node", "n", "at", "root").alias("r"))
    inside = F.col("r.root") == F.col("most_of")
    leads = rows.groupBy("item").agg(F.min(F.when(inside, F.col("r"))).alias("one"), F.min(F.when(~inside, F.col("r"))).alias("two"))
    met = rows.where(~inside).join(leads, "item").select("r", F.explode(F.array("one", "two")).alias("l"))
    pairs = met.where((F.col("l.root") != F.col("r.root")) & _may_be_similar()).select(F.col("r.node").alias("b"), F.col("l.node").alias("a")).distinct()
    kept = pairs.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", F.lit(turn)), "a"))).where(F.col("k") <= TRIED)
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _close_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of ``classes`` by SimHash: those of one fingerprint with its least class, and the least ones of close fingerprints."""
    least = written(classes.groupBy("fp").agg(F.min("node").alias("lead")), "prints")
    same = classes.join(least, "fp").where("node <> lead").select("lead", "node")
    a, b = (least.select(F.col("fp").alias(x), F.col("lead").alias(f"n{x}")) for x in "ab")
    close = close_links(least.select("fp")).join(a, "a").join(b, "b").select("na", "nb")
    pairs = written(same.union(close).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "close")
    done_with(least)
    return pairs


def _named(met: DataFrame) -> DataFrame:
    return met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _pairs(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    return _named(left.alias("l").join(right.alias("r"), (F.col("l.item") == F.col("r.item")) & condition & _may_be_similar()))


def _by_size(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows of full blocks that are not joined yet, met by size: the larger text looks for the smaller.

    A row with ``n - at`` items left can only be similar to texts of at least part/whole of its size and at most
    ``most``, so rows late in their prefix look into few size classes or none.
    """
    part, whole = SIMILARITY
    band = lambda n: F.floor(F.log2(n.cast("double")) * BANDS)
    most = F.floor((part + whole) * (F.col("n") - F.col("at")) / part) - F.col("n")
    least = F.ceil(F.lit(part) * F.col("n") / F.lit(whole))
    asks = left.withColumn("most", F.least(most, F.col("n"))).withColumn("least", least).where("most >= least")
    asks = asks.withColumn("band", F.explode(F.sequence(band(F.col("least")), band(F.col("most")))))
    held = right.where(most >= F.col("n")).withColumn("band", band(F.col("n")))
    meets = (F.col("l.item") == F.col("r.item")) & (F.col("l.band") == F.col("r.band")) & (F.col("l.n") >= F.col("r.n")) & (F.col("l.root") != F.col("r.root"))
    return _named(asks.alias("l").join(held.alias("r"), meets & _may_be_similar()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    part, whole = SIMILARITY
    a, b = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("items").alias(f"i{x}")) for x in "ab")
    both = F.size(F.array_intersect("ia", "ib")).cast("long")
    return pairs.join(a, "a").join(b, "b").where((part + whole) * both >= part * (F.col("na").cast("long") + F.col("nb"))).select("a", "b")


def _sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sketches do not rule them out: each differing bit is an item of one set alone.

    Sizes of similar sets differ by a quarter at most, so their sketches by one doubling; the longer one is folded.
    """
    part, whole = SIMILARITY
    a, b = (classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}")) for x in "ab")
    least = F.least(F.size("sa"), F.size("sb"))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda s: F.when(F.size(s) > least, F.zip_with(F.slice(s, 1, least), F.slice(s, least + 1, least), xor)).otherwise(F.col(s))
    apart = F.aggregate(F.zip_with(fold("sa"), fold("sb"), xor), F.lit(0), lambda n, x: n + F.bit_count(x))
    may = (part + whole) * apart.cast("long") <= (whole - part) * (F.col("na").cast("long") + F.col("nb"))
    return pairs.join(a, "a").join(b, "b").where(may).select("a", "b")


def similar_links(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``(a, b)`` that join all of ``classes`` (node, n, prefix, bits, fp; distinct) which similar pairs join.

    ``sets_of`` gives (node, n, items) for a table of nodes; only texts that meet others are asked for.  Every link
    is a similar pair.  Pairs of close SimHash fingerprints come first.  Then texts meet in blocks of a common prefix
    item; those of blocks beyond DEALT_BLOCK are dealt into new blocks first.  A text is compared with the first texts of some
    of its blocks, and in further rounds with a few texts of other components, so that a block of many similar texts is
    joined by about as many pairs as it has texts.  Then all pairs that are not joined yet are compared: those of a block
    of at most PAIRED_BLOCK, and in a fuller one the texts outside its largest component with others of a fitting size.
    """
    few, fullest = F.col("count") <= PAIRED_BLOCK, F.col("count") > DEALT_BLOCK
    met = written(_met(classes.select("node", "n", F.posexplode("prefix").alias("at", "item"))), "met")
    crowd = written(met.where(fullest).select("node").distinct(), "crowd")
    blocks, spent = met, [met, crowd]
    if not crowd.isEmpty():
        again = written(_met(_exact_prefixes(sets_of(crowd))).withColumn("again", F.lit(True)), "again")
        # an item may name an old block and a new one
        blocks = met.where(~fullest).withColumn("again", F.lit(False)).unionByName(again).withColumn("item", F.xxhash64("item", "again")).drop("again")
        spent.append(again)
    close = _checked(_close_pairs(classes), classes, sets_of)
    tries = _first_tries(blocks).join(close, ["a", "b"], "left_anti")
    links = close.unionByName(_checked(written(tries, "tries"), classes, sets_of))
    roots = written(rooted(links), "joined")
    rest = written(_open(blocks, roots), "open")
    spent += [roots, rest]
    for turn in range(ROUNDS):
        tries = written(_more_tries(rest, turn), "tries")
        tried = tries.count()
        found = _checked(tries, classes, sets_of)
        similar = found.count()
        if similar:
            links = links.unionByName(found)
            roots = written(rooted(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)), "joined")
            rest = written(_open(rest.select(blocks.columns), roots), "open")
            spent += [roots, rest]
        if similar * WORTH < tried or not tried:
            break
    apart = (F.col("l.root") != F.col("r.root")) & (F.col("l.node") < F.col("r.node"))
    full = rest.where(~few)
    inside, outside = full.where("root = most_of"), full.where("root <> most_of")
    pairs = _pairs(rest.where(few), rest.where(few), apart).unionByName(_by_size(outside, full)).unionByName(_by_size(inside, outside))
    pairs = written(pairs.distinct(), "apart")
    done_with(*spent)
    return links.unionByName(_checked(pairs, classes, sets_of))


def _checked(pairs: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The similar ones of written ``pairs``: by sketches first, so that few whole sets are dealt."""
    likely = written(_sketched(pairs, classes), "likely")
    sets = written(sets_of(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets")
    links = written(_verified(likely, sets), "similar")
    done_with(pairs, likely, sets)
    return links


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the row of the least doc_id of each group that similar pairs join; all columns stay.

    Texts without a word are copies of each other, as are texts of the same shingles.  Null ids come last.
    """
    small_batches(docs.sparkSession)
    order, own = (free_name(docs.columns, x) for x in ("order", "own"))
    marked = written(_marked(docs, text, own).withColumn(order, row_order(doc_id)), "marked")
    mark = F.col(own)
    classes = marked.groupBy(mark["node"].alias("node")).agg(F.min(order).alias("least"), F.first(mark["n"]).alias("n"), F.first(mark["prefix"]).alias("prefix"), F.first(mark["bits"]).alias("bits"), F.first(mark["fp"]).alias("fp"))
    classes = written(classes, "classes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        leads = classes.join(nodes, "node", "left_semi").select("node", "least")
        texts = marked.select(mark["node"].alias("node"), F.col(order).alias("least"), raw_text(text).alias("raw"))
        return _sets(texts.join(leads, ["node", "least"], "left_semi").groupBy("node").agg(F.first("raw").alias("raw")))

    roots = written(rooted(similar_links(classes, sets_of)), "roots")
    named = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("least", "node")).alias("w"))
    winners = written(named.select(F.col("w.least").alias(order), F.col("w.node").alias("node")), "winners")
    done_with(classes)
    won = marked.withColumn(own, mark["node"]).join(winners.withColumnRenamed("node", own), [order, own])
    return won.dropDuplicates([order, own]).select(docs.columns)
