"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.llm.common import free_name, raw_text, row_order, small_batches, written
from hourspark.llm.components import rooted

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
# A block with more distinct fingerprints is searched by one-bit variants instead of by pairs; both are exact.
PAIRED_BLOCK = 64


def fingerprint(raw: bytes | None, words_in: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included; 0 without a word."""
    words = (raw or b"").lower().split()  # bytes.lower() touches A-Z only
    if not words:
        return 0
    runs = [b" ".join(words)] if len(words) < words_in else map(b" ".join, zip(*(words[k:] for k in range(words_in))))
    n = max(1, len(words) - words_in + 1)
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), runs), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The signed 64 bits that are set in over half of the unsigned ``hashes``; 0 without any."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        bits = np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint_column(text: str | Column = "text") -> Column:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(x) for x in batch], dtype="int64")

    return prints(raw_text(text))


def _masks(distance: int) -> list[int]:
    """Bits to agree on: 64 bits cut into ``distance + 3`` blocks, of which any three are kept.

    At most ``distance`` blocks hold a differing bit, so a close pair agrees on three whole blocks of the rest.
    """
    blocks = distance + 3
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    whole = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return [signed(sum(kept)) for kept in combinations(whole, 3)]


def close_links(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links ``(a, b)`` that join all fingerprints ``fp`` (distinct longs) within ``distance`` bits.

    Fingerprints meet in a block (agreed bits) and are verified by Hamming distance.  In a block of at most
    PAIRED_BLOCK fingerprints every close pair is a link.  In a fuller one no pairs are made (``distance`` is 2
    there): each fingerprint goes to itself and its one-bit variants among the block's free bits; two within two
    bits meet at a variant within one bit of both, at most as many as free bits meet there, and all of them link
    to the least.  So no close pair is left unconnected, and no link exceeds the distance.
    """
    masks = _masks(distance)
    deal = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for k, m in enumerate(masks))))
    dealt = prints.select("fp", deal.alias("k")).select("fp", "k.*")
    sizes = written(dealt.groupBy("c", "block").count().where("count > 1"), "blocks")
    met = written(dealt.join(sizes, ["c", "block"]), "met")
    few, many = met.where(F.col("count") <= PAIRED_BLOCK), met.where(F.col("count") > PAIRED_BLOCK)
    left, right = few.select("c", "block", F.col("fp").alias("a")), few.select("c", "block", F.col("fp").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right, ["c", "block"]).where((F.col("a") < F.col("b")) & (apart <= distance)).select("a", "b")
    if distance != 2:
        if many.limit(1).count():
            raise ValueError("blocks of many fingerprints are searched for two differing bits only")
        return pairs.distinct()
    bit = lambda k: (1 << k) - (1 << 64) if k == 63 else 1 << k
    free = F.element_at(F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(bit(b)).cast("long") for b in range(64) if not (m >> b) & 1)) for m in masks)), F.col("c") + 1)
    near = many.select("c", "fp", F.explode(free).alias("flip")).select("c", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    meeting = near.groupBy("c", "v").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = meeting.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def _classes(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, least, root) of the fingerprints of ``rows`` (doc_id, fp): least id, and root of the component."""
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = written(rooted(close_links(classes.select("fp"), distance)), "roots")
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id.

    Null and empty texts have fingerprint 0 and are linked like any other; copies share a fingerprint and meet
    once.  component_id is the component's least doc_id, null only if all its ids are null.  Repeated rows give
    repeated rows, an empty table none; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(text).alias("fp")), "prints")
    classes = _classes(rows, distance)
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(classes.join(named, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the row of the least doc_id of each near-duplicate group; all columns stay.

    Rows that repeat that id within a group count as its copies: one of them stays.  Null ids come last.
    """
    small_batches(docs.sparkSession)
    order, own = (free_name(docs.columns, x) for x in ("order", "own"))
    marked = written(docs.withColumns({order: row_order(doc_id), own: fingerprint_column(text)}), "marked")
    classes = _classes(marked.select(F.col(doc_id).alias("doc_id"), F.col(own).alias("fp")), MAX_DISTANCE)
    least = classes.groupBy("root").agg(F.min(F.struct(row_order("least").alias("o"), "fp")).alias("w"))
    winners = written(least.select(F.col("w.o").alias(order), F.col("w.fp").alias(own)), "winners")
    return marked.join(winners, [order, own]).dropDuplicates([order, own]).select(docs.columns)
