"""Exact copies by composable polynomial fingerprints, settled by comparing chunk with chunk.

A text is a number written in a large base, taken modulo two primes.  Chunks are hashed wherever they lie, and the
fingerprint of a whole text is the sum of its chunks' hashes, each shifted by the bytes that follow the chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.llm.common import free_name, raw_text, small_batches, written

CHUNK_BYTES = 1 << 16  # a longer text is hashed and compared in several rows
MODULI = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 1_664_525_013)
STEP = 4_096  # bytes to a matrix row: 255 * 2^31 * 4096 < 2^53, so float products are exact
HELD_BYTES = 4 << 20  # chunks in an Arrow batch, about


@lru_cache
def _powers(moduli: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the bases: of the places in a matrix row, as (STEP, 2), and one row's shift."""
    places = [[pow(b, STEP - 1 - k, m) for b, m in zip(BASES, moduli)] for k in range(STEP)]
    return np.array(places, np.float64), np.array([pow(b, STEP, m) for b, m in zip(BASES, moduli)], np.int64)


def chunk_hash(raw: bytes, rest: int = 0, moduli: tuple[int, int] = MODULI) -> tuple[int, int]:
    """The two residues of ``raw`` followed by ``rest`` bytes of zero."""
    places, step = _powers(moduli)
    if len(raw) <= STEP:
        sums = np.frombuffer(raw, np.uint8).astype(np.float64) @ places[STEP - len(raw) :]
        value = [int(v) for v in sums]
    else:
        padded = np.zeros(-(-len(raw) // STEP) * STEP, np.uint8)
        padded[len(padded) - len(raw) :] = np.frombuffer(raw, np.uint8)
        value = [0, 0]
        for sums in padded.reshape(-1, STEP).astype(np.float64) @ places:
            value = [(v * int(s) + int(x)) % m for v, s, x, m in zip(value, step, sums, moduli)]
    return tuple(v * pow(b, rest, m) % m for v, b, m in zip(value, BASES, moduli))  # type: ignore[return-value]


def _chunks(rows: DataFrame, id_type: str) -> DataFrame:
    """(row, id, n, at, sha, chunk) of (row, id, raw): texts with A-Z lowered, cut; the digest is at chunk 0."""
    schema = f"row long, id {id_type}, n long, at long, sha string, chunk binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, None

        def batch() -> pa.RecordBatch:
            names = ["row", "id", "n", "at", "sha", "chunk"]
            kinds = [pa.int64(), kind, pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

        for got in batches:
            kind = got.schema.field("id").type
            for row, own, raw in zip(*(got.column(c).to_pylist() for c in ("row", "id", "raw"))):
                low = (raw or b"").lower()
                for at in range(max(1, -(-len(low) // CHUNK_BYTES))):
                    chunk = low[at * CHUNK_BYTES : (at + 1) * CHUNK_BYTES]
                    held.append((row, own, len(low), at, hashlib.sha256(low).hexdigest() if at == 0 else None, chunk))
                    size += len(chunk) + 200
                    if size > HELD_BYTES:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()

    return rows.mapInArrow(cut, schema)


def _prints(chunks: DataFrame, moduli: tuple[int, int]) -> DataFrame:
    """(row, id, n, sha, x, y): the fingerprint of every text, its chunks' shifted hashes added up."""

    @F.pandas_udf("x long, y long")
    def hashes(chunk: pd.Series, rest: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([chunk_hash(c, r, moduli) for c, r in zip(chunk, rest)], columns=["x", "y"])

    rest = F.greatest(F.col("n") - (F.col("at") + 1) * CHUNK_BYTES, F.lit(0))
    short = chunks.where(F.col("n") <= CHUNK_BYTES)
    long = chunks.where(F.col("n") > CHUNK_BYTES).repartition("row", "at")  # one text's chunks go to many tasks
    told = short.unionByName(long).select("row", "id", "n", "sha", hashes("chunk", rest).alias("h"))
    sums = [(F.sum(f"h.{c}") % m).alias(c) for c, m in zip("xy", moduli)]
    return told.groupBy("row").agg(F.max("id").alias("id"), F.max("n").alias("n"), F.max("sha").alias("sha"), *sums)


def _members(prints: DataFrame) -> DataFrame:
    """(row, ref) of rows that share length and fingerprint with ``ref``, the row of the largest id; without ``ref``."""
    same = ["n", "x", "y"]
    groups = prints.groupBy(*same).agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("id", "row")).alias("top")).where("size > 1")
    met = prints.join(groups.select(*same, F.col("top.row").alias("ref")), same)
    return met.where("row <> ref").select("row", "ref")


def _differing(chunks: DataFrame, members: DataFrame) -> DataFrame:
    """Members with a chunk that is not the one of their ``ref``: compared row by row, a chunk at a time."""
    parts = chunks.select("row", "at", "chunk")
    own = parts.join(members, "row").select("row", "ref", "at", "chunk")
    refs = members.select(F.col("ref").alias("row")).distinct().join(parts, "row")
    refs = refs.select(F.col("row").alias("ref"), "at", F.col("chunk").alias("other"))
    return own.join(refs, ["ref", "at"]).where("chunk <> other").select("row").distinct()


def _told(rows: DataFrame, id_type: str, moduli: tuple[int, int]) -> DataFrame:
    """(row, id, sha, ref, size) of (row, id, raw)."""
    chunks = written(_chunks(rows, id_type), "chunks")
    prints = written(_prints(chunks, moduli), "prints")
    settled, left = None, prints
    while True:
        members = written(_members(left), "members")
        apart = written(_differing(chunks, members), "apart")
        sure = members.join(apart, "row", "left_anti")
        settled = sure if settled is None else settled.unionByName(sure)
        if apart.isEmpty():
            break
        left = written(prints.join(apart, "row", "left_semi"), "left")  # texts of one fingerprint that differ
    settled = written(settled, "settled")
    sizes = settled.groupBy("ref").agg((F.count(F.lit(1)) + 1).alias("size"))
    kept = prints.select(F.col("row").alias("ref"), F.col("id").alias("keep_id")).join(sizes, "ref", "left")
    classes = prints.join(settled, "row", "left").withColumn("ref", F.coalesce("ref", "row"))
    return classes.join(kept, "ref").select("row", "id", "sha", "ref", "keep_id", F.coalesce("size", F.lit(1)).alias("size"))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", moduli: tuple[int, int] = MODULI) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is an empty text.  Of equal texts the row of the
    largest doc_id stays (null ids are smallest; among rows of one id any one).  Texts of one fingerprint are equal
    only if all their chunks are; others form groups of their own.  An empty table gives no rows, other columns
    are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), raw_text(text).alias("raw"))
    told = _told(rows, docs.schema[doc_id].dataType.simpleString(), moduli)
    return told.select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("ref")).alias("kept"), F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``copies`` keeps, with all their columns."""
    small_batches(docs.sparkSession)
    row = free_name(docs.columns, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(row).alias("row"), F.col(doc_id).alias("id"), raw_text(text).alias("raw"))
    told = _told(rows, docs.schema[doc_id].dataType.simpleString(), MODULI)
    return numbered.join(told.where("row = ref").select(F.col("row").alias(row)), row, "left_semi").select(docs.columns)
