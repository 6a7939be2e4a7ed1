"""Ranked lexical search: a document-partitioned index, searched by short lists first and by documents then.

The index is a table.  A shard holds some documents (about SHARD_BYTES of text): a row of their ids and lengths, and
a row for each term with its documents and counts.  Shards are searched apart from each other with the corpus
counts of the whole index, and the best of all shards are ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from hourspark.llm.common import give_back, raw_text, small_batches, written

SHARD_BYTES = 8 << 20
TOP = 20
BLOCK_ITEMS, BLOCK_TERMS = 1_024, 1 << 20  # items searched at a time, and their terms, about
BLOCK_BYTES = 8 << 20  # of distinct terms that are broadcast
LONG_SHARE = 16  # a list of over 1/16 of the shard's documents is long
WALKED = 512  # documents scored at a step

# Terms are runs of digits, letters and anything beyond ASCII; A-Z is lowered, all else is a separator.
_SEPARATOR = 0
_TERM_BYTES = np.array([b | 0x20 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _SEPARATOR for b in range(256)], np.uint8)


def _terms(raws: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts one after the other, and how many each text has."""
    data = _TERM_BYTES[np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)]
    held = data != _SEPARATOR
    edges = np.flatnonzero(np.diff(held.view(np.int8), prepend=0))  # the last byte is a separator: starts and ends in turn
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    closed = np.cumsum([len(r) + 1 for r in raws])
    counts = np.diff(np.searchsorted(starts, closed), prepend=0)
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[held])]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers), counts


def _shard(raws: list[bytes]) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """(terms, documents of each, counts of each, terms in each document); documents by place."""
    flat, counts = _terms(raws)
    coded = flat.dictionary_encode()
    size = max(1, len(raws))
    keys = np.sort(coded.indices.to_numpy().astype(np.int64) * size + np.repeat(np.arange(len(raws)), counts))
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    term, doc = np.divmod(keys[at], size)
    offsets = pa.array(np.searchsorted(term, np.arange(len(coded.dictionary) + 1)).astype(np.int32))
    lists = (pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (doc, np.diff(at, append=len(keys))))
    return coded.dictionary.cast(pa.binary()), *lists, counts


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``docs``: shard, term, docs, tfs, ids.

    The row without a term has all the shard's documents as ``docs``, their lengths in terms as ``tfs``, and
    their ids.  Texts go whole into a shard, however long they are; a null text has no terms.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"shard long, term binary, docs array<int>, tfs array<int>, ids array<{id_type}>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32  # type: ignore[union-attr]
        raws: list[bytes] = []
        ids: list = []
        kind = pa.int64()

        def rows() -> pa.RecordBatch:
            terms, lists, tfs, counts = _shard(raws)
            whole = pa.array([np.arange(len(raws), dtype=np.int32)]), pa.array([counts.astype(np.int32)])
            columns = [
                pa.array(np.full(len(terms) + 1, shard)), pa.concat_arrays([pa.array([None], pa.binary()), terms]),
                pa.concat_arrays([whole[0], lists]), pa.concat_arrays([whole[1], tfs]),
                pa.concat_arrays([pa.array([ids], pa.list_(kind)), pa.nulls(len(terms), pa.list_(kind))]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["shard", "term", "docs", "tfs", "ids"])

        for batch in batches:
            kind = batch.column("id").type
            for own, raw in zip(batch.column("id").to_pylist(), batch.column("raw").to_pylist()):
                raws.append(raw or b"")
                ids.append(own)
            if sum(map(len, raws)) > shard_bytes:
                yield rows()
                shard, raws, ids = shard + 1, [], []
                give_back()
        if raws:
            yield rows()

    return docs.select(F.col(doc_id).alias("id"), raw_text(text).alias("raw")).mapInArrow(build, schema)


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(row, item, terms, counts, n) of each item that has a term."""
    kind = items.schema[item_id].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, own, raw in zip(batch["row"], batch["item"], batch["raw"]):
                names, times = np.unique(np.array(_terms([raw or b""])[0].to_pylist(), object), return_counts=True)
                rows.append((row, own, list(names), times, len(names)))
            yield pd.DataFrame(rows, columns=["row", "item", "terms", "counts", "n"])

    own = items.select(F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("item"), raw_text(text).alias("raw"))
    return own.mapInPandas(cut, f"row long, item {kind}, terms array<binary>, counts array<long>, n int").where("n > 0")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """The lists of one shard's terms as (documents, parts of the score), documents ascending."""

    def __init__(self, lists: dict[int, tuple[np.ndarray, np.ndarray]], lengths: np.ndarray, order: np.ndarray, weights: dict[int, int], documents: int, terms: int):
        scale = 12 * (75 + (25 * lengths.astype(np.int64) * documents) // max(terms, 1))
        self.size, self.order = len(lengths), order
        self.lists = {}
        for t, (docs, tfs) in lists.items():
            tfs = tfs.astype(np.int64)
            self.lists[t] = docs, weights[t] * ((1_000_000_000 * tfs) // (1000 * tfs + scale[docs]))
        self.most = {t: int(part.max()) for t, (_, part) in self.lists.items()}

    def best(self, query: dict[int, int], top: int = TOP) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents scored over long lists) of the ``top`` best, by score and then ``order``.

        Short lists are summed into accumulators.  These are then one more list, bounded by their largest sum,
        beside the long lists: documents are walked in order, those that lie only in lists whose bounds add up
        to less than the score of the last of the best so far are skipped.
        """
        held = [t for t in query if t in self.lists]
        long = [t for t in held if len(self.lists[t][0]) * LONG_SHARE > self.size]
        sums = np.zeros(self.size, np.int64)
        for t in held:
            if t not in long:
                docs, part = self.lists[t]
                sums[docs] += query[t] * part
        summed = np.flatnonzero(sums)
        walks = [(query[t] * self.most[t], self.lists[t][0], query[t] * self.lists[t][1]) for t in long]
        if len(summed):
            walks.append((int(sums.max()), summed, sums[summed]))
        walks.sort(key=lambda w: w[0])
        bounds = np.cumsum([w[0] for w in walks])  # of the least lists together
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = int(np.partition(sums[summed], -top)[-top]) if len(summed) >= top else 1
        at, walked = 0, 0
        while at < self.size:
            skipped = int(np.searchsorted(bounds, least))  # these lists alone cannot reach ``least``
            ahead = [w[1][np.searchsorted(w[1], at) :][:WALKED] for w in walks[skipped:]]
            if not any(map(len, ahead)):
                break
            end = min(int(a[-1]) + 1 if len(a) == WALKED else self.size for a in ahead)
            here = np.unique(np.concatenate([a[: np.searchsorted(a, end)] for a in ahead]))
            total = np.zeros(len(here), np.int64)
            for k in range(len(walks) - 1, -1, -1):
                if k < skipped:  # only documents that can still reach ``least`` are looked up
                    open_ = total + bounds[k] >= least
                    here, total = here[open_], total[open_]
                _, own, part = walks[k]
                place = np.minimum(np.searchsorted(own, here), len(own) - 1)
                total += np.where(own[place] == here, part[place], 0)
            walked += len(here)
            docs, scores = np.concatenate([docs, here]), np.concatenate([scores, total])
            first = np.lexsort((self.order[docs], -scores))[:top]
            docs, scores = docs[first], scores[first]
            if len(scores) == top:
                least = max(least, int(scores[-1]))
            at = end
        return docs[scores > 0], scores[scores > 0], walked


def _id_order(ids: list) -> np.ndarray:
    """Places of ids in ascending order, null last; equal ids have equal places."""
    known = {v: k for k, v in enumerate(sorted({v for v in ids if v is not None}))}
    return np.array([known.get(v, len(known)) for v in ids], np.int64)


def _block(indexed: DataFrame, items: list[Row], documents: int, terms: int, top: int, schema: str) -> DataFrame:
    """The best of each shard for a bounded number of items."""
    spark = indexed.sparkSession
    names = {name: t for t, name in enumerate(dict.fromkeys(bytes(x) for i in items for x in i.terms))}
    known = spark.createDataFrame([(bytearray(n), t) for n, t in names.items()], "term binary, t int")
    if sum(map(len, names)) <= BLOCK_BYTES:  # else the index is dealt by term
        known = F.broadcast(known)
    whole = indexed.where("term IS NULL").withColumn("t", F.lit(None).cast("int"))
    met = written(indexed.join(known, "term").unionByName(whole).drop("term"), "met")
    counted = met.where("t IS NOT NULL").groupBy("t").agg(F.sum(F.size("docs").cast("long")).alias("df")).collect()  # bounded by the block
    queries = [(i.row, i.item, {names[bytes(x)]: n for x, n in zip(i.terms, i.counts)}) for i in items]
    shared = spark.sparkContext.broadcast((queries, {r.t: weight(documents, r.df) for r in counted}))
    columns = [c.split()[0] for c in schema.split(", ")]

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        asked, weights = shared.value
        head = rows[rows["t"].isna()].iloc[0]
        lists = {int(t): (d, f) for t, d, f in zip(rows["t"], rows["docs"], rows["tfs"]) if not pd.isna(t)}
        ids = list(head["ids"])
        shard = Shard(lists, np.asarray(head["tfs"]), _id_order([None if pd.isna(v) else v for v in ids]), weights, documents, terms)
        out = []
        for row, item, query in asked:
            docs, scores, _ = shard.best(query, top)
            out.extend((row, item, ids[d], int(s)) for d, s in zip(docs, scores))
        return pd.DataFrame(out, columns=columns)

    return met.groupBy("shard").applyInPandas(search, schema)


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each row of ``items``, of score above 0.

    Equal scores rank by ascending doc_id, null ids last.  Null and empty texts, of items or documents, match
    nothing; repeated rows are documents, or items, of their own.  Empty tables give no rows.  Extra columns are
    not read.
    """
    return search(written(index(docs, doc_id, text, shard_bytes), "index"), items, item_id, item_text, top)


def search(indexed: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """``ranked`` on a written ``index``.  Items go in blocks of bounded size, the corpus is not read again."""
    heads = indexed.where("term IS NULL").select(F.expr("aggregate(tfs, 0L, (a, x) -> a + IF(x > 0, 1L, 0L))").alias("d"), F.expr("aggregate(tfs, 0L, (a, x) -> a + x)").alias("t"))
    documents, terms = heads.agg(F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    asked = written(_item_terms(items, item_id, item_text), "items")
    many, held = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-many // BLOCK_ITEMS), -(-held // BLOCK_TERMS))
    kinds = indexed.schema["ids"].dataType.elementType.simpleString(), asked.schema["item"].dataType.simpleString()
    schema = f"row long, item {kinds[1]}, doc {kinds[0]}, score long"
    found = []
    for k in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).orderBy("row").collect()  # one block
        if some:
            found.append(written(_block(indexed, some, documents, terms, top, schema), "found"))
    if not found:
        found = [indexed.sparkSession.createDataFrame([], schema)]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
    first = whole.withColumn("rank", place).where(F.col("rank") <= top)
    return first.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")
