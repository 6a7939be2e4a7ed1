"""Benchmark decontamination by latent semantic retrieval.

Items and all passages of all documents make a TF-IDF matrix over the items' words; how often two words share a
passage is counted, so the matrix itself is never held.  The items' own directions and those of a distributed randomised SVD make the latent space,
so that no item loses a part of its vector.  Every document is walked in half
overlapping windows, one of which holds any passage as long as an item; windows whose latent cosine with an item
is high are candidates, which a longest common subsequence of words confirms.  Items with an answer also catch looser paraphrases that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourspark.llm.common import done_with, raw_text, small_batches, written

SIMILARITY = 0.8  # common subsequence as a part of the item
PARAPHRASE = 0.5  # the same for a passage that holds the item's answer
COSINE = 0.25  # of a window, which may be twice the item or more
HELD = 0.5  # part of the item's latent length that a candidate has along it
HELD_WITH_ANSWER = 0.3  # the same where a looser paraphrase counts
RANK = 128  # directions of the SVD; those of the items come on top
OVERSAMPLING = 10
POWER_STEPS = 2
ITEM_BLOCK = 256  # items of one index; more items are searched in so many rounds
PASSAGE_WORDS = 48  # the latent space is fitted on all texts, cut into passages of this length
FIT_PARTS = 8  # more where a part would hold over CELLS numbers
CELLS = 1 << 24  # numbers that a task counts pairs of words in
PAIRS_AT_ONCE = 1 << 20
FEWEST_WORDS = 8  # an item with fewer must be found whole
CHUNK = 32_768
BASE_STEP = 16  # words; longer steps double it
FREQUENT = 0.2  # words in a larger part of all documents are left out of the latent space
FEWEST_RARE = 4  # but not those of an item with fewer other words

_LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and any characters beyond ASCII."""
    return (raw or b"").translate(_LETTERS).split()


def common_words(masks: dict[int, int], size: int, ids: list[int]) -> int:
    """Length of the longest common subsequence with an item, whose word places are bit masks."""
    row = full = (1 << size) - 1
    for i in ids:
        hit = row & masks.get(i, 0)
        row = (row + hit | row - hit) & full
    return size - row.bit_count()


@dataclass
class Space:
    vocabulary: dict[bytes, int]  # from 1; 0 is any other word
    latent: np.ndarray  # (word, dimension), row 0 zero
    items: list[tuple[int, list[int], set[int]]]  # name, words, answer's words

    def __post_init__(self) -> None:
        self.masks, vectors = [], []
        for _, ids, _ in self.items:
            mask: dict[int, int] = {}
            for k, i in enumerate(ids):
                mask[i] = mask.get(i, 0) | 1 << k
            self.masks.append(mask)
            vectors.append(self.latent[ids].sum(axis=0))
        units = np.array(vectors, np.float32).reshape(len(self.items), -1)
        sizes = np.linalg.norm(units, axis=1)
        units /= np.maximum(sizes, 1e-12)[:, None]
        # the items' own directions come first: beyond them the units hold rounding errors only
        self.reach = 1 + int(np.nonzero((np.abs(units) > 1e-5).any(axis=0))[0].max(initial=0))
        held = sizes * np.array([HELD_WITH_ANSWER if end else HELD for _, _, end in self.items])
        self.heavy = self.latent.any(axis=1)
        self.member = np.zeros((len(self.items), len(self.latent)), bool)
        for k, (_, ids, _) in enumerate(self.items):
            self.member[k, ids] = True
        self.least = np.array([0.9 * self.needed(k) if not end else min(0.9 * self.needed(k), PARAPHRASE * len(ids)) for k, (_, ids, end) in enumerate(self.items)])
        # an item is sought in windows of two steps, each step at least as long as the item: one window holds it whole
        steps = [BASE_STEP << max(0, (len(ids) - 1) // BASE_STEP).bit_length() for _, ids, _ in self.items]
        self.scales = [(step, mine := np.nonzero(np.array(steps) == step)[0], np.ascontiguousarray(units[mine, : self.reach].T), held[mine]) for step in sorted(set(steps))]

    def needed(self, k: int) -> int:
        size = len(self.items[k][1])
        return max(-int(-SIMILARITY * size // 1), min(size, FEWEST_WORDS))

    def candidates(self, ids: np.ndarray) -> set[tuple[int, int, int]]:
        """(item, window start, window length) with a high latent cosine."""
        out = set()
        longest = self.scales[-1][0] if self.scales else BASE_STEP
        chunk = -(-CHUNK // longest) * longest
        for begin in range(0, len(ids), chunk):
            part = ids[begin : begin + chunk + longest]
            at = np.nonzero(self.heavy[part])[0]
            cells = at // BASE_STEP
            heads = np.nonzero(np.diff(cells, prepend=-1))[0]
            sums = np.zeros((-(-len(part) // BASE_STEP), self.latent.shape[1]), np.float32)
            if len(heads):
                sums[cells[heads]] = np.add.reduceat(self.latent[part[at]], heads, axis=0)
            width = BASE_STEP
            for step, mine, units, held in self.scales:
                while width < step:
                    sums = np.concatenate([sums, np.zeros((len(sums) % 2, sums.shape[1]), np.float32)])
                    sums, width = sums[::2] + sums[1::2], width * 2
                windows = sums.copy()
                windows[:-1] += sums[1:]
                limit = COSINE * np.maximum(np.linalg.norm(windows, axis=1), 1e-9)
                along = windows[:, : self.reach] @ units
                w, i = np.nonzero((along >= limit[:, None]) & (along >= held[None, :]))
                # a window without most of the item's words cannot pass
                padded = np.concatenate([part, np.zeros(2 * step, part.dtype)])
                shared = self.member[mine[i][:, None], padded[w[:, None] * step + np.arange(2 * step)]].sum(axis=1)
                w, i = w[shared >= self.least[mine[i]]], i[shared >= self.least[mine[i]]]
                out.update(zip(mine[i].tolist(), (begin + w * step).tolist(), repeat(2 * step), strict=False))
        return out

    def matches(self, ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, float, str]]:
        """(document, item, place, similarity, kind) of the documents that end at ``bounds`` in the stream of ids."""
        best: dict[tuple[int, int], tuple] = {}
        stream = ids.tolist()
        for item, start, length in sorted(self.candidates(ids)):
            name, words, answer = self.items[item]
            # a window over borders belongs to every document that it touches
            first, last = (int(np.searchsorted(bounds, x, side="right")) for x in (start, min(start + length, len(ids)) - 1))
            for doc in range(first, last + 1):
                lo, hi = int(bounds[doc - 1]) if doc else 0, int(bounds[doc])
                reach = len(words) // 4
                a, b = max(lo, start - reach), min(hi, start + length + reach)
                common = common_words(self.masks[item], len(words), stream[a:b])
                if common >= self.needed(item):
                    kind = "copy"
                elif answer and common >= max(PARAPHRASE * len(words), FEWEST_WORDS) and answer <= set(stream[a:b]):
                    kind = "paraphrase"
                else:
                    continue
                row = (common / len(words), -a, kind)
                if row > best.get((doc, item), (-1.0,)):
                    best[doc, item] = row
        return [(doc, self.items[item][0], -at, share, kind) for (doc, item), (share, at, kind) in sorted(best.items())]


def _fitted(rows: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix whose words share passages as ``rows`` (id, counts) tell.

    A randomised range finder; every pass is a Spark job: tasks multiply their rows and return one matrix each,
    FIT_PARTS of them or a few more, whose size follows the vocabulary of one block of items and not the corpus.
    """
    n_words = len(idf) - 1
    width = min(RANK + OVERSAMPLING, n_words)
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((n_words, width)))[0]
    for last in [*[False] * POWER_STEPS, True]:

        def product(batches: Iterator[pa.RecordBatch], q: np.ndarray = basis, last: bool = last) -> Iterator[pa.RecordBatch]:
            total, weighted = np.zeros((width, width) if last else (n_words, width)), q * idf[1:, None]
            for batch in batches:
                ids = batch.column("id").to_numpy()
                counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i8").reshape(-1, n_words)
                image = idf[ids, None] * (counts @ weighted)
                if last:
                    total += q[ids - 1].T @ image
                else:
                    total[ids - 1] += image
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        shape = (width, width) if last else (n_words, width)
        total = sum((np.frombuffer(r["m"]).reshape(shape) for r in rows.mapInArrow(product, "m binary").collect()), np.zeros(shape))
        if last:
            values, turn = np.linalg.eigh(total)
            return basis @ turn[:, np.argsort(-values)[: min(RANK, width)]]
        basis = np.linalg.qr(total)[0]
    raise AssertionError


def _with_items(directions: np.ndarray, items: list[list[int]], idf: np.ndarray) -> np.ndarray:
    """An orthonormal basis that holds the TF-IDF vectors of the items (word ids from 1) and ``directions``."""
    own = np.zeros((len(directions), len(items)))
    for k, ids in enumerate(items):
        np.add.at(own[:, k], np.array(ids) - 1, idf[ids])
    return np.linalg.qr(np.concatenate([own / np.maximum(np.linalg.norm(own, axis=0), 1e-12), directions], axis=1))[0]


def _passages(docs: DataFrame, text: str, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, DataFrame]:
    """Document frequencies (place 0: documents) over all texts, and the word ids of all passages.

    A row of the latter holds passages of several texts: their words of the vocabulary, and how many each has.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = np.zeros(len(vocabulary) + 1, np.int64), np.zeros(len(vocabulary) + 1, bool)
        for batch in batches:
            rows, sizes = [], []
            for raw in batch.column("raw").to_pylist():
                words = words_of(raw)
                ids = np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words))
                at = np.flatnonzero(ids)
                rows.append(ids[at])
                sizes.append(np.bincount(at // PASSAGE_WORDS))
                held[rows[-1]] = True
                seen += held
                held[rows[-1]] = False
            seen[0] += batch.num_rows
            row = [b"".join(x.astype("<i4").tobytes() for x in part) for part in (rows, sizes)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([x], pa.binary()) for x in row)], ["id", "n", "ids", "sizes"])
        used = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used]), *[pa.nulls(len(used), pa.binary())] * 2], ["id", "n", "ids", "sizes"])

    found = docs.select(raw_text(text).alias("raw")).mapInArrow(walk, "id long, n long, ids binary, sizes binary")
    found = written(found, "passages")
    counted = found.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocabulary) + 1)
    df[counted["id"]] = counted["n"]
    return df, found.where("ids IS NOT NULL").select("ids", "sizes"), found


def _together(passages: DataFrame, used: np.ndarray) -> DataFrame:
    """(id, counts): how often the word ``id`` and each other one share a passage, repeats included, as 64-bit integers.

    Only words marked in ``used`` count.  A task counts a band of at most CELLS pairs of words at a time.
    """
    n_words = len(used) - 1
    height = max(1, CELLS // n_words)
    parts = max(FIT_PARTS, -(-n_words // height))

    def rows(ids: np.ndarray, totals: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(ids), 64):
            some = [x.astype("<i8").tobytes() for x in totals[k : k + 64]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 64], pa.int64()), pa.array(some, pa.binary())], ["id", "counts"])

    def counted(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
        total = np.zeros((high - low, n_words), np.int64)
        for batch in batches:
            for raw, lengths in zip(batch.column("ids").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                ids, sizes = np.frombuffer(raw, "<i4").astype(np.int64), np.frombuffer(lengths, "<i4").astype(np.int64)
                keep, owner = used[ids], np.repeat(np.arange(len(sizes)), sizes)
                ids, sizes = ids[keep], np.bincount(owner[keep], minlength=len(sizes))
                first, size = (np.repeat(x, sizes) for x in (np.cumsum(sizes) - sizes, sizes))
                mine = np.flatnonzero((ids > low) & (ids <= high))
                upto = np.cumsum(size[mine])
                for part in np.split(mine, np.searchsorted(upto, range(PAIRS_AT_ONCE, int(upto[-1]) if len(upto) else 0, PAIRS_AT_ONCE))):
                    n = size[part]
                    other = ids[np.repeat(first[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                    np.add.at(total.reshape(-1), np.repeat(ids[part] - 1 - low, n) * n_words + other - 1, 1)
        some = np.flatnonzero(total.any(axis=1))
        yield from rows(some + 1 + low, [total[i] for i in some])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                totals[i] = totals.get(i, 0) + np.frombuffer(raw, "<i8")
        ids = np.array(sorted(totals), np.int64)
        yield from rows(ids, [totals[i] for i in ids.tolist()])

    def band(low: int) -> DataFrame:
        return passages.mapInArrow(lambda b: counted(b, low, min(low + height, n_words)), "id long, counts binary")

    bands = reduce(DataFrame.unionByName, map(band, range(0, n_words, height)))
    return bands.repartition(parts, "id").mapInArrow(summed, "id long, counts binary")


def spaces(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None) -> list[Space]:
    """One latent space for each block of about ITEM_BLOCK items.  Items without a word are left out."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_id).alias("name"), raw_text(item_text).alias("raw"), (raw_text(answer) if answer else F.lit(None).cast("binary")).alias("answer"))
    items = written(items.distinct().withColumn("block", F.xxhash64("raw", "name")), "items")
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    out = []
    for block in range(blocks):
        mine = items.where(F.pmod("block", F.lit(blocks)) == block).orderBy("name", "raw").collect()
        split = [(r["name"], words_of(r["raw"]), words_of(r["answer"])) for r in mine]
        split = [x for x in split if x[1]]
        if not split:
            continue
        vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, words, end in split for w in [*words, *end]}))}
        df, passages, found = _passages(docs, text, vocabulary)
        idf = np.log((1 + df[0]) / (1 + df) + 0.1)
        spared = {i for _, words, _ in split if sum(df[vocabulary[w]] <= FREQUENT * df[0] for w in words) < FEWEST_RARE for i in (vocabulary[w] for w in words)}
        idf[[i for i in range(1, len(df)) if df[i] > FREQUENT * df[0] and i not in spared]] = 0
        own = [[vocabulary[w] for w in words] for _, words, _ in split]
        whole = [(np.array(ids, "<i4").tobytes(), np.array([len(ids)], "<i4").tobytes()) for ids in own]
        passages = spark.createDataFrame(whole, "ids binary, sizes binary").coalesce(1).unionByName(passages)
        rows = written(_together(passages, idf != 0), "fit")
        done_with(found)
        basis = _with_items(_fitted(rows, idf), own, idf)
        done_with(rows)
        latent = np.zeros((len(vocabulary) + 1, basis.shape[1]), np.float32)
        latent[1:] = basis * idf[1:, None]
        out.append(Space(vocabulary, latent, [(n, [vocabulary[w] for w in words], {vocabulary[w] for w in end}) for n, words, end in split]))
    return out


_MATCHES = "array<struct<item_id: long, at: long, similarity: double, kind: string>>"


def matches(space: Space, spark, text: str = "text") -> Column:  # type: ignore[no-untyped-def]
    """The items that a text holds; null and empty texts hold none."""
    shared = spark.sparkContext.broadcast(space)  # bounded by ITEM_BLOCK items

    @F.pandas_udf(_MATCHES)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = shared.value
        for batch in batches:
            words = [words_of(x) for x in batch]
            bounds = np.cumsum([len(w) for w in words])
            ids = np.fromiter((i for w in words for i in map(s.vocabulary.get, w, repeat(0))), np.int64, int(bounds[-1]) if len(bounds) else 0)
            out: list[list] = [[] for _ in words]
            for doc, name, at, share, kind in s.matches(ids, bounds):
                out[doc].append({"item_id": name, "at": at - (int(bounds[doc - 1]) if doc else 0), "similarity": share, "kind": kind})
            yield pd.Series(out)

    return find(raw_text(text))


def _all_matches(docs: DataFrame, benchmark: DataFrame, text: str, **names: str | None) -> Column:
    found = [matches(s, docs.sparkSession, text) for s in spaces(docs, benchmark, text, **names)]
    return F.concat(*found) if found else F.array().cast(_MATCHES)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names: str | None) -> DataFrame:
    """A row (doc_id, item_id, at, similarity, kind) for each benchmark item that a row of ``docs`` holds.

    at: the word the searched passage starts at; similarity: common subsequence as a part of the item.  Repeated
    rows give repeated rows; an empty side gives none; other columns are not read.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), _all_matches(docs, benchmark, text, **names).alias("m"))
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names: str | None) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    return docs.where(F.size(_all_matches(docs, benchmark, text, **names)) == 0)
