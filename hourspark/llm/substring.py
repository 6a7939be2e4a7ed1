"""Substring dedup by relative Lempel-Ziv factors over seeded references.

Every text is parsed against all text that comes earlier.  The reference index is dealt over the cluster in
blocks of seed hashes.  Seeds are minimizers: the least hashed 8-word run of each 20-word window, so equal
windows always hold an equal seed at the same place.  A document's seeds are looked up in all blocks; a run of
seeds that points along one earlier text, with equal words between them (compared by segment hash), is a factor.
Windows inside a factor are duplicates.  Windows at factor boundaries, and those of first occurrences, are the
only ones that are compared one by one, by a 128-bit hash.  The earliest occurrence of a window is never inside
a factor (its factor would be an earlier occurrence), so that comparison always sees it and the result is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.llm.common import done_with, raw_text, row_order, small_batches, written

WINDOW = 20
SEED_WORDS = 8
KEPT_WORD_HASHES = 400_000  # entries of a worker's word-to-hash memory before it starts anew

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses modulo 2^64
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORD_HASHES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, seed=7)
        return value


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... at least ``n + 1`` of them."""
    known = _POWERS.get(base)
    if known is None or len(known) <= n:
        out = np.full(max(n + 1, 4096) * 2, base, np.uint64)
        out[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(out)
    return known


class Rolled:
    """Hashes of any run of a text's words, by position; ``words`` are the words' own hashes."""

    def __init__(self, words: np.ndarray, which: int = 0):
        n = len(words)
        own = _mixed(words) if which else words
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(own * _powers(_BASES[which], n)[:n], out=self.sums[1:])
        self.back = _powers(_INVERSES[which], n)

    def runs(self, size: int) -> np.ndarray:
        """The hash of the run of ``size`` words at each start."""
        count = max(0, len(self.sums) - size)
        return _mixed((self.sums[size:] - self.sums[:count]) * self.back[:count])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


_PLACE_BITS = 20


def minimizers(rolled: Rolled, window: int = WINDOW, seed: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each 8-word run, and for each window the place of its least one (the first of equals)."""
    grams = rolled.runs(seed)
    span = window - seed + 1
    if len(grams) < span:
        return grams, np.zeros(0, np.int64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    places = []
    step = (1 << _PLACE_BITS) - span
    for begin in range(0, len(grams) - span + 1, step):
        # the place fills the lowest bits, so that one minimum finds hash and place
        least = grams[begin : begin + step + span - 1] & ~low | np.arange(min(step + span - 1, len(grams) - begin), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < span:
            least = np.minimum(least[: width - span], least[span - width :])
        places.append((least & low).astype(np.int64) + begin)
    return grams, np.concatenate(places)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(lengths: list[int], columns: list[np.ndarray], names: list[str]) -> pa.ListArray:
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x) for x in columns], names))


def _joined(parts: list[tuple], types: list) -> list[np.ndarray]:
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(types)]


def _digests(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per text: number of words, sha256 of all words, seeds (hash, place, prefix sum)."""
    for batch in batches:
        n_words, shas, lengths, parts = [], [], [], []
        for raw in batch.column("raw").to_pylist():
            words = (raw or b"").split()
            n_words.append(len(words))
            shas.append(hashlib.sha256(b" ".join(words)).digest())
            if len(words) < window:
                lengths.append(0)
                continue
            rolled = Rolled(word_hashes(words))
            grams, at = minimizers(rolled, window)
            at = at[np.nonzero(np.diff(at, prepend=-1))[0]]  # places never fall
            lengths.append(len(at))
            parts.append((_signed(grams[at]), at.astype(np.int32), _signed(rolled.sums[at])))
        seeds = _lists(lengths, _joined(parts, [np.int64, np.int32, np.int64]), ["h", "pos", "sum"])
        columns = [*(batch.column(c) for c in ("o", "k", "key")), pa.array(n_words, pa.int64()), pa.array(shas, pa.binary()), seeds]
        yield pa.RecordBatch.from_arrays(columns, ["o", "k", "key", "n_words", "sha", "seeds"])


def factors(seeds: dict[str, np.ndarray], own: tuple[int, int], rolled: Rolled, seed: int = SEED_WORDS, window: int = WINDOW) -> np.ndarray:
    """Greedy factors of at least ``window`` words: rows (start, length, reference document, its key, its start).

    A factor grows from seed to seed while the next one points to the same earlier text at the same offset and
    the words between have equal hashes there and here.  Seeds that are the first occurrence of all start none.
    """
    earlier = ~((seeds["ro"] == own[0]) & (seeds["rk"] == own[1]) & (seeds["rpos"] == seeds["pos"]))
    s = {c: v[earlier] for c, v in seeds.items()}
    n = len(s["pos"])
    if not n:
        return np.zeros((0, 5), np.int64)
    step = lambda c: np.diff(s[c])
    back = _powers(_INVERSES[0], int(max(s["pos"].max(), s["rpos"].max())))
    here = step("sum") * back[s["pos"][:-1]]
    there = step("rsum") * back[s["rpos"][:-1]]
    grows = (step("ro") == 0) & (step("rk") == 0) & (step("rpos") == step("pos")) & (here == there)
    heads = np.nonzero(np.concatenate([[True], ~grows]))[0]
    tails = np.append(heads[1:], n) - 1
    rows = np.stack([s["pos"][heads], s["pos"][tails] + seed - s["pos"][heads], s["ro"][heads], s["rk"][heads], s["rpos"][heads]], axis=1)
    return rows[rows[:, 1] >= window]


def _structs(column: pa.ListArray) -> Iterator[dict[str, np.ndarray]]:
    """The fields of each row's list of structs, as arrays."""
    flat, ends = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False).cumsum()
    fields = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        yield {c: v[begin:end] for c, v in fields.items()}


def _parse(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per text: its factors, and the windows that must be compared one by one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        found, lengths, parts = [], [], []
        rows = zip(batch.column("o").to_pylist(), batch.column("k").to_pylist(), batch.column("raw").to_pylist(), _structs(batch.column("seeds")), strict=True)
        for order, k, raw, seeds in rows:
            words = word_hashes((raw or b"").split())
            rolled = Rolled(words)
            grams, at = minimizers(rolled, window)
            first = np.unique(seeds["pos"], return_index=True)[1]
            seeds = {c: v[first].view(np.uint64) if c in ("sum", "rsum") else v[first].astype(np.int64) for c, v in seeds.items()}
            mine = factors(seeds, (order, k), rolled, window=window)
            found.append(mine)
            again = np.zeros(len(grams), bool)
            again[seeds["pos"]] = True
            open_ = again[at]
            for start, length in mine[:, :2].tolist():
                open_[start : start + length - window + 1] = False
            pos = np.nonzero(open_)[0]
            lengths.append(len(pos))
            parts.append((pos.astype(np.int32), _signed(rolled.runs(window)[pos]), _signed(Rolled(words, 1).runs(window)[pos])))
        rows = np.concatenate(found)
        kinds = (np.int32, np.int32, np.int64, np.int64, np.int32)
        spans = _lists([len(x) for x in found], [rows[:, c].astype(t) for c, t in enumerate(kinds)], ["start", "length", "ro", "rk", "rstart"])
        windows = _lists(lengths, _joined(parts, [np.int32, np.int64, np.int64]), ["pos", "h1", "h2"])
        yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("k"), spans, windows], ["o", "k", "factors", "windows"])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    raw = raw_text(text)
    whole = F.coalesce(raw, F.lit(b""))
    return docs.select(row_order(doc_id).alias("o"), F.xxhash64(whole).alias("k"), raw.alias("raw"))


_FACTORS = "array<struct<start: int, length: int, ro: long, rk: long, rstart: int>>"


def duplicate_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, references: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(texts, spans)`` for all rows of ``docs``.

    texts: a row for each row, with o (row order of doc_id, nulls last), k (hash of the text), n_words, sha (of
    all words), copy (an equal text comes earlier).  spans: per (o, k) its ``factors`` (start, length in words,
    and the earlier text ro, rk, rstart they repeat) and ``singles``, the starts of further duplicate windows,
    with the earlier place of each if ``references``.  Copies of a whole text are one factor and only the first
    of them is parsed further.
    """
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, doc_id, text)
    with_key = keyed.withColumn("key", F.unhex(F.md5(F.coalesce("raw", F.lit(b"")))))
    texts = written(with_key.mapInArrow(lambda b: _digests(b, window), "o long, k long, key binary, n_words long, sha binary, seeds array<struct<h: long, pos: int, sum: long>>"), "texts")
    firsts = written(texts.groupBy("key").agg(F.min("o").alias("first")), "firsts")
    leads = texts.join(firsts, "key").where("o = first")
    repeated = written(leads.select(F.explode("seeds.h").alias("h")).groupBy("h").count().where("count > 1").select("h"), "repeated")
    seeds = written(leads.select("o", "k", F.explode("seeds").alias("s")).select("o", "k", "s.*").join(repeated, "h"), "seeds")
    marked = written(texts.join(firsts, "key").select("o", "k", "n_words", "sha", (F.col("o") > F.col("first")).alias("copy")), "marked")
    done_with(texts, firsts, repeated)
    place = F.struct(F.col("o").alias("ro"), F.col("k").alias("rk"), F.col("pos").alias("rpos"), F.col("sum").alias("rsum"))
    # First places are a table of their own, so that the join of a very common seed's rows can be split.
    blocks = written(seeds.groupBy("h").agg(F.min(place).alias("ref")), "first-places")
    looked = seeds.join(blocks, "h").select("o", "k", F.struct("pos", "sum", "ref.ro", "ref.rk", "ref.rpos", "ref.rsum").alias("s"))
    looked = written(looked.groupBy("o", "k").agg(F.collect_list("s").alias("seeds")), "looked")
    done_with(seeds, blocks)
    parsed = keyed.join(looked, ["o", "k"]).mapInArrow(lambda b: _parse(b, window), f"o long, k long, factors {_FACTORS}, windows array<struct<pos: int, h1: long, h2: long>>")
    parsed = written(parsed, "parsed")
    done_with(looked)
    alone = parsed.select("o", "k", F.explode("windows").alias("w")).select("o", "k", "w.*")
    place = F.struct(F.col("o").alias("ro"), F.col("k").alias("rk"), F.col("pos").alias("rstart"))
    met = written(alone.groupBy("h1", "h2").agg(F.min(place).alias("ref"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "ref.*"), "met")
    later = alone.join(met, ["h1", "h2"]).where("NOT (o = ro AND k = rk AND pos = rstart)")
    single = F.struct(F.col("pos").alias("start"), "ro", "rk", "rstart") if references else F.col("pos")
    singles = later.groupBy("o", "k").agg(F.collect_list(single).alias("singles"))
    spans = parsed.select("o", "k", "factors").join(singles, ["o", "k"], "left").where("size(factors) > 0 OR singles IS NOT NULL")
    spans = written(spans, "spans")
    done_with(parsed, met)
    return marked, spans


def _kept(batches: Iterator[pa.RecordBatch], window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        removed, out = [], []
        for raw, spans, singles in zip(batch.column("raw").to_pylist(), _structs(batch.column("spans")), batch.column("singles"), strict=True):
            words = (raw or b"").split()
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, spans["start"], 1)
            np.add.at(gone, spans["start"] + spans["length"], -1)
            if singles.is_valid:
                starts = singles.values.to_numpy(zero_copy_only=False)
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + window, -1)
            stays = np.cumsum(gone)[:-1] <= 0
            removed.append(len(words) - int(stays.sum()))
            rest = b" ".join(compress(words, stays.tolist()))
            out.append(rest if texts else hashlib.sha256(rest).digest())
        yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("k"), pa.array(removed, pa.int64()), pa.array(out, pa.binary())], ["o", "k", "n_removed", "kept"])


def _cut_out(docs: DataFrame, spans: DataFrame, doc_id: str, text: str, window: int, texts: bool) -> DataFrame:
    held = _keyed(docs, doc_id, text).join(spans.withColumnRenamed("factors", "spans"), ["o", "k"])
    return held.mapInArrow(lambda b: _kept(b, window, texts), "o long, k long, n_removed long, kept binary")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per (o, k) of the texts that lose some words but are no copy: n_removed and kept_text."""
    spans = duplicate_spans(docs, doc_id, text, window, references=False)[1]
    return _cut_out(docs, spans, doc_id, text, window, True).select("o", "k", "n_removed", F.col("kept").cast("string").alias("kept_text"))


def removal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: o (row order of doc_id), k, n_words, n_removed, kept_sha256.

    A null text has no words; a null id comes after all others; texts of equal ids are ordered by a hash of the
    text; rows that repeat both id and text are one document.  A text with fewer than ``window`` words keeps them
    all.  A copy of an earlier text loses all its words if it has a window.  Other columns are not read.
    """
    texts, spans = duplicate_spans(docs, doc_id, text, window, references=False)
    shaped = _cut_out(docs, spans, doc_id, text, window, False).groupBy("o", "k").agg(F.max("n_removed").alias("n_removed"), F.max("kept").alias("kept"))
    gone = F.col("copy") & (F.col("n_words") >= window)
    nothing = F.lit(hashlib.sha256(b"").digest())
    sha = F.when(gone, nothing).otherwise(F.coalesce("kept", "sha"))
    return texts.join(shaped, ["o", "k"], "left").select(
        "o", "k", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.lower(F.hex(sha)).alias("kept_sha256"),
    )
