"""Spelling variants: words one edit apart, found through a variable-length gram index.

The dictionary of grams is pruned by frequency: a gram of more than ``list_words`` words is replaced by its
extensions, up to the longest length.  A word (between two marks) has at each place the shortest gram that is not
replaced, so a gram depends on its own characters alone.  An edit at one place affects only the grams that cover
it; all others are in both words, at the same distance from the start or from the end.  For each place a word looks
into the list of its rarest unaffected gram; if even that list is long, into the merge of all unaffected grams' lists.
Words one edit apart meet there, and every meeting is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourspark.llm.common import give_back, raw_text, small_batches, written

SHORTEST, LONGEST = 2, 6  # grams, marks included
LIST_WORDS = 32  # a gram in more words is extended
DICTIONARY = 1 << 20  # frequent grams at most: the limit of a list grows with the vocabulary beyond that
HELD = 150_000  # counts a worker holds before it hands them on
WORDS_AT_ONCE, WORDS_A_TASK = 10_000, 50_000
FEWEST_CHARS, FEWEST_COUNT, RATIO, EVERY = 7, 2, 10, 31
START, END = "<", ">"
_NONE = (1 << 62, 0, 0)  # no gram: not rare
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RUN = re.compile(f"[a-zÀ-ÿ]{{{FEWEST_CHARS},}}")


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough, with one character of some runs left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for own, raw in zip(batch.column("id").to_pylist(), batch.column("raw").to_pylist()):
                seed = zlib.crc32(f"{'' if own is None else own}:".encode())
                for run, n in Counter(_RUN.findall((raw or b"").lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % EVERY == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < FEWEST_CHARS:
                            continue
                    held[run] += n
                if len(held) > HELD:
                    yield told()
                    held.clear()
                    give_back()
        yield told()

    runs = docs.select(F.col(doc_id).alias("id"), raw_text(text).alias("raw")).mapInArrow(count, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST_COUNT)


def _positions(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For every place of the marked words, one after the other: places left in its word, and the hash of the gram
    of each length from SHORTEST that begins there (of no meaning where the word is too short)."""
    codes = np.frombuffer("".join([f"{START}{w}{END}" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    hashed, out = codes + np.uint64(1), []
    for q in range(2, LONGEST + 1):
        hashed = hashed * _MULTIPLIER + np.concatenate([codes[q - 1 :], np.zeros(min(q - 1, len(codes)), np.uint64)])
        hashed ^= hashed >> np.uint64(29)
        if q >= SHORTEST:
            out.append(hashed)
    return sizes, left, out


def dictionary(vocabulary: DataFrame, list_words: int = LIST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of more than ``list_words`` words (more, if they were more than DICTIONARY in all),
    ascending, with their numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, left, hashed = _positions(batch.column("word").to_pylist())
            grams = [h[left >= q] for q, h in enumerate(hashed, SHORTEST)]
            names, counts = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], ["gram", "f"])

    spark = vocabulary.sparkSession
    small_batches(spark, WORDS_AT_ONCE)
    grams = vocabulary.select("word").mapInArrow(count, "gram long, f long").groupBy("gram").agg(F.sum("f").alias("f"))
    grams = written(grams.where(F.col("f") > list_words), "grams")
    every = grams.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    limit = max(list_words, every // DICTIONARY)  # fewer than DICTIONARY grams can have more than this
    kept = grams.where(F.col("f") > limit).toArrow()
    names, counts = (kept.column(c).to_numpy() for c in ("gram", "f"))
    order = np.argsort(names.view(np.uint64))
    return names.view(np.uint64)[order], counts[order]


def _grams(words: list[str], frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes of the marked words; length, hash and number of the gram at each place, length 0 at the last place);
    the number is 0 for a gram that few words have."""
    names, counts = frequent
    sizes, left, hashed = _positions(words)
    length, own, number = np.zeros(len(left), np.int64), np.zeros(len(left), np.uint64), np.zeros(len(left), np.int64)
    grows = left >= SHORTEST
    for q, h in enumerate(hashed, SHORTEST):
        here = np.flatnonzero(grows & (left >= q))
        at = np.minimum(np.searchsorted(names, h[here]), max(0, len(names) - 1))
        found = np.where(names[at] == h[here], counts[at], 0) if len(names) else np.zeros(len(here), np.int64)
        length[here], own[here], number[here] = q, h[here], found
        grows = np.zeros(len(left), bool)
        grows[here[found > 0]] = True
    return sizes, length, own, number


_MASK = (1 << 64) - 1


def _mixed(*parts: int) -> int:
    out = 0
    for part in parts:
        out = (out ^ part) * int(_MULTIPLIER) & _MASK
        out ^= out >> 31
    return out


def keys_of(words: list[str], frequent: tuple[np.ndarray, np.ndarray]) -> list[set[int]]:
    """The lists each word looks into, one for each place of an edit.

    ``p`` is a place of the marked word that is replaced or left out (``rest`` is the length without it) or the
    place before which a character is put in.  Two words one edit apart have a place in common for which the
    unaffected grams are the same, so that they choose the same list.
    """
    sizes, *columns = _grams(words, frequent)
    lengths, hashes, numbers = (c.tolist() for c in columns)
    out, base = [], 0
    for size in sizes.tolist():
        ends: list[list[tuple]] = [[] for _ in range(size + LONGEST)]
        # Of the grams that end before p, and of those that begin at p or after it: the rarest, and a hash of all.
        left, right = [(_NONE, 0)], [(_NONE, 0)] * (size + 1)
        for a in range(size - SHORTEST, -1, -1):
            number, gram = numbers[base + a], hashes[base + a]
            ends[a + lengths[base + a] - 1].append((number, gram, _mixed(gram, a, 1)))
            best, merged = right[a + 1]
            right[a] = min(best, (number, gram, _mixed(gram, size - a, 2))), _mixed(gram, merged)
        for p in range(size):
            best, merged = left[-1]
            for g in ends[p]:
                best, merged = min(best, g), _mixed(g[2], merged)
            left.append((best, merged))
        keys = set()
        for inserted in (0, 1):
            for p in range(1, size - 1 + inserted):
                (before, all_before), (after, all_after) = left[p], right[p + 1 - inserted]
                rarest = min(before, after)
                keys.add(_mixed(p, size - 3 + inserted, all_before, all_after) if rarest[0] else rarest[2])
        out.append(keys)
        base += size
    return out


def near_pairs(vocabulary: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """(a, na, b, nb), a < b: all pairs of ``vocabulary`` (distinct word, n) one edit apart, once each."""
    spark = vocabulary.sparkSession
    frequent = spark.sparkContext.broadcast(dictionary(vocabulary, list_words))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch.column("word").to_pylist(), frequent.value)
            place = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            flat = np.array([k for some in keys for k in some], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column("word").take(place), batch.column("n").take(place)], ["key", "word", "n"])

    parts = -(-vocabulary.count() // WORDS_A_TASK) or 1  # a small table, but each word takes a while
    lists = written(vocabulary.repartition(parts, "word").mapInArrow(look, "key long, word string, n long"), "lists")
    one, other = (lists.select("key", F.col("word").alias(x), F.col("n").alias(f"n{x}"), F.length("word").alias(f"l{x}")) for x in "ab")
    may = (F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= 1)
    met = one.join(other.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & may & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "na", "b", "nb").distinct()


def variants(vocabulary: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``vocabulary`` (distinct word, n).

    A word's form is its near word of largest n (ties: smallest in code-point order) if that has at least RATIO
    times its n.  Chains of forms are short: n grows tenfold at each step.
    """
    pairs = written(near_pairs(vocabulary, list_words), "near")
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), (-F.col("nb")).alias("m"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), (-F.col("na")).alias("m"), F.col("a").alias("near"))))
    best = pairs.select(both.alias("e")).select("e.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("m", "near")).alias("best"))
    told = vocabulary.join(best, "word", "left").withColumn("formed", -F.col("best.m") >= RATIO * F.col("n"))
    told = written(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("IF(formed, best.near, NULL)").alias("form"), F.expr("IF(formed, -best.m, NULL)").alias("form_n")), "forms")
    forms = told.where("form IS NOT NULL").select("word", "form")
    steps = forms.select(F.col("word").alias("at"), F.col("form").alias("to"))
    roots = written(forms.withColumnRenamed("form", "at"), "roots")
    while not roots.join(steps, "at", "left_semi").isEmpty():
        roots = written(roots.join(steps, "at", "left").select("word", F.coalesce("to", "at").alias("at")), "roots")
    out = told.join(roots.withColumnRenamed("at", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of ``docs`` with their more frequent spellings.

    Null and empty texts have no words; a null doc_id counts as empty in the checksum.  Repeated rows count
    again; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    return variants(written(words(docs, doc_id, text), "words"))
