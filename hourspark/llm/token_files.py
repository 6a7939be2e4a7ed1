"""Token ids as binary files: global counts, one canonical Huffman code, independent blocks.

A file set is a folder with two Parquet tables, so that Spark's committers make every write safe to retry:

* ``codes``: id, count, bits.  The canonical code follows from the bits alone.
* ``blocks``: rows of whole documents in ascending order of doc_id: start (ids of all documents before the
  block), doc_ids, n_tokens, checkpoints (little-endian uint32 bit offsets of every 64th id) and stream.
  Folder ``part=p`` holds the p-th range of doc_ids.  Any block is decoded without any other.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourspark.llm.common import done_with, give_back, row_order, small_batches, written
from hourspark.llm.huffman import Code, code_lengths

BLOCK_IDS = 65_536  # a block is closed by the document that reaches this
KNOWN_WORDS = 1_000_000  # words whose ids a worker remembers before it forgets the rarer half

# Marks (but for the apostrophe) after a plain letter and before a blank or the end are tokens of their own,
# whatever the word is.
_OWN_MARK, _APART = r"([a-zà-öø-ÿ])([!-&(-/:-@\[-`{-~]+)([ \n]|$)", r"\1 \2\3"
_SPECIAL, _MARK = "<|", "|"


class WordEncoder:
    """Ids of whole texts, a word at a time.

    Holds for tokenizers that lower-case, drop white space and never merge across it: a text's ids are then
    those of its words (cut at spaces and line feeds), one after the other, and each word is encoded once.
    Texts with a special token's opening ``<|`` are encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread keeps memory of its own
        self.model, self.end_id = Tokenizer.from_file(path), end_id
        self.size_of_vocabulary = max(self.model.get_vocab_size(), end_id + 1)
        self.wide = self.size_of_vocabulary > 1 << 16
        self.mark = self.ids_of(_MARK)
        self.start_anew()

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def start_anew(self) -> None:
        self.known: dict[str, int] = {}
        self.used = np.zeros(1 << 14, np.int32)  # batches that held the word, halved whenever words are forgotten
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.filled = 0
        self.put(["", "\n"], np.array([self.end_id]), np.array([0, 1]))  # the latter is no word: words hold no line feed

    def forget(self) -> None:
        """Keep the half of the words that most batches held."""
        n = len(self.known)
        used = self.used[:n].copy()
        used[:2] = np.iinfo(np.int32).max
        kept = np.sort(np.argpartition(-used, KNOWN_WORDS // 2)[: KNOWN_WORDS // 2])
        keep = np.zeros(n, bool)
        keep[kept] = True
        words, sizes, used = list(compress(self.known, keep)), self.size[kept].astype(np.int64), used[kept] // 2
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[kept] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        self.start_anew()
        self.put(words[2:], ids[int(sizes[:2].sum()) :], sizes[2:])
        self.used[2 : len(words)] = used[2:]

    def put(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember words, whose ids follow one another in ``ids``."""
        ends = self.filled + np.cumsum(sizes)
        first, n, end = len(self.known), len(words), int(ends[-1])
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), end), np.uint32)])
        if first + n > len(self.start):
            self.start, self.size, self.used = (np.concatenate([x, np.zeros(max(len(x), n), x.dtype)]) for x in (self.start, self.size, self.used))
        self.flat[self.filled : end] = ids
        self.start[first : first + n], self.size[first : first + n] = ends - sizes, sizes
        self.filled = end
        self.known.update(zip(words, range(first, first + n), strict=True))

    def learn(self, words: list[str]) -> None:
        """Many words are encoded as one text, with a mark that none of them holds between them."""
        joined = [w for w in words if _MARK not in w] if len(self.mark) == 1 else []
        for k in range(0, len(joined), 2_000):
            some = joined[k : k + 2_000]
            ids = self.ids_of(f" {_MARK} ".join(some))
            marks = np.nonzero(ids == self.mark[0])[0]
            self.put(some, np.delete(ids, marks), np.diff(marks, prepend=-1, append=len(ids)) - 1)
        for word in words if len(self.mark) != 1 else (w for w in words if _MARK in w):
            self.learn_whole(word, word)

    def learn_whole(self, word: str, text: str) -> None:
        ids = self.ids_of(text)
        self.put([word], ids, np.array([len(ids)]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, end ids included, and the number of each text's.

        Cutting and counting distinct words is Arrow's; Python sees each distinct word of a batch once.
        """
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, _SPECIAL)
        lowered = pc.replace_substring(pc.replace_substring_regex(pc.ascii_lower(texts), _OWN_MARK, _APART), "\n", " ")
        if pc.any(special).as_py():  # such a text is one word, told from others by a leading line feed
            lowered = pc.if_else(special, pc.binary_join_element_wise("\n", texts, ""), lowered)
            split = pa.array([[x] if x.startswith("\n") else x.split(" ") for x in lowered.to_pylist()], pa.list_(pa.string()))
        else:
            split = pc.split_pattern(lowered, " ")
        words = pc.list_flatten(split).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() goes by way of scalars
        new = [w for w in distinct if w not in self.known]
        self.learn([w for w in new if not w.startswith("\n")])
        for whole in (w for w in new if w.startswith("\n")):
            self.learn_whole(whole, whole[1:])
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        self.used[place] += 1
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts)
        which = np.insert(place[words.indices.to_numpy(zero_copy_only=False)], ends, self.known["\n"])
        size = self.size[which].astype(np.int64)
        upto = np.cumsum(size)
        at = np.repeat(self.start[which] - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)
        per_text = np.diff(upto[ends + np.arange(len(ends))], prepend=0)
        return self.flat[at], per_text


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}
_TOKENS = pa.schema([
    ("part", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()),
])
_TOKENS_SCHEMA = "part int, at long, doc_id long, n_tokens long, ids binary, counts binary"


def _tokenized(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows of (part, at, doc_id, n_tokens, ids): at counts the ids before the text within its sorted part.

    A task's last row has its counts of all ids instead: as many numbers as the vocabulary has ids.
    """
    encoder = _ENCODERS.setdefault((tokenizer, end_id), None) or WordEncoder(tokenizer, end_id)
    _ENCODERS[tokenizer, end_id] = encoder
    part, at, total = TaskContext.get().partitionId(), 0, np.zeros(encoder.size_of_vocabulary, np.int64)
    for batch in batches:
        ids, sizes = encoder.encode(batch.column("text"))
        total += np.bincount(ids, minlength=len(total))
        stops = np.cumsum(sizes)
        starts = stops - sizes
        width = 4 if encoder.wide else 2
        raw = ids.astype("<u4" if encoder.wide else "<u2").tobytes()
        packed = pa.array([raw[a * width : b * width] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary())
        columns = [pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + starts), batch.column("doc_id"), pa.array(sizes), packed]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(sizes), pa.binary())], _TOKENS.names)
        at += int(sizes.sum())
        give_back()
    if at:
        row = [part, None, None, None, None, total.astype("<i8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TOKENS.types, strict=True)], schema=_TOKENS)


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of all rows that this task reads, once each, with their counts added up."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column("counts"):
            more = np.frombuffer(raw.as_buffer(), "<i8")
            total = total + more if len(total) else more
    used = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "count"])


_BLOCKS = pa.schema([
    ("part", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
    ("checkpoints", pa.binary()), ("stream", pa.binary()),
])
_BLOCK_SCHEMA = "part int, start long, doc_ids array<long>, n_tokens array<long>, checkpoints binary, stream binary"


def _blocked(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Neighbouring documents of a part, packed into blocks."""
    code, open_, size = Code(bits), [], 0

    def block() -> pa.RecordBatch:
        stream, marks = code.pack(np.concatenate([x[3] for x in open_]))
        row = (open_[0][0], open_[0][1], [x[2] for x in open_], [len(x[3]) for x in open_], marks.astype("<u4").tobytes(), stream)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCKS.types, strict=True)], schema=_BLOCKS)

    for batch in batches:
        for part, start, doc_id, n, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "doc_id", "n_tokens", "ids")), strict=True):
            joins = open_ and open_[-1][0] == part and open_[-1][1] + len(open_[-1][3]) == start
            if open_ and (not joins or size >= BLOCK_IDS):
                yield block()
                open_, size = [], 0
            open_.append((part, start, doc_id, _numbers(raw, n)))
            size += n
    if open_:
        yield block()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all rows of ``docs`` as a file set.

    A null text is empty (its end id alone); null ids come last; rows of equal id follow by text, repeated
    rows one by one; an empty table makes an empty file set.  Other columns are not read.  The code is fitted to
    the counts of all ids: as many numbers as the vocabulary has ids reach the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(row_order(doc_id).alias("o"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("o").sortWithinPartitions("o", "text").select("doc_id", "text")
    rows_and_counts = written(ordered.mapInArrow(lambda b: _tokenized(b, tokenizer, end_id), _TOKENS_SCHEMA), "tokens")
    tokens = rows_and_counts.where("n_tokens IS NOT NULL")
    counted = rows_and_counts.select("counts").where("counts IS NOT NULL")
    counts = counted.mapInArrow(_counted, "id int, count long").groupBy("id").agg(F.sum("count").alias("count"))
    found = counts.toPandas()
    total = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    total[found["id"]] = found["count"]
    bits = code_lengths(total)
    used = np.nonzero(bits)[0]
    table = [(int(i), int(total[i]), int(bits[i])) for i in used]
    spark.createDataFrame(table, "id int, count long, bits int").coalesce(1).write.parquet(os.path.join(folder, "codes"))
    # one row a part, so the running sum and the broadcast hold as many rows as the range sort has parts
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = tokens.join(F.broadcast(parts.select("part", before.alias("before"))), "part").select("part", (F.col("before") + F.col("at")).alias("start"), "doc_id", "n_tokens", "ids")
    placed.mapInArrow(lambda b: _blocked(b, bits), _BLOCK_SCHEMA).write.partitionBy("part").parquet(os.path.join(folder, "blocks"))
    done_with(rows_and_counts)


def read_codes(spark: SparkSession, folder: str) -> Code:
    rows = spark.read.parquet(os.path.join(folder, "codes")).select("id", "bits").toPandas()
    bits = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.uint8)
    bits[rows["id"]] = rows["bits"]
    return Code(bits)


def _read(batches: Iterator[pa.RecordBatch], bits: np.ndarray, with_ids: bool) -> Iterator[pa.RecordBatch]:
    code = Code(bits)
    for batch in batches:
        for start, doc_ids, sizes, marks, stream in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_ids", "n_tokens", "checkpoints", "stream")), strict=True):
            ids = code.unpack(stream, np.frombuffer(marks, "<u4"), sum(sizes)).astype("<u4")
            stops = np.cumsum(sizes)
            pieces = [ids[b - n : b].tobytes() for b, n in zip(stops.tolist(), sizes, strict=True)]
            columns = [pa.array(doc_ids, pa.int64()), pa.array(start + stops - np.array(sizes)), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of a file set: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (little-endian uint32)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    bits = read_codes(spark, folder).lengths
    blocks = spark.read.schema("start long, doc_ids array<long>, n_tokens array<long>, checkpoints binary, stream binary").parquet(os.path.join(folder, "blocks"))
    small_batches(spark)
    return blocks.mapInArrow(lambda b: _read(b, bits, with_ids), schema)
