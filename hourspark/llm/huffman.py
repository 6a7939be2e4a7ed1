"""Canonical, length-limited Huffman codes over small integers, packed and unpacked with numpy."""

from __future__ import annotations

import numpy as np

MAX_BITS = 18  # 32 - 7 at most: a code and its bit offset must fit a 32-bit window
LANE = 64  # ids between two bit-offset checkpoints


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths up to ``limit`` for each symbol; 0 where its count is 0 (package-merge)."""
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    levels, row = [], np.zeros(0)
    for _ in range(limit):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        row = np.concatenate([weights, pairs])
        order = np.argsort(row, kind="stable")
        levels.append(order < len(weights))
        row = row[order]
    take, depth = 2 * len(used) - 2, np.zeros(len(used), np.uint8)
    for single in reversed(levels):
        singles = int(single[:take].sum())
        depth[:singles] += 1
        take = 2 * (take - singles)
    lengths[used] = depth
    return lengths


class Code:
    """The canonical code of given lengths: shorter first, equal lengths by symbol."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        used = np.nonzero(lengths)[0]
        used = used[np.lexsort((used, lengths[used]))]
        self.bits = int(lengths.max(initial=1))
        room = np.int64(1) << (self.bits - lengths[used].astype(np.int64))
        first = np.cumsum(room) - room  # codes, left-aligned to the longest
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[used] = (first >> (self.bits - lengths[used].astype(np.int64))).astype(np.uint64)
        entry = used.astype(np.uint32) << np.uint32(5) | lengths[used].astype(np.uint32)
        self.table = np.zeros(1 << self.bits, np.uint32)
        self.table[: int(room.sum())] = np.repeat(entry, room)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream, and the bit offset of every LANE-th id."""
        if not len(ids):
            return b"", np.zeros(0, np.uint32)
        size = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        if not size.all():
            raise ValueError("an id has no code")
        word = starts >> 5
        value = self.codes[ids] << (64 - (starts & 31) - size).astype(np.uint64)
        head = np.nonzero(np.diff(word, prepend=-1))[0]
        out = np.zeros(int(word[-1]) + 2, np.uint32)
        out[word[head]] = np.bitwise_or.reduceat(value >> np.uint64(32), head)
        out[word[head] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), head).astype(np.uint32)
        return out.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], starts[::LANE].astype(np.uint32)

    def unpack(self, stream: bytes, checkpoints: np.ndarray, n_ids: int) -> np.ndarray:
        """The ids of a stream; all lanes between checkpoints advance together, one table look-up an id."""
        if not n_ids:
            return np.zeros(0, np.uint32)
        raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        at, last = checkpoints.astype(np.int64), len(window) - 1
        out = np.empty((LANE, len(at)), np.uint32)
        for k in range(LANE):
            peek = window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32) >> np.uint32(32 - self.bits)
            entry = self.table[peek]
            out[k] = entry >> np.uint32(5)
            at += entry & np.uint32(31)
        return out.T.ravel()[:n_ids]
