"""Words of whole texts as 64-bit hashes, vectorised over a batch of Arrow strings."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cuewright.llm.common import splitmix

#: Separators of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All ASCII that is neither letter nor digit separates; bytes of other characters belong to words.
PUNCT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONG = 64
STEP = np.uint64(0x9E3779B97F4A7C15)


def slices(column: pa.Array, most_bytes: int = 1_000_000):
    """(first row, bytes, offsets) of runs of rows of about most_bytes, without a copy of the column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + most_bytes, "right")) - 1)
        to = min(to, len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1].astype(np.int64) - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
    """Starts and ends of the words, and the first word of each row, with the end as the last entry."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    cut = edges[(edges > 0) & (edges < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span."""
    length = ends - starts
    h = length.astype(np.uint64) * STEP
    live = np.flatnonzero(length <= LONG)
    size, at, own = length[live], starts[live], np.zeros(len(live), np.uint64)
    k, rows = 0, np.arange(len(live))
    while len(rows):
        own[rows] = own[rows] * np.uint64(0x100000001B3) + low[at[rows] + k] + np.uint64(1)
        k += 1
        rows = rows[size[rows] > k]
    h[live] += own
    h = splitmix(h)
    for i in np.flatnonzero(length > LONG):
        h[i] = int.from_bytes(blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
    """(hash of each lower-cased (A-Z) word, first word of each row, with the end as the last entry)."""
    starts, ends, bounds = word_spans(data, offsets, separators)
    return span_hashes(LOWER[data], starts, ends), bounds


def gathered(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs pool[at : at + n], one after the other."""
    total = np.cumsum(n)
    return pool[np.repeat(at - total + n, n) + np.arange(total[-1] if len(total) else 0)]


class Lexicon:
    """Runs of numbers by word, where words are known by a 64-bit hash: what a vocabulary makes of each word. Holds `most`
    words and 8 times as many numbers at most; one batch's words are always held whole."""

    def __init__(self, dtype, most: int = 600_000):
        self.dtype, self.most = np.dtype(dtype), most
        self.clear()

    def clear(self) -> None:
        self.key, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def runs(self, h: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, compute) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and length of the run of each word. compute maps a list of words (bytes) to their runs, as
        bytes of the numbers."""
        if len(self.key) > self.most or self.used > 8 * self.most:
            self.clear()
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        where = np.searchsorted(self.key, own)
        known = self.key[np.minimum(where, len(self.key) - 1)] == own if len(self.key) else np.zeros(len(own), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw, a, b = low.tobytes(), starts[first[new]].tolist(), ends[first[new]].tolist()
            made = compute([raw[i:j] for i, j in zip(a, b, strict=True)])
            n = np.fromiter(map(len, made), np.int64, len(made)) // self.dtype.itemsize
            found = np.frombuffer(b"".join(made), self.dtype)
            if self.used + len(found) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(found), self.dtype)])
            self.pool[self.used : self.used + len(found)] = found
            at = self.used + np.cumsum(n) - n
            self.used += len(found)
            spot = where[new]
            self.key, self.at, self.n = np.insert(self.key, spot, own[new]), np.insert(self.at, spot, at), np.insert(self.n, spot, n)
            where = np.searchsorted(self.key, own)
        return self.at[where][back], self.n[where][back]


def windows(h: np.ndarray, bounds: np.ndarray, n: int):
    """Hashes of all windows of n words that lie in one row, and the first window of each row."""
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    if not count.sum():
        return np.zeros(0, np.uint64), np.zeros(len(count) + 1, np.int64)
    x = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        x = x * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(x)]
    keep = np.zeros(len(x) + 1, np.int32)
    np.add.at(keep, bounds[:-1][count > 0], 1)
    np.add.at(keep, (bounds[:-1] + count)[count > 0], -1)
    return splitmix(x[np.cumsum(keep[:-1]) > 0]), np.concatenate([[0], np.cumsum(count)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles; a shorter text with words is one shingle."""
    h, bounds = word_hashes(data, offsets)
    x, at = windows(h, bounds, n)
    out = []
    for i in range(len(offsets) - 1):
        if at[i + 1] > at[i]:
            out.append(np.unique(x[at[i] : at[i + 1]]))
        elif bounds[i + 1] > bounds[i]:
            own = h[bounds[i] : bounds[i + 1]].tobytes()
            out.append(np.frombuffer(blake2b(own, digest_size=8, salt=b"short").digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
