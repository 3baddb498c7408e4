"""Byte-level word kernel: splits and hashes the words of whole Arrow string columns with numpy.

UTF-8 makes the word classes used here byte classes: a multi-byte character consists of bytes of 128 and more only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
PLACE = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Upper bounds of the text bytes (a single longer text is handled whole) and rows handled in one numpy step.
SLICE_BYTES, SLICE_ROWS = 1 << 18, 1024

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """hash: per word; first: index of each text's first word, with one more entry at the end; start, end: byte places
    in data (lower-cased, if so asked)."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def byte_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of whole texts: (from row, to row, bytes, offsets in them). Null reads as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for base in range(0, len(column), SLICE_ROWS):
        part = column.slice(base, SLICE_ROWS).cast(pa.large_string()).fill_null("")
        at = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        raw = part.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(part):
            to = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
            to = min(to, len(part))
            yield base + row, base + to, data[at[row] : at[to]], at[row : to + 1] - at[row]
            row = to


def row_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of SLICE_ROWS rows, so that what is handed on of it is small at a time."""
    for base in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(base, SLICE_ROWS)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of every span, by prefix sums of a polynomial over random byte values."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * _power(_BASE_INV, n + 1)[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = is_word[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    start = np.flatnonzero(inside & (begins | ~before))
    end = np.flatnonzero(before & (begins | ~inside))
    return Words(hash_spans(data, start, end), np.searchsorted(start, offsets), start, end, data)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of k words inside a text; a text of 1 to k-1 words is one run."""
    first, h = words.first, words.hash
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(h)) - first[text]
    parts = np.zeros(len(h), np.uint64)
    short = (count < k)[text]
    for j in range(k):
        m = len(h) - j
        if m <= 0:
            break
        same = text[:m] == text[j:]
        parts[:m] += np.where(same, h[j:] * PLACE[j], np.uint64(0))
    keep = np.where(short, place == 0, place <= count[text] - k)
    return mix(parts[keep]), text[keep]


def distinct_sets(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, hash) pairs, sorted by text and then hash."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], t[new]


class WordNumbers:
    """Numbers, from 0, of the distinct words (by hash) that a Python worker has met, up to a number of words and of their
    bytes: what is kept per word is worked out once, and looked up by number. Hashes are held in two sorted arrays, the
    later one of recent words, at 16 bytes a word."""

    RECENT = 1 << 15

    def __init__(self, most_words: int = 700_000, most_bytes: int = 1 << 23):
        self.most_words, self.most_bytes = most_words, most_bytes
        self.clear()

    def clear(self) -> None:
        self.sorted = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        self.used = self.bytes = 0

    def full(self) -> bool:
        """Whether to start anew before the next slice; a slice itself is always taken whole."""
        return self.used > self.most_words or self.bytes > self.most_bytes

    def _add(self, which: int, hashes: np.ndarray, numbers: np.ndarray) -> None:
        h, n = (np.concatenate(x) for x in zip(self.sorted[which], (hashes, numbers), strict=True))
        order = np.argsort(h, kind="stable")
        self.sorted[which] = (h[order], n[order])

    def find(self, words: Words) -> tuple[np.ndarray, list[str]]:
        """(the number of every word, the new words in the order of their numbers)."""
        distinct, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        number = np.full(len(distinct), -1, np.int64)
        for hashes, numbers in self.sorted:
            if len(hashes):
                place = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
                known = hashes[place] == distinct
                number[known] = numbers[place[known]]
        fresh = np.flatnonzero(number < 0)
        number[fresh] = np.arange(self.used, self.used + len(fresh))
        self.used += len(fresh)
        self._add(1, distinct[fresh], number[fresh])
        if len(self.sorted[1][0]) > self.RECENT:
            self._add(0, *self.sorted[1])
            self.sorted[1] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        raw = words.data.tobytes()
        new = [raw[a:b].decode() for a, b in zip(words.start[at[fresh]].tolist(), words.end[at[fresh]].tolist(), strict=True)]
        self.bytes += int((words.end[at[fresh]] - words.start[at[fresh]]).sum())
        return number[back], new


class Growing:
    """A numpy array of rows that grows at its end."""

    def __init__(self, width: tuple[int, ...], dtype: type):
        self.rows, self.used = np.zeros((1024, *width), dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.used + len(more) > len(self.rows):
            size = max(2 * len(self.rows), self.used + len(more))
            self.rows = np.concatenate([self.rows[: self.used], np.zeros((size - self.used, *self.rows.shape[1:]), self.rows.dtype)])
        self.rows[self.used : self.used + len(more)] = more
        self.used += len(more)


_holder: list = []


def hold_only(cache) -> None:
    """Clears the cache that another operator has left in this Python worker: one is held at a time."""
    if _holder and _holder[0] is not cache:
        _holder[0].clear()
    _holder[:] = [cache]
