"""Vectorised words of Arrow text columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. All work runs
over the column's UTF-8 buffer with numpy, a slice of about a megabyte at a
time, so memory follows the slice and not the length of a text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE, PLACES = 1 << 20, 64
_MASK = (1 << 64) - 1

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of 64-bit integers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


@lru_cache(maxsize=8)
def _table(seed: int) -> np.ndarray:
    """A random number for each byte value at each of the first ``PLACES`` places, as ``_at`` gives it."""
    place, byte = np.divmod(np.arange(PLACES * 256), 256)
    return _at(place, byte, seed)


def _at(place: np.ndarray, byte: np.ndarray, seed: int) -> np.ndarray:
    # no linear form in bytes or places, so that patterned texts don't collide
    return mix(_byte_values(seed)[byte] ^ mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)))


def _slices(starts: np.ndarray, ends: np.ndarray):
    """(i, j, place, at) of runs i..j, about ``SLICE`` bytes at a time: place of each byte in its run and in the data."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, side="right")))
        lengths = ends[i:j] - starts[i:j]
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
        yield i, j, lengths, first, place, place + np.repeat(starts[i:j], lengths)
        i = j


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, table: np.ndarray = IDENTITY) -> np.ndarray:
    """A 64-bit hash of each byte run ``data[starts[i]:ends[i]]``; runs are ordered and disjoint."""
    out = np.zeros(len(starts), np.uint64)
    known = _table(seed)
    for i, j, lengths, first, place, at in _slices(starts, ends):
        byte = table[data[at]]
        if int(lengths.max(initial=0)) <= PLACES:
            terms = known[(place << 8) | byte]
        else:
            far = place >= PLACES
            terms = known[(np.where(far, 0, place) << 8) | byte]
            terms[far] = _at(place[far], byte[far], seed)
        filled = lengths > 0
        sums = np.zeros(j - i, np.uint64)
        if filled.any():
            sums[filled] = np.add.reduceat(terms, first[filled])
        out[i:j] = mix(sums + lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return out


def same_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each run ``data[starts[i]:ends[i]]`` has the bytes ``other[begins[i]:begins[i] + lengths[i]]``."""
    out = ends - starts == lengths
    rows = np.flatnonzero(out & (lengths > 0))
    starts, ends, begins = starts[rows], ends[rows], begins[rows]
    for i, j, length, first, place, at in _slices(starts, ends):
        out[rows[i:j]] = ~np.logical_or.reduceat(data[at] != other[place + np.repeat(begins[i:j], length)], first)
    return out


class Memo:
    """Arrays that ``encode`` gives for byte runs, made once for each distinct run.

    Runs are found by hash and confirmed byte by byte; one that shares its hash with another run is kept by its bytes. Beyond ``most`` runs the memo starts
    anew.
    """

    def __init__(self, encode, kind, most: int):
        self.encode, self.kind, self.most = encode, kind, most
        self.reset()

    def reset(self) -> None:
        self.known, self.slot, self.odd = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        self.flat, self.offsets = np.zeros(0, self.kind), np.zeros(1, np.int64)
        self.raw, self.bounds = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of new runs."""
        got = gather(data, starts, ends)
        values = [self.encode(x) for x in got.to_pylist()]
        lengths = np.fromiter(map(len, values), np.int64, len(values))
        base = len(self.offsets) - 1
        self.flat = np.concatenate([self.flat, np.fromiter((x for y in values for x in y), self.kind, int(lengths.sum()))])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        self.raw = np.concatenate([self.raw, np.frombuffer(got.buffers()[2], np.uint8)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(ends - starts)])
        return base + np.arange(len(values))

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each run, the slot whose ``flat[offsets[slot]:offsets[slot + 1]]`` is its array; valid until the next call."""
        unique, first, inverse = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if not len(unique):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.known, unique)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == unique[hit]
        new = np.flatnonzero(~hit)
        if len(new):
            if len(self.bounds) - 1 + len(new) > self.most:
                self.reset()
                new = np.arange(len(unique))
            slots = self._add(data, starts[first[new]], ends[first[new]])
            place = np.searchsorted(self.known, unique[new])
            self.known, self.slot = np.insert(self.known, place, unique[new]), np.insert(self.slot, place, slots)
            at = np.searchsorted(self.known, unique)
        slot = self.slot[at][inverse]
        for i in np.flatnonzero(~same_runs(data, starts, ends, self.raw, self.bounds[slot], self.bounds[slot + 1] - self.bounds[slot])).tolist():
            key = data[starts[i] : ends[i]].tobytes()
            if key not in self.odd:
                self.odd[key] = int(self._add(data, starts[i : i + 1], ends[i : i + 1])[0])
            slot[i] = self.odd[key]
        return slot


@dataclass
class Words:
    """Words of the rows of one column: byte spans, the row of each word, and the first word of each row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0, table: np.ndarray = IDENTITY) -> np.ndarray:
        return run_hashes(self.data, self.starts, self.ends, seed, table)

    def strings(self, at: np.ndarray, table: np.ndarray = IDENTITY) -> pa.Array:
        return gather(self.data, self.starts[at], self.ends[at], table)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = IDENTITY, kind=None) -> pa.Array:
    """The byte runs as an Arrow array of strings (or of ``kind``)."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(int(offsets[-1]), dtype=np.int64) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(kind or pa.large_utf8(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(table[data[at]])])


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_utf8())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which ``inside`` holds, cut at row ends: starts, ends and the row of each."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def words_of(column) -> Words:
    data, offsets = buffer_of(column)
    starts, ends, row = runs(data, offsets, ~IS_SPACE[data])
    return Words(data, starts, ends, row, np.searchsorted(row, np.arange(len(offsets))))


def window_hashes(word_hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` words; those that cross rows must be left out by the caller."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(((0xD6E8FEB86659FD93 + 2 * seed) & _MASK) | 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out += word_hashes[i : n + i]
        out *= base
        out ^= out >> np.uint64(32)  # keeps it from being a linear form of the words
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
