"""Words of Arrow text columns as 64-bit hashes, found and hashed in whole-array steps.

A word is a run of bytes that are no separators, inside one text. Its hash is a
polynomial in random byte codes, taken as a difference of running sums, mixed with
its length; two different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from larder.llm.common import ASCII_SPACE, mix64

#: Bytes handled at once; a block ends where a word ends.
BLOCK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES_LOWER = _CODES[_LOWER]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            both = tuple(
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)
            )
        if size > 1 << 22:
            return both
        _powers[size] = both
    return _powers[size]


@dataclass
class Words:
    """Words of a text column: where they are in ``data``, their hashes, and how many each text has."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """Place of each text's first word, and the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text bounds of a binary column; a null is an empty text."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def words_of(column: pa.Array, lower: bool = False, separators: np.ndarray = _SPACE) -> Words:
    """Words between ASCII white space (or other separators); ``lower`` hashes A-Z as a-z."""
    data, bounds = text_bytes(column)
    codes = _CODES_LOWER if lower else _CODES
    starts, ends, hashes = [], [], []
    at = 0
    edges = np.zeros(len(data) + 1, bool)
    edges[bounds] = True
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not separators[data[end]] and not edges[end]:
            end += 1
        block, edge = data[at:end], edges[at : end + 1].copy()
        edge[0] = edge[-1] = True
        solid = ~separators[block]
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _powers_for(len(block) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(codes[block] * power[: len(block)], out=sums[1:])
            value = (sums[e] - sums[s]) * inverse[s]
            hashes.append(mix64(value + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    counts = np.diff(np.searchsorted(start, bounds))
    return Words(
        data,
        start,
        np.concatenate(ends) if ends else np.empty(0, np.int64),
        np.concatenate(hashes) if hashes else np.empty(0, np.uint64),
        counts,
    )


def sequences(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words inside each text, and how many each text has.

    A text with fewer words, but some, has one run of all its words.
    """
    bounds = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        if len(hashes) >= n:
            value = np.zeros(len(hashes) - n + 1, np.uint64)
            for k in range(n):
                value = mix64(value * np.uint64(3) + hashes[k : len(hashes) - n + 1 + k])
            inside = np.ones(len(value), bool)
            for k in range(1, n):
                cut = bounds[1:-1] - k
                inside[cut[(cut >= 0) & (cut < len(value))]] = False
            place = np.flatnonzero(inside)
        else:
            value, place = np.empty(0, np.uint64), np.empty(0, np.int64)
        out_counts = np.maximum(counts - n + 1, 0)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if not len(short):
            return value[place], out_counts
        extra = np.empty(len(short), np.uint64)
        for i, text in enumerate(short):
            h = np.zeros(1, np.uint64)
            for x in hashes[bounds[text] : bounds[text + 1]]:
                h = mix64(h * np.uint64(3) + x)
            extra[i] = mix64(h + np.uint64(counts[text]))[0]
    out_counts[short] = 1
    ends = np.concatenate([[0], np.cumsum(out_counts)])
    out = np.empty(ends[-1], np.uint64)
    alone = np.zeros(len(out), bool)
    alone[ends[short]] = True
    out[alone] = extra
    out[~alone] = value[place]
    return out, out_counts


class HashIndex:
    """Numbers for 64-bit hashes in order of first sight; linear probing in arrays."""

    def __init__(self, slots: int = 1 << 16):
        self.keys = np.zeros(slots, np.uint64)
        self.numbers = np.zeros(slots, np.int64)
        self.size = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where unknown."""
        hashes = np.maximum(hashes, np.uint64(1))
        mask = np.uint64(len(self.keys) - 1)
        slot = hashes & mask
        key = self.keys[slot]
        out = np.where(key == hashes, self.numbers[slot], -1)
        left = np.flatnonzero((key != hashes) & (key != 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & mask
            key = self.keys[slot[left]]
            hit = key == hashes[left]
            out[left[hit]] = self.numbers[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number distinct unknown hashes in their order."""
        hashes = np.maximum(hashes, np.uint64(1))
        if 2 * (self.size + len(hashes)) > len(self.keys):
            used = self.keys != 0
            keys, numbers = self.keys[used], self.numbers[used]
            slots = 1 << (4 * (self.size + len(hashes))).bit_length()
            self.keys, self.numbers = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
            self._place(keys, numbers)
        self._place(hashes, np.arange(self.size, self.size + len(hashes)))
        self.size += len(hashes)

    def _place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot, left = hashes & mask, np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = hashes[free]
            self.numbers[slot[free]] = numbers[free]
            left = left[self.keys[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + np.uint64(1)) & mask


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order of first sight, and the place of that sight."""
    _, first = np.unique(hashes, return_index=True)
    first.sort()
    return hashes[first], first


def slices(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """A text column in parts of about ``limit`` bytes."""
    data, bounds = text_bytes(column)
    cuts = np.flatnonzero(np.diff(bounds[1:] // limit)) + 1 if len(column) > 1 else np.empty(0, np.int64)
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)], strict=True):
        yield column.slice(a, b - a)
