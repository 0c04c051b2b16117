"""Whole columns of text as byte, word and hash arrays: the numpy helpers of the tasks in this package.

A column becomes one byte array with the offsets of its texts. Words are maximal runs of bytes that are no separators;
they never cross texts. Hashes are polynomial sums modulo 2**64 with an odd base, so that the hash of any stretch
follows from two prefix sums; two independent streams give 128 bits where equality decides a result.
"""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
MASK = (1 << 64) - 1
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    NOT_ALNUM[ord(_a):ord(_b) + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Largest number of bytes that a task holds as arrays at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Stream:
    """One polynomial hash: a base, its inverse, a value for each byte, and growing tables of powers."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.bytes = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        self.up = self.down = np.ones(1, U64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, U64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))
        return self.up, self.down

    def trim(self) -> None:
        if len(self.up) > 4 * CHUNK_BYTES:
            self.up = self.down = np.ones(1, U64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums from which span() takes the hash of any stretch of the values."""
        up, _ = self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:len(values)], out=out[1:])
        return out

    def span(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(sums))
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


FIRST, SECOND = Stream(0x9E3779B97F4A7C15 | 1, 11), Stream(0xC2B2AE3D27D4EB4F | 1, 23)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def release() -> None:
    """Give memory that a task no longer needs back to the system: Python workers live on between tasks."""
    for s in (FIRST, SECOND):
        s.up = s.down = np.ones(1, U64)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `most` bytes; a longer text comes alone."""
    for b in batches:
        if not b.num_rows:
            continue
        _, offsets = flat(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield b.slice(at, end - at)
            at = end
    release()


class Words:
    """The words of a column of texts: where they start and end, and the first word of each text (`first`, one more
    than texts). hash() gives 64 bits for each word."""

    def __init__(self, column: pa.Array, separators: np.ndarray, lower: bool):
        data, self.offsets = flat(column)
        self.data = LOWER[data] if lower else data
        n = len(data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~separators[data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        self.starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
        self.ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
        self.first = np.searchsorted(self.starts, self.offsets)

    def hash(self, stream: Stream = FIRST) -> np.ndarray:
        return stream.span(stream.sums(stream.bytes[self.data]), self.starts, self.ends)


def text_of(column_ends: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """For each position the index of the stretch [ends[i], ends[i + 1]) that holds it."""
    return np.searchsorted(column_ends, positions, "right") - 1


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    least, have = keys, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = width - have
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


PLACE_BITS = U64(31)
PLACE = U64((1 << 31) - 1)


def winnow(grams: np.ndarray, ends: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed anchors of stretches of units.

    grams: the hash of the `gram` units from each unit on (garbage where they leave the stretch); ends: offsets of the
    stretches. A window is `window` units of one stretch; its anchor is the leftmost least gram inside it, which
    depends on the window alone, so equal windows have equal anchors at equal offsets. Returns for each anchor its
    stretch, its place, and the first and last start of the windows that it answers for.
    """
    n, width = int(ends[-1]), window - gram + 1
    if n < window:
        return (np.zeros(0, np.int64),) * 4
    keys = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=U64)
    place = (sliding_least(keys, width) & PLACE).astype(np.int64)[:n - window + 1]
    of = text_of(ends, np.arange(n - window + 1)) if len(ends) > 2 else np.zeros(n - window + 1, np.int64)
    whole = np.arange(n - window + 1) + window <= ends[of + 1]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    p, t = place[starts], of[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (p[1:] != p[:-1]) | (t[1:] != t[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    return t[head], p[head], starts[head], starts[tail]


def union_length(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n units are covered by the stretches."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
