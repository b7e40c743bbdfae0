"""Word splitting and hashing over whole Arrow columns of text, in numpy.

A word is a run of bytes other than ASCII white space (space, 9 to 13). Word hashes are 64-bit polynomials over a random
byte table, finished by a mixer; they depend on the word's bytes alone, so every executor computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK = 1 << 20

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def odd(seed: int) -> int:
    return int(mix(np.array([seed * 0x9E3779B97F4A7C15 % (1 << 64)], dtype=U64))[0]) | 1


@cache
def _bytes_table(seed: int, lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U64) * U64(odd(seed)))
    if lower:
        t[65:91] = t[97:123]
    return t


_WS = np.zeros(256, dtype=bool)
_WS[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of an odd base modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, dtype=U64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            size = -(-n // (1 << 18)) * (1 << 18)
            step = np.full(size, U64(self.base))
            step[0] = 1
            self.values = np.multiply.accumulate(step)
        return self.values[:n]


@cache
def powers(seed: int) -> tuple[_Powers, _Powers]:
    base = odd(seed)
    return _Powers(base), _Powers(pow(base, -1, 1 << 64))


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of values[start:end] for each span; equal stretches hash alike wherever they stand."""
    up, down = powers(seed)
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up.upto(len(values)), out=total[1:])
    return mix((total[end] - total[start]) * down.upto(len(values) + 1)[start])


@dataclass
class Chunk:
    """Rows first..last of a batch with their words. row: a word's row in the chunk; bounds: a row's words are
    bounds[r]:bounds[r + 1]; start, end: bytes in data."""

    first: int
    last: int
    data: np.ndarray
    text_bounds: np.ndarray
    row: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def hashes(self, seed: int = 1, lower: bool = False) -> np.ndarray:
        return spans_hash(_bytes_table(seed, lower)[self.data], self.start, self.end, seed)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


#: The bytes of words that are runs of ASCII letters and digits and of characters beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def chunks(column: pa.Array, size: int = CHUNK, word: np.ndarray = ~_WS) -> Iterator[Chunk]:
    """The column in chunks of about `size` bytes, each row whole. word: the bytes that words are made of."""
    data, offsets = flat(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, n)
        part, bounds = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        inner = bounds[1:-1]
        solid = word[part]
        begin, end = solid.copy(), solid.copy()
        if len(part):
            cut = np.zeros(len(part) + 1, dtype=bool)
            cut[inner] = True
            begin[1:] &= ~solid[:-1] | cut[1:-1]
            end[:-1] &= ~solid[1:] | cut[1:-1]
        start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        words = np.searchsorted(start, bounds)
        yield Chunk(first, last, part, bounds, np.repeat(np.arange(last - first), np.diff(words)), words, start, stop)
        first = last
