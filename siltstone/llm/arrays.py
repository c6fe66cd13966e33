"""Whole-column text handling on Arrow buffers with numpy: no Python object per row or word.

Everything here works on *blocks*: runs of whole rows of about ``BLOCK_BYTES`` of UTF-8 text (a longer
row is a block of its own), so memory is bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

#: ASCII A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word: digits, letters and everything outside ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    """At least n powers of the hash base or of its inverse, modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        full = np.full(size, _BASE if which == "up" else _BASE_INV, dtype=np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if size > 8 * BLOCK_BYTES:
            return have  # one very long text: not worth keeping
        _powers[which] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Rows ``first`` to ``first + rows`` of a batch; row i is ``data[offsets[i]:offsets[i+1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The blocks of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + block_bytes, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield Block(at, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """Words of a block: byte ranges, hashes of their lower-cased bytes (``token_hashes``), and per row the range of words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    row_at: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.row_at)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_at) - 1), self.counts())

    def row_end(self) -> np.ndarray:
        """For each word, the position after the last word of its row."""
        return np.repeat(self.row_at[1:], self.counts())


def ranges_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True bytes that don't cross a row: starts and ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    begin[cut] |= inside[cut]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


#: Values of a byte at each of the first places of a token; those further on are worked out when they are needed.
PLACES = 64
_KEY = np.uint64(0x5851F42D4C957F2D)


def _drawn(code: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit value for each place and byte."""
    return mix(mix(code.astype(np.uint64) + _KEY) + _KEY)


_DRAWN = _drawn(np.arange(PLACES * 256))


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that aren't empty and don't overlap, by tabulation: the sum of a value drawn for each place and byte.

    Two different tokens of any lengths and bytes hash alike with probability 2**-64 over the draw of the values; unlike a
    polynomial modulo 2**64 it has no tokens, however long, that collide whatever the key.
    """
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1])
    at = place + np.repeat(starts - first, size)
    place -= np.repeat(first, size)
    code = place << 8
    code |= data[at]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        value = _DRAWN[np.minimum(code, len(_DRAWN) - 1)]
        value[far] = _drawn(code[far])
    else:
        value = _DRAWN[code]
    return mix(np.add.reduceat(value, first))


class RangeHasher:
    """64-bit hashes of byte ranges, which may overlap; equal bytes hash alike wherever they stand. A polynomial modulo 2**64: good
    for features, not for telling tokens apart (see ``token_hashes``)."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _power("up", n + 1)[:n]
        np.cumsum(terms, out=self.sums[1:])
        self.down = _power("down", n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] ^ (ends - starts).astype(np.uint64))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of some ranges of data."""
    return RangeHasher(data)(starts, ends)


def words(block: Block, lower: bool = True) -> Words:
    """The words of every row of a block."""
    data = LOWER[block.data] if lower else block.data
    starts, ends = ranges_of(WORD[block.data], block.offsets)
    return Words(starts, ends, token_hashes(data, starts, ends), np.searchsorted(starts, block.offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on; shorter than the input by k - 1 (rows aren't looked at)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out)


def expand(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def code_points_before(data: np.ndarray) -> np.ndarray:
    """For each byte position, how many code points start before it (length len(data) + 1)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
