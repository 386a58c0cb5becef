"""Arrow string columns as byte arrays: slices of bounded size, words, and 64-bit word hashes.

All delimiters used here are ASCII, so cutting UTF-8 at bytes equals cutting at characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on; a longer single text is a step of its own.
SLICE_BYTES = 512 << 10

_BASE = np.uint64(0x9E3779B97F4A7C55)
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of `[^\x20\x09-\x0D]`.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`: digits, a-z and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least ``n`` of them."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Slice:
    """Texts of some rows, one after the other. ``bounds`` has len(rows) + 1 byte offsets."""

    first_row: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    """Byte ranges of words in a slice; words ``at[i]`` to ``at[i + 1]`` belong to row i."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of a string column in row order. A null reads as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(n, max(last, row + 1))
        yield Slice(row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def words(part: Slice, data: np.ndarray, is_word: np.ndarray) -> Words:
    """Words of each row: longest stretches of bytes of a class that end with the row."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, np.zeros(len(part.bounds), dtype=np.int64))
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    inner = part.bounds[(part.bounds > 0) & (part.bounds < len(data))]
    before[inner] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, part.bounds, side="left"))


def word_hashes(data: np.ndarray, found: Words) -> np.ndarray:
    """64-bit hash of the bytes of each word."""
    if not len(found.start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[found.end] - total[found.start]) * down[found.start])
