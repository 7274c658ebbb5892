"""Vectorised views of a batch of texts: one UTF-8 buffer, word and line bounds, substring hashes.

Everything works inside a task, on Arrow batches cut to about half a megabyte; a text is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Any odd multiplier serves; it and its inverse modulo 2**64 turn prefix sums into substring hashes.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_CODE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=U64) | U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, grown on demand and kept in the worker."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", _INVERSE)):
                x = np.full(size, U64(base))
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class TextBlock:
    """Some whole texts, end to end in ``buf``; text k is ``buf[starts[k]:starts[k + 1]]``."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray):
        self.buf, self.starts, self.n = buf, starts, len(starts) - 1

    def sums(self) -> np.ndarray:
        """Prefix sums for substring_hash."""
        with np.errstate(over="ignore"):
            up, _ = powers(len(self.buf) + 1)
            out = np.zeros(len(self.buf) + 1, U64)
            np.cumsum(_CODE[self.buf] * up[:-1], out=out[1:])
        return out

    @staticmethod
    def substring_hash(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of buf[first:last] for each pair of bounds."""
        with np.errstate(over="ignore"):
            _, down = powers(len(sums))
            return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U64))

    @staticmethod
    def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
        """Hash of each ``width`` bytes in a row, as substring_hash gives it."""
        with np.errstate(over="ignore"):
            _, down = powers(len(sums))
            return mix((sums[width:] - sums[:-width]) * down[: len(sums) - width] + U64(width))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end byte of each word, and the text it is in. Words end at ASCII space or a text's end."""
        inside = ~SPACE[self.buf]
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[self.starts] = True
        prev = np.zeros(len(self.buf), bool)
        prev[1:] = inside[:-1]
        first = np.flatnonzero(inside & (~prev | edge[:-1]))
        after = np.zeros(len(self.buf), bool)
        after[:-1] = inside[1:]
        last = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return first, last, np.searchsorted(self.starts, first, "right") - 1

    def per_text(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted byte positions each text has."""
        return np.diff(np.searchsorted(positions, self.starts))


def blocks(column: pa.Array | pa.ChunkedArray, most_bytes: int = 1 << 19) -> Iterator[tuple[int, int, TextBlock]]:
    """Cut a string column into TextBlocks of about most_bytes (one longer text stands alone); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield i, j, TextBlock(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    twice, later = np.zeros(len(s), bool), np.zeros(len(s), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later
