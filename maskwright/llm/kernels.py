"""Vectorised text kernels over Arrow string buffers.

Everything works on the UTF-8 bytes of a whole Arrow column: words, lines and
windows are found and hashed with numpy array operations, never per character
in Python. All separators used here are ASCII, so cutting bytes cuts code
points correctly.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer single text is handled whole.
BLOCK = 1 << 18

_BYTES = np.arange(256)
#: `[^\x20\x09-\x0D]`
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: ASCII letters, digits and every byte of a non-ASCII code point.
ALNUM = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)
NOT_NEWLINE = _BYTES != 0x0A
#: First byte of a code point.
LEADING = (_BYTES & 0xC0) != 0x80
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_M = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _P)])
            _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, _P_INV)])
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Block(NamedTuple):
    """Some rows of a column: their bytes, and the offset of each row in them."""

    first: int
    data: np.ndarray
    offs: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offs) - 1


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK):
    """The column's rows in runs of about `size` bytes; a null is an empty text."""
    for chunk, base in _chunks(column):
        chunk = chunk.cast(pa.large_string())
        if chunk.null_count:
            chunk = chunk.fill_null("")
        n = len(chunk)
        if not n:
            continue
        _, offs, data = chunk.buffers()
        offs = np.frombuffer(offs, np.int64)[chunk.offset : chunk.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
            to = min(to, n)
            yield Block(base + at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
            at = to


def _chunks(column):
    if isinstance(column, pa.ChunkedArray):
        base = 0
        for c in column.chunks:
            yield c, base
            base += len(c)
    else:
        yield column, 0


class Tokens(NamedTuple):
    """Runs of bytes: start and end in the block, row in the block, 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def tokens(block: Block, table: np.ndarray, lower: bool = True, hashed: bool = True) -> Tokens:
    """Maximal runs of bytes for which `table` holds; never across two rows."""
    data = block.data
    start, end, row = runs(block, table[data])
    return Tokens(start, end, row, run_hash(LOWER[data] if lower else data, start, end) if hashed else None)


def runs(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of bytes that are inside; never across two rows."""
    offs, n = block.offs, len(block.data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def run_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, by one prefix sum over the block."""
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _M)


def windows(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive tokens of a row, and the index of its first token."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = hashes[:n].copy()
    for j in range(1, k):
        w *= _M
        w += hashes[j : j + n]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(w[at] + np.uint64(k)), at


def long_windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive tokens, whatever their rows, by one prefix sum."""
    n = len(hashes)
    power, inverse = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * inverse[: n - k + 1])


def per_row(row: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of weights, for each row."""
    out = np.bincount(row, weights, rows)
    return out if weights is not None and weights.dtype.kind == "f" else out.astype(np.int64)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def text_hash(text: str) -> int:
    """run_hash of one lower-cased word, for lookups from plain strings."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return int(signed(run_hash(data, np.array([0]), np.array([len(data)])))[0])
