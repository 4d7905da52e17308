"""Vectorised text primitives shared by the corpus operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, so a
batch of documents is tokenised and hashed by a handful of numpy passes and no
Python string is made per word.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

_U64 = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INV = pow(_RADIX, -1, 1 << 64)

#: A byte counts in a word's hash by a polynomial of these numbers.
_A, _B, _C = _U64(0xD6E8FEB86659FD93), _U64(0xA3AAAC6C61E0A3D1), _U64(0xC2B2AE3D27D4EB4F)

_powers: dict[int, np.ndarray] = {}
#: Bytes of text hashed at once.
BLOCK = 1 << 15


def is_space(raw: np.ndarray) -> np.ndarray:
    """ASCII white space as the operators see it: space and \\t\\n\\v\\f\\r."""
    return ((raw - np.uint8(9)) < 5) | (raw == 32)


@functools.lru_cache(maxsize=2)
def _byte_codes(fold_case: bool) -> np.ndarray:
    """What each of the 256 bytes counts in a word's hash."""
    x = np.arange(256, dtype=np.uint64)
    if fold_case:
        x[65:91] += _U64(32)
    with np.errstate(over="ignore"):
        return (x * _A + _B) * x + _C


def _running(raw: np.ndarray, fold_case: bool) -> np.ndarray:
    """Sums, before each byte and at the end, of codes times powers; by blocks that stay in the cache."""
    out = np.zeros(len(raw) + 1, np.uint64)
    codes, powers = _byte_codes(fold_case), _power_table(_RADIX, len(raw))
    for a in range(0, len(raw), BLOCK):
        part = codes[raw[a : a + BLOCK]]
        part *= powers[a : a + BLOCK]
        part[:1] += out[a : a + 1]
        np.cumsum(part, out=out[a + 1 : a + 1 + len(part)])
    return out


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i in [0, n); grown by doubling and kept per process up to 16 MB."""
    table = _powers.get(base)
    if table is None:
        table = np.ones(1, dtype=np.uint64)
    while len(table) < n:
        with np.errstate(over="ignore"):
            step = _U64(pow(base, len(table), 1 << 64))
            table = np.concatenate([table, table * step])
    if len(table) <= 1 << 21:
        _powers[base] = table
    return table[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U64(33))
        x = x * _U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> _U64(29))
        x = x * _U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U64(32))


def utf8_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, count=last)[first:] if last else np.zeros(0, np.uint8)
    return raw, offsets - first


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges whose texts together take about ``limit`` bytes (one row at least)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def word_hashes(raw: np.ndarray, offsets: np.ndarray, fold_case: bool = True, breaks: np.ndarray | None = None):
    """Hash every maximal run of non-space bytes.

    Returns (hashes, word_start, bounds): 64-bit hashes of all words in order, the
    byte at which each begins, and for every row the slice bounds into them.
    ``breaks`` marks further bytes that separate words.
    """
    rows = len(offsets) - 1
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    solid = np.zeros(n + 2, bool)
    np.logical_not(is_space(raw), out=solid[1:-1])
    if breaks is not None:
        solid[1:-1] &= ~breaks[raw]
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    start, stop = np.ascontiguousarray(turns[::2]), np.ascontiguousarray(turns[1::2])
    # Where a row ends within a word.
    cut = np.unique(offsets[solid[offsets] & solid[offsets + 1]])
    if len(cut):
        start, stop = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([stop, cut]))
    with np.errstate(over="ignore"):
        running = _running(raw, fold_case)
        hashes = mix64((running[stop] - running[start]) * _power_table(_RADIX_INV, n)[start])
    return hashes, start, np.searchsorted(start, offsets)


_FIRST, _SECOND = _U64(0xA0761D6478BD642F), _U64(0xE7037ED1A0B428DB)


def bigram_hashes(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of adjacent word pairs and their row bounds; a row of one word yields that word alone."""
    counts = np.diff(bounds)
    if len(hashes) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    with np.errstate(over="ignore"):
        left = hashes * _FIRST
        pair = mix64(left[:-1] ^ (hashes[1:] * _SECOND + _U64(1)))
        keep = np.ones(len(hashes), dtype=bool)
        keep[bounds[1:][counts > 0] - 1] = False
        out = np.empty(len(hashes), np.uint64)
        out[:-1] = pair
        lone = bounds[:-1][counts == 1]
        out[lone] = mix64(left[lone] ^ _U64(0x5851F42D4C957F2D))
    keep[lone] = True
    sizes = np.where(counts > 1, counts - 1, counts)
    return out[keep], np.concatenate([[0], np.cumsum(sizes)])
