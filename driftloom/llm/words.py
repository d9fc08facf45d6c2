"""Words and word windows of whole Arrow text columns as NumPy arrays, without a loop over words.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, so UTF-8 needs no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20
#: Odd multipliers; every hash below is taken modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit values whose bits all depend on each other."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, up to n; kept for the next slice if not too long."""
    up, down = _POWERS.get(base, (np.empty(0, np.uint64),) * 2)
    if len(up) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        up, down = made
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = (up, down)
    return up[: n + 1], down[: n + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end and the place where each begins; null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.fill_null("") if column.null_count else column
    else:
        column = column.cast(pa.string()).fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    if len(column) == 0 or places is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to, bytes, begins) of at most `most` bytes, or of one longer text."""
    data, at = text_bytes(column)
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and for each text the number of its first word (and the end)."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge |= cut
    begins = np.flatnonzero(edge[:-1] & inside)
    ends = np.flatnonzero(edge[1:] & inside) + 1
    return begins, ends, np.searchsorted(begins, at)


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    up, down = _powers(len(data), BASES[0])
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int, base: int = BASES[1]) -> np.ndarray:
    """Hash of every run of `size` consecutive word hashes."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    up, down = _powers(len(words), base)
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * up[:-1], out=sums[1:])
    return mixed((sums[size:] - sums[: len(sums) - size]) * down[: len(sums) - size])


def window_mask(bounds: np.ndarray, size: int) -> np.ndarray:
    """Which windows of `window_hashes` lie inside one text."""
    n = max(int(bounds[-1]) - size + 1, 0)
    inside = np.ones(n, bool)
    for back in range(1, size):
        inner = bounds[1:-1] - back
        inside[inner[(inner >= 0) & (inner < n)]] = False
    return inside


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
