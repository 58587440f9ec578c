"""Vectorised word arithmetic over Arrow text columns, for use inside tasks.

A word is a run of bytes other than the six ASCII white-space characters; letters A-Z may be folded. Words are known
by a 64-bit hash of their bytes: a polynomial over a random byte table, mixed, so that every word of a batch is hashed
with a few passes over its bytes and no Python loop.
"""

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20_011)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
FOLDED_CODE = BYTE_CODE.copy()
FOLDED_CODE[65:91] = BYTE_CODE[97:123]
BASE = 0x9E3779B97F4A7C13
_BACK = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _powers(base, n):
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache = {}


def powers(n):
    if _cache.get("n", -1) < n:
        size = max(n, SLICE_BYTES)
        _cache.update(n=size, up=_powers(BASE, size), down=_powers(_BACK, size))
    return _cache["up"], _cache["down"]


def mix(x):
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column):
    """The bytes of a text or binary column and the n + 1 offsets of its rows; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(column, size=SLICE_BYTES):
    """Yields (first row, bytes, offsets from 0) for runs of rows of about ``size`` bytes, at least one row each."""
    data, offsets = column_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Start and end of every word, the first word of each row (n + 1 values), and the words' hashes."""

    def __init__(self, data, offsets, folded=True, gap=SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.ones(n + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = ~gap[data]
        start = inside[1:-1] & ~inside[:-2]
        end = inside[1:-1] & ~inside[2:]
        edge = offsets[1:-1]
        at = edge[(edge > 0) & (edge < n)]
        start[at] |= inside[at + 1]
        end[at - 1] |= inside[at]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.row = np.searchsorted(self.start, offsets)
        up, down = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((FOLDED_CODE if folded else BYTE_CODE)[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def row_of_word(self):
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.row))

    def windows(self, size):
        """Hash of the ``size`` words from each word on; windows that cross the end of a row are not meaningful."""
        h, out = self.hash, np.zeros(len(self.hash), np.uint64)
        for k in range(min(size, len(h))):
            out[: len(h) - k] += h[k:] * np.uint64(pow(BASE, 3 * k + 1, 1 << 64))
        return mix(out)

    def text(self, i):
        return self.data[self.start[i] : self.end[i]].tobytes()


def shingles(words, row, windows, size):
    """Sorted distinct shingle hashes of one row; the whole sequence as one where it has fewer words; else empty."""
    a, b = int(words.row[row]), int(words.row[row + 1])
    if b - a >= size:
        found = np.sort(windows[a : b - size + 1])
        return found[np.r_[True, found[1:] != found[:-1]]]
    if b == a:
        return np.zeros(0, np.uint64)
    whole = b - a
    for h in words.hash[a:b].tolist():
        whole = (whole * BASE + h) % (1 << 64)
    return mix(np.array([whole], np.uint64))
