"""Vectorised text primitives used inside Arrow tasks.

Everything works on the raw UTF-8 buffers of an Arrow string column, so no
Python string is built for a word or a byte.  A *word* is a maximal run of
bytes outside 0x20 and 0x09-0x0D (all ASCII, so byte offsets respect UTF-8).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_SEED = 20240229
SLICE_BYTES = (1 << 20) - 1  # with one more power than bytes, the tables of powers stay at 2**20


@lru_cache(maxsize=4)
def byte_codes(seed: int = _SEED) -> np.ndarray:
    """One random 64-bit code per byte value."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        inv = pow(base, -1, 1 << 64)
        have = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b & ((1 << 64) - 1), U64))]) for b in (base, inv))
        if size > 1 << 22:
            return have
        _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Prefix polynomial over 64-bit symbols: the code of any span in O(1)."""

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        self.up, self.down = powers(n + 1, base)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * self.up[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * _MULT)

    def windows(self, k: int) -> np.ndarray:
        """Codes of all windows of k symbols, by start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + U64(k * int(_MULT) & ((1 << 64) - 1)))


BASE_BYTE, BASE_BYTE2, BASE_WORD, BASE_WORD2 = 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch | pa.Table, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of at most limit bytes of text (a longer text stands alone)."""
    n = batch.num_rows
    if not n:
        return
    _, offs = raw(batch.column(text))
    start = 0
    while start < n:
        stop = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCTUATED = _SPACE.copy()
_PUNCTUATED[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
NO_TERM = np.zeros(256, bool)  # ASCII bytes that are neither digits nor letters
NO_TERM[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n+1 word offsets by document."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words cut at white space and ASCII punctuation, ASCII and Latin-1 letters lower-cased, and n+1 offsets."""
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data = np.where(latin, data + np.uint8(32), lower_ascii(data))
    s, e, toffs = words(data, offs, _PUNCTUATED)
    return word_codes(data, s, e), toffs


def word_codes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return Rolling(byte_codes()[data], BASE_BYTE).spans(s, e) if len(s) else np.zeros(0, U64)


def owners(offs: np.ndarray) -> np.ndarray:
    """Index of the document of each element, from n+1 offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def window_mask(offs: np.ndarray, k: int) -> np.ndarray:
    """Which of the starts 0..n-k lie, with their window of k, in one document."""
    n = int(offs[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for back in range(1, k):
        cut = offs[1:-1] - back
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def window_mask_long(offs: np.ndarray, k: int) -> np.ndarray:
    """window_mask for wide windows: by the last valid start of each document."""
    n = int(offs[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    delta = np.zeros(int(offs[-1]) + 2, np.int32)
    lo, hi = offs[:-1], offs[1:] - k + 1
    good = hi > lo
    delta[lo[good]] += 1
    delta[hi[good]] -= 1
    return np.cumsum(delta)[:n] > 0


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over all windows of w, in O(n log w)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have, size = x, 1
    while size * 2 <= w:
        have = op(have[:-size], have[size:])
        size *= 2
    return op(have[:n], have[w - size : w - size + n])


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of n cells that lie in a window of k from one of the starts."""
    delta = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(starts + k, n), minlength=n + 1)[: n + 1]
    return np.cumsum(delta[:n]) > 0
