"""Words and word hashes of Arrow text columns, as NumPy arrays.

A batch of texts is cut into slices of bounded bytes; inside a slice all words of all texts are found and
hashed at once on the UTF-8 bytes. A word's 64-bit hash depends on its (lower-cased) bytes alone, so that it is the
same in every batch, task and run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
LONG_WORD = 1 << 16  # longer words are hashed by themselves, to bound the memory of a slice

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def byte_table(separators: bytes) -> np.ndarray:
    """True for every byte that belongs to a word, given the ASCII bytes that don't."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


# Words of letters, digits and anything outside ASCII; A-Z count as letters because they are lower-cased first.
ALNUM = byte_table(bytes(b for b in range(128) if not (chr(b).isdigit() or chr(b).isalpha())))
# Words between white space.
SPACED = byte_table(b" \t\n\x0b\x0c\r")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=_U))
_VALUES[65:91] = _VALUES[97:123]


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n, base, _U)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_POW = _powers(SLICE_BYTES + LONG_WORD + 1, _BASE)
_IPOW = _powers(SLICE_BYTES + LONG_WORD + 1, _INVERSE)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and the n+1 offsets between them; null counts as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of consecutive texts: byte spans in ``data``, and the n+1 offsets of each text's words."""

    first: int  # row of the batch that the first text is
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    bytes_at: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def row(self) -> np.ndarray:
        """Text of each word, counted from the first text of the slice."""
        return np.repeat(np.arange(self.rows), np.diff(self.offsets))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, with A-Z as a-z."""
        out = np.empty(len(self.starts), _U)
        if not len(out):
            return out
        size = self.ends - self.starts
        long = np.append(np.flatnonzero(size > LONG_WORD), len(out))
        i, n = 0, len(out)
        with np.errstate(over="ignore"):
            while i < n:
                j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SLICE_BYTES, "right")))
                j = min(j, max(i + 1, int(long[np.searchsorted(long, i)])))
                lo, hi = int(self.starts[i]), int(self.ends[j - 1])
                if size[i] > LONG_WORD:
                    j, hi = i + 1, lo
                    word = self.data[lo:self.ends[i]].tobytes().lower()
                    out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
                else:
                    total = np.zeros(hi - lo + 1, _U)
                    np.cumsum(_VALUES[self.data[lo:hi]] * _POW[:hi - lo], out=total[1:])
                    s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
                    out[i:j] = (total[e] - total[s]) * _IPOW[s] + (e - s).astype(_U)
                i = j
            return mix(out)

    def grams(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they all lie in that word's text."""
        n = len(h)
        if n < k:
            return np.zeros(n, _U), np.zeros(n, bool)
        with np.errstate(over="ignore"):
            g = np.full(n - k + 1, k, _U)
            for i in range(k):
                g = g * _U(0x9FB21C651E98DF25) + h[i:n - k + 1 + i]
            g = mix(g)
        left = np.repeat(self.offsets[1:], np.diff(self.offsets)) - np.arange(n)
        return np.concatenate([g, np.zeros(k - 1, _U)]), left >= k

    def word(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().lower().decode("utf-8", "replace")


def word_slices(column: pa.Array, table: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of the whole column, in slices of about ``limit`` bytes; a longer text is a slice of its own."""
    data, offsets = utf8(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        at = offsets[i:j + 1] - offsets[i]
        part = data[offsets[i]:offsets[j]]
        inside = table[part]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = np.unique(at[(at > 0) & (at < len(part))])
        begin[edge] = inside[edge]
        end[edge - 1] = inside[edge - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        yield Words(i, part, starts, ends, np.searchsorted(starts, at), at)
        i = j


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
