"""Samples of difference-compressed seismic records (encodings 10 and 11 of MiniSEED), as NumPy arrays."""

from __future__ import annotations

import numpy as np

STEIM1, STEIM2 = 10, 11
FRAME_WORDS = 16
# Fixed values: (differences, bits of each) by code, and for the second scheme by the word's two top bits.
LAYOUT1 = {1: (4, 8), 2: (2, 16), 3: (1, 32)}
LAYOUT2 = {(1, None): (4, 8), (2, 1): (1, 30), (2, 2): (2, 15), (2, 3): (3, 10), (3, 0): (5, 6), (3, 1): (6, 5), (3, 2): (7, 4)}


def differences(word: int, count: int, bits: int) -> list[int]:
    """Signed fields of ``bits`` bits in the word's low end, first one highest."""
    out = []
    for k in range(count - 1, -1, -1):
        v = (word >> (k * bits)) & ((1 << bits) - 1)
        out.append(v - (1 << bits) if v >> (bits - 1) else v)
    return out


def decode(data: bytes, samples: int, encoding: int) -> np.ndarray:
    """The record's ``samples`` values; a record whose last value isn't the stated one is refused."""
    words = np.frombuffer(data, ">u4", len(data) // 4).tolist()
    found: list[int] = []
    for at in range(0, len(words) - len(words) % FRAME_WORDS, FRAME_WORDS):
        if len(found) >= samples:
            break
        codes = words[at]
        for k in range(1, FRAME_WORDS):
            code = (codes >> (2 * (FRAME_WORDS - 1 - k))) & 3
            if not code:
                continue
            word = words[at + k]
            key = code if encoding == STEIM1 else (code, word >> 30 if code > 1 else None)
            layout = (LAYOUT1 if encoding == STEIM1 else LAYOUT2).get(key)
            if layout is None:
                raise ValueError("unknown layout of a compressed word")
            found += differences(word, *layout)
    if len(found) < samples:
        raise ValueError(f"compressed record holds {len(found)} of {samples} samples")
    first, last = (w - (1 << 32) if w >> 31 else w for w in words[1:3])
    steps = np.array(found[:samples], np.int64)
    steps[:1] = first
    x = np.cumsum(steps)
    if samples and x[-1] != last:
        raise ValueError("compressed record does not end at its stated last sample")
    return x
