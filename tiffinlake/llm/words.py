"""Hashes of words and of runs of words, for many texts at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Its hash is that of a
polynomial modulo 2**64 over its bytes, taken from running sums over the whole
buffer, so that no word becomes an object. The factor is odd and so has an
inverse, which takes the place of a word in the buffer out of its hash.
"""

from __future__ import annotations

import numpy as np

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that running sums go over.
_PART = 1 << 18
#: A fixed random number for each byte.
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers over all bits, one to one."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


_powers: dict[int, np.ndarray] = {}


def _power(factor: int, size: int) -> np.ndarray:
    """The first powers of a factor; the longest list so far is kept."""
    if len(_powers.get(factor, ())) < size:
        out = np.ones(1 << max(18, (size - 1).bit_length()), np.uint64)
        out[1:] = factor & _MASK
        _powers[factor] = np.multiply.accumulate(out)
    return _powers[factor][:size]


def hashes_between(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of pieces of a buffer; equal pieces have equal ones wherever they stand."""
    codes, out = np.frombuffer(buffer, np.uint8), np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        # A part of the buffer at a time, so that the sums stay small; a longer piece is a part.
        first = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, first + _PART, "right")))
        part = codes[first : int(ends[hi - 1])]
        begin, end = starts[lo:hi] - first, ends[lo:hi] - first
        running = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _power(_FACTOR, len(part)), out=running[1:])
        inverse = _power(_INVERSE, len(part))
        out[lo:hi] = mixed((running[end] - running[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
        lo = hi
    return out


def word_places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A buffer of all texts, where their words start and end in it, and which word each text begins with (one entry more than texts)."""
    buffer = b" ".join([*texts, b""])
    space = _SPACE[np.frombuffer(buffer, np.uint8)]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts = edges[::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return buffer, starts, edges[1::2], np.searchsorted(starts, offsets)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and where each text's words begin (one entry more than texts)."""
    buffer, starts, ends, begins = word_places(texts)
    return hashes_between(buffer, starts, ends), begins


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each place on, where so many are left."""
    count = len(words) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = words[:count].copy()
    for k in range(1, size):
        out *= np.uint64(_FACTOR)
        out += words[k : k + count]
    return mixed(out)
