"""Word shingles of texts as sorted arrays of distinct 64-bit hashes, and their MinHash signatures.

Works on the UTF-8 bytes of a whole batch at once: A-Z are lower-cased, words are
runs of bytes other than the six ASCII white-space characters.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20_240_601))
_BYTE = _RNG.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _SHORT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(max(0, n - 1), _STEP)), dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and the number of words of each text."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = ~_BLANK[raw]
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1])) if len(raw) else np.zeros(0, np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    words = np.diff(np.append(0, np.searchsorted(starts, ends)))
    if not len(starts):
        return np.zeros(0, np.uint64), words
    lengths = np.add.reduceat(inside, starts, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    letters = _BYTE[_LOWER[raw[inside]]] * _powers(int(lengths.max()))[place]
    return _mix(np.add.reduceat(letters, first) + lengths.astype(np.uint64)), words


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one shingle, without words none."""
    hashes, words = word_hashes(texts)
    powers = _powers(width)
    joined = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        joined += hashes[k:k + len(joined)] * powers[k]
    joined, out, at = _mix(joined), [], 0
    for n in words.tolist():
        if n >= width:
            found = np.sort(joined[at:at + n - width + 1])
            out.append(found[np.append(True, found[1:] != found[:-1])])
        elif n:
            out.append(_mix((hashes[at:at + n] * powers[:n]).sum(dtype=np.uint64, keepdims=True) ^ _SHORT))
        else:
            out.append(hashes[:0])
        at += n
    return out


def minima(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates for each non-empty set: its least value under ``size`` hash functions."""
    rng = np.random.Generator(np.random.PCG64(7))
    times = rng.integers(1 << 63, size=size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(1 << 63, size=size, dtype=np.uint64)
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, size), np.uint64)
    flat, starts = np.concatenate(full), np.cumsum([0, *map(len, full)])[:-1]
    out = np.empty((len(full), size), np.uint64)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(flat * times[k] + plus[k], starts)
    return out
