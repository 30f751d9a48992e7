"""64-bit hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + mix(np.array([seed], dtype=np.uint64)))


_BYTE = stream(11, 256)
_POWER = np.ones(1, dtype=np.uint64)

#: Byte classes. SPACES: the six ASCII white-space bytes of the contracts.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: NOT_WORD: all ASCII but letters and digits; bytes of other scripts belong to words.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[128:] = False
NOT_WORD[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", dtype=np.uint8)] = False


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        base = np.full(max(n, 256), np.uint64(0x5851F42D4C957F2D) | np.uint64(1), dtype=np.uint64)
        base[0] = 1
        _POWER = np.multiply.accumulate(base)
    return _POWER


def word_hashes(raw: bytes, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each maximal run of bytes outside `separators`."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    inside = ~separators[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    lengths = ends - starts
    letters = data[inside]
    firsts = np.cumsum(lengths) - lengths
    at = np.arange(len(letters)) - np.repeat(firsts, lengths)
    value = (_BYTE[letters] + np.uint64(1)) * _powers(int(lengths.max()))[at]
    return mix(np.add.reduceat(value, firsts) + lengths.astype(np.uint64)), starts


def blocks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(first, last + 1, joined bytes) of runs of texts of about `size` bytes,
    so that numpy's temporaries stay small; a longer text is a run of its own.
    Texts are joined by a newline, so no word spans two of them."""
    first, total = 0, 0
    for k, t in enumerate(texts):
        if total and total + len(t) > size:
            yield first, k, b"\n".join(texts[first:k])
            first, total = k, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts), b"\n".join(texts[first:])


def word_lists(texts: list[bytes], separators: np.ndarray = SPACES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: (index of the first text, hashes of all their words,
    offsets): words offsets[i]:offsets[i + 1] belong to text first + i."""
    for first, last, raw in blocks(texts):
        hashes, starts = word_hashes(raw, separators)
        begins = np.cumsum([0, *[len(t) + 1 for t in texts[first:last]]])
        yield first, hashes, np.searchsorted(starts, begins)
