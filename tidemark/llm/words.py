"""Words of many texts at once: maximal runs of bytes other than \\x20 and \\x09-\\x0D, and 64-bit hashes of them."""

from __future__ import annotations

import numpy as np

_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def spread(h: np.ndarray) -> np.ndarray:
    """Mixes 64-bit numbers; equal stay equal, others differ."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, a line end after each text, and where each text starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8), np.cumsum(sizes) - sizes


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the first word of each text (with the number of words after them)."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))
    first, last = edge[0::2], edge[1::2]
    return first, last, np.append(np.searchsorted(first, starts), len(first))


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = last - first
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    term = _TABLE[data[np.repeat(first, size) + place]] * powers(_STEP, int(size.max()))[place]
    return spread(np.add.reduceat(term, ends - size) + size.astype(np.uint64))
