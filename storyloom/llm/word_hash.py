"""64-bit hashes of the words of a batch of texts, computed over byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C17 | 3
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        run = np.full(max(n, 1 << 20), base & _MASK, np.uint64)
        run[0] = 1
        _powers[kind] = np.multiply.accumulate(run)
    return _powers[kind][:n]


def chunks(texts: list[str | None], most_bytes: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most_bytes together; a longer text has a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most_bytes:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of non-white characters, A-Z in lower case) in order, and bounds: the words of text i
    are hashes[bounds[i] : bounds[i + 1]]."""
    parts = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts).lower() + b" ", np.uint8)
    white = _WHITE[data]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    total = np.cumsum(_TABLE[data] * _power("up", len(data)))
    hashes = mix((total[ends - 1] - total[starts - 1]) * _power("down", len(data))[starts])
    firsts = np.cumsum([1, *(len(p) + 1 for p in parts)])
    return hashes, np.searchsorted(starts, firsts)
