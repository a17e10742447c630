"""Word shingles of many texts at once, as 64-bit hashes, with numpy inside a task."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts in order, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data) + 1, _BASE))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])))
        back = np.cumprod(np.full(len(data) + 1, _INVERSE))  # takes out the position, so that equal words are equal anywhere
        hashes = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.concatenate(([0], np.searchsorted(starts, limits))))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, ``width`` words, or the whole sequence of fewer words; empty without words."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    out = []
    for start, stop in _parts(data):
        words, counts = word_hashes(data[start:stop])
        at = 0
        with np.errstate(over="ignore"):
            for n in counts:
                mine = words[at : at + n]
                k = min(width, n)
                acc = np.full(max(0, n - k + 1) if n else 0, np.uint64(k))
                for j in range(k):
                    acc = mix(acc * _BASE + mine[j : j + len(acc)])
                out.append(np.unique(acc))
                at += n
    return out


def _parts(data: list[bytes], limit: int = 250_000):
    """Slices of about ``limit`` bytes; a longer text is a slice of its own."""
    start = size = 0
    for i, d in enumerate(data):
        if size and size + len(d) > limit:
            yield start, i
            start, size = i, 0
        size += len(d)
    if start < len(data):
        yield start, len(data)
