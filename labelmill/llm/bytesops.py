"""Word hashing over the UTF-8 bytes of a text, in numpy: no Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))
_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_PIECE = 1 << 18
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, _PIECE + 1)
        for i, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't ASCII white space."""
    padded = np.empty(len(data) + 2, bool)
    padded[0] = padded[-1] = True
    np.take(_SPACE, data, out=padded[1:-1])
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return edges[::2], edges[1::2]


def pieces(raw: bytes, size: int = _PIECE) -> Iterator[bytes]:
    """The text cut behind white space into pieces of about ``size`` bytes; a longer word stays whole."""
    at, n = 0, len(raw)
    while at < n:
        end = min(at + size, n)
        while end < n and not _SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def hash_words(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order."""
    found = []
    for piece in pieces(raw):
        data = np.frombuffer(piece, np.uint8)
        starts, ends = word_bounds(data)
        if len(starts):
            powers, inverses = power_tables(len(data) + 1)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_VALUE[data] * powers[: len(data)], out=sums[1:])
            found.append(mix64((sums[ends] - sums[starts]) * inverses[starts]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; fewer words count as one run, none as no run."""
    n = len(words)
    if n < width:
        width = n
    if not n:
        return words
    h = words[: n - width + 1].copy()
    for i in range(1, width):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + words[i : n - width + 1 + i] + np.uint64(i))
    return h
