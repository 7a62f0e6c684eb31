"""64-bit hashes of words and word sequences in numpy; wrap-around arithmetic throughout."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
# Odd multipliers of the splitmix64 and murmur3 finalizers.
C1, C2, C3, C4 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xFF51AFD7ED558CCD)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


def scramble(x: np.ndarray, by: np.uint64 = C2) -> np.ndarray:
    x = (x ^ (x >> U(30))) * by
    x = (x ^ (x >> U(27))) * C3
    return x ^ (x >> U(31))


def join_hashes(left: np.ndarray, right: np.ndarray, by: np.uint64 = C1) -> np.ndarray:
    """A hash of the pair (left, right), order included."""
    x = (left ^ (left >> U(32))) * by + right
    x = (x ^ (x >> U(29))) * C4
    return x ^ (x >> U(32))


def windows(h: np.ndarray, length: int, by: np.uint64 = C1) -> np.ndarray:
    """Hash of each run of ``length`` consecutive elements, by joining runs of powers of two."""
    n = len(h) - length + 1
    if n <= 0:
        return h[:0]
    out, size, at, done = None, 1, h, 0
    left = length
    while left:
        if left & 1:
            part = at[done : done + n]
            out = part if out is None else join_hashes(out, part, by)
            done += size
        left >>= 1
        if left:
            at = join_hashes(at[:-size], at[size:], by)
            size *= 2
    return scramble(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
