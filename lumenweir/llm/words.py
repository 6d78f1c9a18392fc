"""Vectorised words, word hashes and window hashes over the UTF-8 bytes of many texts at once.

A word is a run of bytes other than the six ASCII white-space characters, ``[^\\x20\\x09-\\x0D]+``; those
bytes never occur inside a UTF-8 sequence, so byte runs are exactly the words of the text.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=U)


_BYTES = {seed: _table(seed) for seed in (1, 2)}
_POWERS: dict[int, np.ndarray] = {}


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z and nothing else."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64 for an odd base, or of its inverse."""
    key = pow(base, -1, 1 << 64) if inverse else base
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), key, U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U)
        if len(have) <= 1 << 23:
            _POWERS[key] = have
    return have[:n]


def spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text boundary the number of words before it (n + 1 values).

    space: a flag for each byte value, of ASCII characters that are part of no word."""
    if not len(buf):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~space[buf]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offs[:-1][offs[:-1] < len(buf)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word that depends on its bytes alone."""
    if not len(starts):
        return np.empty(0, U)
    base = _ODD if seed == 1 else 0xD1342543DE82EF95
    n = len(buf)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(_BYTES[seed][buf] * powers(base, n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(base, n, True)[starts])


def windows(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive words, by the index of the first; they may run over text boundaries."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U)
    base = 0xA0761D6478BD642F if seed == 1 else 0xE7037ED1A0B428DB
    if size <= 8:
        out = np.zeros(n, U)
        for j in range(size):
            out += words[j : j + n] * U(pow(base, j, 1 << 64))
        return mixed(out)
    sums = np.empty(len(words) + 1, U)
    sums[0] = 0
    np.cumsum(words * powers(base, len(words)), out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * powers(base, n, True))


def inside_text(first: np.ndarray, size: int) -> np.ndarray:
    """Indices of the words at which a window of `size` words of one text starts."""
    n = int(first[-1])
    owner_end = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    return at[at + size <= owner_end] if n else at


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values`, which are given for each word or byte, over each text."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]
