"""Word and shingle hashing over raw UTF-8 bytes, and fast similarity sketches, in numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; A-Z are lower-cased.  A word's
hash is a polynomial over randomised byte values modulo 2^64, mixed with its length; a shingle's
hash mixes the hashes of its words in order.  Two different shingles share a 64-bit hash with a
chance of about 5e-20, so sets of hashes stand for sets of shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**61)) * 8 + 5
_COMB = _rng.integers(1, 2**63, WIDTH + 1, dtype=np.uint64) | np.uint64(1)
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
_PW = np.zeros(0, np.uint64)
_PWI = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every bit."""
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x = x * _M2
    x ^= x >> _S
    return x


def _powers(n: int) -> None:
    global _PW, _PWI
    if len(_PW) < n:
        n = max(n, BLOCK + 1024)
        inv = pow(_BASE, -1, 1 << 64)
        for name, b in (("_PW", _BASE), ("_PWI", inv)):
            p = np.full(n, np.uint64(b), np.uint64)
            p[0] = 1
            globals()[name] = np.cumprod(p, dtype=np.uint64)


def _block(a: np.ndarray) -> np.ndarray:
    n = len(a)
    _powers(n + 1)
    word = np.zeros(n + 2, np.int8)
    word[1:-1] = ~_SEP[a]
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[a] * _PW[:n], out=run[1:])
    return mix((run[end] - run[start]) * _PWI[start] + (end - start).astype(np.uint64) * _COMB[WIDTH])


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a text, in order; long texts go block by block."""
    a = _LOWER[np.frombuffer(data, np.uint8)]
    if len(a) <= BLOCK:
        return _block(a) if len(a) else np.zeros(0, np.uint64)
    out, at = [], 0
    while at < len(a):
        end = min(at + BLOCK, len(a))
        while end < len(a) and not _SEP[a[end]]:
            step = _SEP[a[end : end + BLOCK]]
            end += int(step.argmax()) if step.any() else len(step)
        out.append(_block(a[at:end]))
        at = end
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; with fewer words, one for the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += words[j : n - k + 1 + j] * _COMB[j]
    return mix(total + np.uint64(k))


def shingle_set(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(data), width))


def digest(s: np.ndarray) -> bytes:
    """128 bits that identify a shingle set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


_GOLD = 0x9E3779B97F4A7C15


def sketch(s: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch (Dahlgaard, Knudsen and Thorup) of t coordinates of a non-empty set.

    In round i < t every element takes a random bin and the value i + u, 0 <= u < 1; in rounds
    t to 2t - 1 every element goes to bin i - t, so each coordinate is filled for certain.  A
    bin keeps its least value; rounds end once all bins are filled.  The expected work is
    O(t log t + |s|), and two sets agree in a coordinate with a probability of their similarity.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, full, np.uint64)
    n, i = len(s), 0
    need = t * (np.log(t) + 3)
    while i < t:
        rounds = min(t - i, max(1, int(need // n) + 1), max(1, (1 << 20) // n))
        salt = np.array([(j * _GOLD) & 0xFFFFFFFFFFFFFFFF for j in range(i + 1, i + rounds + 1)], np.uint64)
        h = mix(s[None, :] ^ salt[:, None])
        bins = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64)
        value = (h & np.uint64((1 << 40) - 1)) | (np.arange(i, i + rounds, dtype=np.uint64) << np.uint64(40))[:, None]
        np.minimum.at(out, bins.ravel(), value.ravel())
        i += rounds
        if not (out == full).any():
            return out
    for j in np.flatnonzero(out == full):
        h = mix(s ^ np.uint64(((t + int(j) + 1) * _GOLD) & 0xFFFFFFFFFFFFFFFF))
        out[j] = (h & np.uint64((1 << 40) - 1)).min() | (np.uint64(t + int(j)) << np.uint64(40))
    return out


def band_keys(sk: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; the band's number is part of it."""
    b = len(sk) // rows
    part = mix(sk[: b * rows].reshape(b, rows) * _COMB[:rows] + np.arange(1, b + 1, dtype=np.uint64)[:, None])
    key = part[:, 0].copy()
    for j in range(1, rows):
        key = mix(key * _COMB[j] + part[:, j])
    return key
