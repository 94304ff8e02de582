"""Hashes of all windows of a text's words, and the few of them an index keeps (numpy only)."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Words in a window; a repeat is at least so long.
WINDOW = 50
#: Words in the pieces of a window of which the least hash is its anchor.
PIECE = 8
_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(32)


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # of bytes: at ASCII white space


def word_hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def rolled(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of every n consecutive words: a polynomial modulo 2^64, by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done = np.zeros(len(h) - n + 1, np.uint64), 0
    part, size, power = _mixed(h * base), 1, base  # hashes of `size` words, and base^size modulo 2^64
    while n >> (size.bit_length() - 1):
        if n & size:
            out = out * power + part[done : done + len(out)]
            done += size
        if 2 * size <= n:
            part = part[: len(part) - size] * power + part[size:]
        size, power = 2 * size, np.uint64(int(power) ** 2 % (1 << 64))
    return _mixed(out)


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    size = 1
    while 2 * size <= n:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    rest = n - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def anchors(h: np.ndarray) -> np.ndarray:
    """Of every window, the least hash of its pieces: equal windows have equal anchors."""
    if len(h) < WINDOW:
        return np.zeros(0, np.uint64)
    return sliding_min(rolled(h, PIECE, _BASES[0]), WINDOW - PIECE + 1)


def spans(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of consecutive windows of one anchor, at most WINDOW - PIECE + 1 each: anchor, first
    window, last window (the first and the last window cover all words of a stretch together)."""
    a = anchors(h)
    if not len(a):
        return (a, *[np.zeros(0, np.int64)] * 2)
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    most = WINDOW - PIECE + 1
    parts = -(-np.diff(np.append(start, len(a))) // most)
    first = np.repeat(start, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return a[first], first, np.append(first[1:], len(a)) - 1


def identities(w: list[bytes], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the SHA-256 of the words that the windows from `first` to `last` cover, one space between
    two, as two columns: the identity of the words themselves, whatever their hashes."""
    joined = b" ".join(w)
    at = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    begin = (at[first] - [len(w[i]) + 1 for i in first.tolist()]).tolist() if len(first) else []
    end = (at[last + WINDOW - 1] - 1).tolist() if len(last) else []
    sha = hashlib.sha256
    both = np.frombuffer(b"".join([sha(joined[a:b]).digest()[:16] for a, b in zip(begin, end)]), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()
