"""Vectorised helpers on code arrays, used inside tasks."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of 64-bit words (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: scrambled values of the small codes, so that most lookups are one gather
_SMALL = mix(np.arange(1 << 16, dtype=np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def segment_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``codes[s:e]``; they depend on the segment alone.

    A polynomial in a fixed odd base modulo 2**64, taken from running sums."""
    n = len(codes)
    power, inverse = _powers(n + 1)
    small = _SMALL[codes] if codes.dtype != np.uint32 else np.where(codes < 1 << 16, _SMALL[codes & 0xFFFF], mix(codes))
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(small * power[:n], out=run[1:])
    value = (run[ends] - run[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def groups_by_size(sizes: list[int], limit: int):
    """Ranges (a, b) of consecutive items whose sizes sum up to about ``limit``."""
    a = total = 0
    for b, n in enumerate(sizes):
        if total and total + n > limit:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(s, s + n)`` of all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)


def cut_at_blanks(data: bytes, limit: int):
    """Pieces of about ``limit`` bytes, cut at blanks or line ends only."""
    while len(data) > limit:
        at = max(data.rfind(b" ", 0, limit), data.rfind(b"\n", 0, limit))
        if at <= 0:
            at = min((x for x in (data.find(b" ", limit), data.find(b"\n", limit)) if x > 0), default=len(data))
        yield data[:at]
        data = data[at:]
    yield data
