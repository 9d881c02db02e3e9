"""Winnowed anchors: k-gram hashes of a text of which the minimum of every window of w is kept.

Two texts with a common substring of k + w - 1 or more characters share at least one anchor at matching places.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(31)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def kgram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each k-gram: a polynomial by doubling (log k passes), with a final mix."""
    n = len(points) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        level = points.astype(np.uint64) + np.uint64(1)
        level = (level ^ (level >> np.uint64(7))) * _MIX1
        total, done, size, power = None, 0, 1, _BASE
        rest = k
        while rest:
            if rest & 1:
                part = level[done : done + n]
                total = part.copy() if total is None else total * power + part
                done += size
            rest >>= 1
            if rest:
                m = len(level) - size
                level = level[:m] * power + level[size : size + m]
                level ^= level >> _SHIFT
                size *= 2
                power = power * power + np.uint64(2)
        h = total
        h = (h ^ (h >> np.uint64(30))) * _MIX1
        h = (h ^ (h >> np.uint64(27))) * _MIX2
        return h ^ (h >> _SHIFT)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, in linear time (forward and backward minima of blocks)."""
    n = len(h)
    if n <= w:
        return h.min(keepdims=True)
    pad = -n % w
    full = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    pre = np.minimum.accumulate(full, axis=1).ravel()
    suf = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def anchors(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the winnowed k-grams. Every place that holds its window's minimum is kept, except that a
    run of equal hashes at neighbouring places (a periodic text) keeps its two ends."""
    h = kgram_hashes(code_points(text), k)
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64), h
    mins = window_minima(h, w)
    keep = np.zeros(n, bool)
    # A place is kept if it equals the minimum of some window that holds it.
    low = mins if len(mins) == 1 else mins
    change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    ends = np.concatenate([change[1:] - 1, [len(low) - 1]])
    for a, b in zip(change, ends):
        lo, hi = a, min(n, b + w)
        keep[lo:hi] |= h[lo:hi] == low[a]
    pos = np.flatnonzero(keep)
    hp = h[pos]
    if len(pos) > 2:
        same = (hp[1:] == hp[:-1]) & (pos[1:] - pos[:-1] == 1)
        inner = np.zeros(len(pos), bool)
        inner[1:-1] = same[:-1] & same[1:]
        pos, hp = pos[~inner], hp[~inner]
    return pos, hp
