"""Hashes of words and word runs, whole batches of texts at a time.

Words are runs of bytes other than the ASCII white space of
``bytes.split``.  All arithmetic is modulo 2**64; equal words (and equal runs
of words) have equal hashes in every task.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed in one go; a longer word is still hashed whole.
SLICE = 1 << 20


class _Powers:
    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            size = max(n, SLICE + 1)
            steps = np.full(size, self.base, np.uint64)
            steps[0] = 1
            self.table = np.multiply.accumulate(steps)
        return self.table[:n]


_POWERS, _INVERSES = _Powers(_BASE), _Powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _slice_hashes(b: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWERS.upto(len(b)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _INVERSES.upto(len(b) + 1)[start])


def word_hashes(text: bytes) -> np.ndarray:
    """One hash for each word, in order."""
    b = np.frombuffer(text, np.uint8)
    if len(b) <= SLICE:
        return _slice_hashes(b)
    out, at = [], 0
    while at < len(b):
        end = at + SLICE
        while end < len(b):  # move on to the next white space
            space = np.flatnonzero(_SPACE[b[end:end + SLICE]])
            if len(space):
                end += int(space[0])
                break
            end += SLICE
        out.append(_slice_hashes(b[at:end]))
        at = end
    return np.concatenate(out)


def batch_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, and where each text's end."""
    hashes = []
    counts = np.zeros(len(texts), np.int64)
    group: list[int] = []
    size = 0

    def flush():
        nonlocal size
        if not group:
            return
        joined = b"\n".join(texts[i] for i in group)
        h = word_hashes(joined)
        # words before each text's end, from the white space map of the join
        b = np.frombuffer(joined, np.uint8)
        starts = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b]]).astype(np.int8)) == -1)
        ends = np.cumsum([len(texts[i]) + 1 for i in group]) - 1
        upto = np.searchsorted(starts, ends)
        counts[group] = np.diff(np.concatenate([[0], upto]))
        hashes.append(h)
        group.clear()
        size = 0

    for i, t in enumerate(texts):
        group.append(i)
        size += len(t) + 1
        if size >= SLICE // 2:
            flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.cumsum(counts)


def run_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of every ``k`` consecutive words (by their word hashes)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + h[j:j + n]
    return mix(out)


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the words from ``start`` up to ``end``, for each pair."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _POWERS.upto(len(h)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _INVERSES.upto(len(h) + 1)[start] ^ (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` consecutive values, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out
