"""Suffix arrays by two-stage sorting, with numpy.

Only the suffixes that are smaller than their successors are sorted directly, by eight bytes at a
time; all others follow from one scan over the buckets of first bytes, in which every suffix that
is reached puts its predecessor at the end of that one's bucket.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BYTES = np.array([1 << 8 * i for i in range(1, 8)], dtype=U)


def eights(data: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as one big-endian number (zeros after the end)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    out = np.empty(n, dtype=U)
    for o in range(min(8, n)):
        count = (n - o + 7) // 8
        out[o::8] = padded[o : o + 8 * count].view(">u8")
    return out


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """Whether the suffix at a position is smaller than the one at the next (the empty one is smallest)."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=bool)
    step = np.append(np.sign(data[1:].astype(np.int16) - data[:-1].astype(np.int16)), -1)
    where = np.where(step != 0, np.arange(n), n)  # runs of one byte are decided by their end
    return step[np.minimum.accumulate(where[::-1])[::-1]] > 0


def _sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their next ``depth`` bytes, those that are equal so far in the order given."""
    key = words[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(at) else np.zeros(0, dtype=np.int64)
    n = len(words)
    for done in range(8, depth, 8):
        size = np.bincount(group) if len(group) else np.zeros(0, dtype=np.int64)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        sub = at[tied]
        nxt = sub + done
        key = np.where(nxt < n, words[np.minimum(nxt, n - 1)], U(0))
        order = np.lexsort((key, group[tied]))
        at[tied] = sub[order]
        key = key[order]
        new = np.zeros(len(at), dtype=np.int64)
        new[1:] = group[1:] != group[:-1]
        apart = np.zeros(len(tied), dtype=np.int64)
        apart[1:] = (key[1:] != key[:-1]) & (group[tied][1:] == group[tied][:-1])
        new[tied] += apart
        group = np.cumsum(new)
    return at


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions of all suffixes of a byte array in order; with ``depth`` in order of so many bytes at least."""
    n = len(data)
    depth = n + 8 if depth is None else depth
    words = eights(data)
    small = smaller_than_successor(data)
    direct = _sort_directly(np.flatnonzero(small), words, depth)
    border = np.searchsorted(data[direct], np.arange(257)) if len(direct) else np.zeros(257, dtype=np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def put(before: np.ndarray, byte: np.ndarray) -> None:
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cut = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        for part in np.split(before, cut):
            waiting[data[part[0]]].append(part)

    def preceding(wave: np.ndarray) -> np.ndarray:
        p = wave[wave > 0] - 1
        return p[~small[p]]

    if n:
        waiting[data[n - 1]].append(np.array([n - 1]))
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        while len(wave):
            out.append(wave)
            p = preceding(wave)
            byte = data[p]
            inside = byte == c
            if not inside.all():
                put(p[~inside], byte[~inside])
            wave = p[inside]
        wave = direct[border[c] : border[c + 1]]
        if len(wave):
            out.append(wave)
            p = preceding(wave)
            if len(p):
                put(p, data[p])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def common_prefixes(data: np.ndarray, array: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that neighbours in the suffix array have in common, ``limit`` at most (the first: 0)."""
    n = len(array)
    out = np.zeros(n, dtype=np.int64)
    open_ = np.arange(1, n)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = eights(padded)
    left = np.maximum(len(data) - np.maximum(array[1:], array[:-1]), 0)  # bytes of the shorter one
    for done in range(0, limit, 8):
        a = words[np.minimum(array[open_] + done, len(data))]
        b = words[np.minimum(array[open_ - 1] + done, len(data))]
        same = a == b
        apart = open_[~same]
        if len(apart):
            x = (a ^ b)[~same]
            out[apart] = done + 7 - np.searchsorted(_BYTES, x, side="right")
        open_ = open_[same]
        out[open_] = done + 8
        if not len(open_):
            break
    out[1:] = np.minimum(np.minimum(out[1:], left), limit)
    return out
