"""Word hashing over whole batches of texts with numpy.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII
characters of the lower-cased text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_CHUNK = 1 << 18

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    return out


_POW = _powers(int(_BASE), 1 << 16)
_INV = _powers(pow(int(_BASE), -1, 1 << 64), 1 << 16)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = 1 << (n - 1).bit_length()
        _POW, _INV = _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a multiplicative hash)."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one more at the end).

    Null counts as empty.
    """
    data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data]) if data else np.zeros(0, dtype=np.int64)
    buf = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    if not len(buf):
        return np.zeros(0, dtype=U), np.zeros(len(texts) + 1, dtype=np.int64)
    is_word = _WORD[buf]
    edge = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=0, append=0))
    start, stop = edge[0::2], edge[1::2]
    power, inverse = _grown(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * power[: len(buf)], out=total[1:])
    words = mix((total[stop] - total[start]) * inverse[start])
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    first[1:] = np.searchsorted(start, ends)
    return words, first


def batches(rows: pa.RecordBatch, column: str, limit: int = _CHUNK) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a batch's texts with about ``limit`` characters each, so that memory stays bounded."""
    texts, begin, held, at = rows.column(column).to_pylist(), 0, 0, 0
    for at, t in enumerate(texts):
        held += len(t or "")
        if held >= limit:
            yield begin, texts[begin : at + 1]
            begin, held = at + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a text, and where each text's begin.

    A text of fewer than ``n`` words (but one at least) has one shingle of all its words.
    """
    count = np.diff(first)
    each = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    begin = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(each, out=begin[1:])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], each)
    length = np.repeat(np.minimum(count, n), each)
    padded = np.concatenate([words, np.zeros(n, dtype=U)])
    out = np.zeros(len(at), dtype=U)
    for k in range(n):
        out = out * _BASE + np.where(k < length, padded[at + k] | U(1), U(0))
    return mix(out), begin
