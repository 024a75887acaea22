"""Brute-force versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[0-9a-zA-Z_\x80-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def shingle_set(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_duplicates(rows, similarity=0.8):
    """{row number: (class, links)} of rows (id, text)."""
    sets = [shingle_set(t) if i is not None else frozenset() for i, t in rows]
    root, links = list(range(len(rows))), Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common / len(sets[a] | sets[b]) >= similarity:
                links[a] += 1
                links[b] += 1
                p, q = sorted((top(a), top(b)), key=lambda x: rows[x][0])
                root[q] = p
    least = defaultdict(lambda: None)
    for a in range(len(rows)):
        t, i = top(a), rows[a][0]
        if i is not None and (least[t] is None or i < least[t]):
            least[t] = i
    return sorted(((rows[a][0], least[top(a)], links[a]) for a in range(len(rows))), key=repr)


def removed(rows, length=50):
    big = (1 << 63) - 1
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            x = b[p : p + length]
            first[x] = min(first.get(x, big), big if i is None else i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (big if i is None else i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, x in zip(b, gone) if not x)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)
