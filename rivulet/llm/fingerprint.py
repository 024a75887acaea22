"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of sentences.

Paragraphs are lines; a section ends after a paragraph whose digest is divisible by four (so that
an edit moves at most the sections around it); the leaves are up to five words of a sentence each.
A leaf's digest is that of its text, a paragraph's that of its leaves' digests, a section's that of
its paragraphs', the root's that of the sections' (128 bits each, BLAKE2).

A fingerprint is ``root.shape.leaves``: the root, the number of leaves of each paragraph ("," between
paragraphs, "/" between sections), and the first 64 bits of each leaf's digest. Equal roots mean
equal texts. Fingerprints are compared from the root down: equal branches are matched in order and
not looked into, differing ones are descended, so that what is left are the edited leaves.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm._chunks import with_neighbours
from rivulet.llm._scratch import ship, shuffle_partitions
from rivulet.llm._tables import table

_PIECE = re.compile(r"(?:\S*[^\s.!?]\s+){0,4}\S*\s*")
_LONGEST = 256
_LEAF = 8  # bytes of a leaf's digest that a fingerprint keeps


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _pieces(paragraph: str) -> list[str]:
    out = []
    for x in _PIECE.findall(paragraph):
        if len(x) <= _LONGEST:
            if x:
                out.append(x)
        else:
            out.extend(x[i : i + _LONGEST] for i in range(0, len(x), _LONGEST))
    return out


@dataclass(slots=True)
class Tree:
    """``sections``: lists of paragraphs, which are the kept bytes of their leaves one behind the other."""

    root: str
    sections: list[list[bytes]]

    @property
    def leaves(self) -> int:
        return sum(len(p) for s in self.sections for p in s) // _LEAF


def tree(text: str) -> Tree:
    sections: list[list[bytes]] = [[]]
    nodes: list[bytes] = []
    held: list[bytes] = []
    for paragraph in text.split("\n"):
        own = [_digest(x.encode("utf-8", "surrogatepass")) for x in _pieces(paragraph)]
        node = _digest(b"p" + b"".join(own))
        sections[-1].append(b"".join([x[:_LEAF] for x in own]))
        held.append(node)
        if node[-1] & 3 == 0:
            nodes.append(_digest(b"s" + b"".join(held)))
            sections.append([])
            held = []
    if held:
        nodes.append(_digest(b"s" + b"".join(held)))
    else:
        sections.pop()
    return Tree(_digest(b"r" + b"".join(nodes)).hex(), sections)


def fingerprint_of(t: Tree) -> str:
    shape = "/".join(",".join(str(len(p) // _LEAF) for p in s) for s in t.sections)
    return f"{t.root}.{shape}.{base64.b64encode(b''.join(p for s in t.sections for p in s)).decode()}"


def fingerprint(text: str | None) -> str:
    return fingerprint_of(tree(text or ""))


def read(print_: str) -> Tree:
    """The tree of a fingerprint."""
    root, shape, data = print_.split(".")
    leaves, at, out = base64.b64decode(data), 0, []
    for section in shape.split("/"):
        out.append([])
        for n in map(int, section.split(",")):
            out[-1].append(leaves[at : at + n * _LEAF])
            at += n * _LEAF
    return Tree(root, out)


def _in_order(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Positions of equal items, rising in both: common beginning and end, and between them the longest
    rising chain of the first with the first, the second with the second... of each item."""
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    end = 0
    while end < high - low and a[-1 - end] == b[-1 - end]:
        end += 1
    head = [(i, i) for i in range(low)]
    tail = [(len(a) - end + k, len(b) - end + k) for k in range(end)]
    places: dict = {}
    for j in range(len(b) - end - 1, low - 1, -1):
        places.setdefault(b[j], []).append(j)
    pairs = [(i, places[a[i]].pop()) for i in range(low, len(a) - end) if places.get(a[i])]
    tops: list[int] = []
    chain: list[int] = []  # the pair that ends the best chain of each length
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tops, j)
        before.append(chain[n - 1] if n else -1)
        tops[n : n + 1] = [j]
        chain[n : n + 1] = [k]
    k, middle = chain[-1] if chain else -1, []
    while k >= 0:
        middle.append(pairs[k])
        k = before[k]
    return head + middle[::-1] + tail


def _gaps(a: Sequence, b: Sequence, pairs: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """What lies between matched items: ranges of a and of b."""
    x = y = 0
    for i, j in [*pairs, (len(a), len(b))]:
        if i > x or j > y:
            yield x, i, y, j
        x, y = i + 1, j + 1


def _compare(a: Tree, b: Tree, gone: list | None = None) -> int:
    """Leaves in common; ``gone`` gets the (section, paragraph) of ``a`` that differing branches lead to."""
    sections = [[b"".join([len(p).to_bytes(4, "big") + p for p in s]) for s in t.sections] for t in (a, b)]
    same = _in_order(*sections)
    common = sum(sum(map(len, a.sections[i])) for i, _ in same)
    for x, x_end, y, y_end in _gaps(*sections, same):  # descend
        one = [(i, k, p) for i in range(x, x_end) for k, p in enumerate(a.sections[i])]
        two = [p for s in b.sections[y:y_end] for p in s]
        own = [p for _, _, p in one]
        same_here = _in_order(own, two)
        common += sum(len(own[i]) for i, _ in same_here)
        for u, u_end, v, v_end in _gaps(own, two, same_here):
            if gone is not None:
                gone += [one[i][:2] for i in range(u, u_end)]
            left, right = ([p[k : k + _LEAF] for p in ps for k in range(0, len(p), _LEAF)] for ps in (own[u:u_end], two[v:v_end]))
            common += _LEAF * len(_in_order(left, right))
    return common // _LEAF


def alike(a: Tree, b: Tree) -> float:
    """Twice the leaves in common, in order, over all leaves of both; 1 for equal roots."""
    if a.root == b.root:
        return 1.0
    every = a.leaves + b.leaves
    return 2.0 * _compare(a, b) / every if every else 1.0


def likeness(one: str, other: str) -> float:
    """:func:`alike` of two fingerprints. Text that has moved counts as differing where it crosses other text."""
    return alike(read(one), read(other))


def differences(one: str, other: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``one`` that differing branches lead to: where the edits are."""
    a, b, out = read(one), read(other), []
    if a.root != b.root:
        _compare(a, b, out)
    return out


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, edited_section int, edited_paragraph int"
)
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _compared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order of their keys; each is compared with the row that stands before it (its next)."""
    chunk, following, out, size = None, None, [], 0
    for batch in rows:
        columns = [batch.column(c).to_pylist() for c in ("chunk", "lent", "doc_id", "text")]
        for c, lent, doc_id, text in zip(*columns, strict=True):
            text = text or ""
            if c != chunk:
                chunk, following = c, None
            now = (text, tree(text))
            if not lent:
                nxt = following or now
                edited = edited_text(text, nxt[0])
                other, gone = tree(edited), []
                every = now[1].leaves + other.leaves
                near = 1.0 if other.root == now[1].root or not every else 2.0 * _compare(now[1], other, gone) / every
                row = (
                    doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint_of(now[1]), fingerprint_of(other),
                    near, alike(now[1], nxt[1]), *(gone[0] if gone else (None, None)),
                )
                out.append(row)
                size += len(row[3]) + len(row[4]) + 200
            following = now
            if size > 4 << 20:
                yield _batch(out)
                out, size = [], 0
    if out:
        yield _batch(out)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and the first section and
    paragraph of the text that the edit changed (null where it changed none).

    The next document is the one with the next smaller id (after the smallest: the largest); a
    document that stands alone is its own next. Null texts are empty; null ids count as smallest;
    rows of one id stand in order of their texts. Empty tables give no rows; further columns are
    ignored. Texts are dealt out by id once; only the row at each border goes to two tasks.
    """
    spark = ship(docs.sparkSession)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), key.alias("key"))
    n = 4 * shuffle_partitions(spark)
    dealt = with_neighbours(slim, "key", "bigint", n, before=True, after=False, ring=True)
    # a lent row is the largest of the range below (or of all, for the lowest range) and comes first
    ordered = dealt.sortWithinPartitions("chunk", F.col("lent").desc(), "key", "text")
    return ordered.select("chunk", "lent", "doc_id", "text").mapInArrow(_compared, _SCHEMA)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
