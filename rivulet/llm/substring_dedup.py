"""Removal of long substrings that an earlier document also has, by suffix arrays.

1. Documents are packed into blocks of a few MB, compressed, so that each task works on arrays.
2. Texts are cut into pieces where their own bytes say so. A piece that, with the bytes its last
   windows reach into, also stands in a document with a smaller id is removed as it is: all its
   windows start there, too. Only the smallest document of each such piece takes part from here on.
   A block settles its own copies first and sends each piece once, for its smallest document.
   Pieces are told apart by 128 bits of a hash (12 bytes and the place); their bytes are not compared.
3. Every window of ``length`` bytes has an anchor: the short substring in it with the smallest
   hash (the leftmost of equal ones). A window is known by the hash of its anchor and of the bytes
   on the anchor's longer side. Equal windows have equal anchors, so windows meet by that hash;
   hashes that only one document has are dropped. Only 32 bits of a hash travel, besides the place
   they go to: a chance match costs work, not correctness.
4. What is left goes, as fragments of neighbouring windows, to one place for each hash. Equal
   fragments collapse; the others are sorted as one suffix array, in which windows whose common
   prefix with their neighbour reaches ``length`` are the same. Each window's smallest document
   tells which other documents lose it. A hash that very many blocks have is dealt out by the
   windows' own bytes instead. Here, too, a block sends each fragment or window for its smallest
   document only and removes it from its other documents itself.
5. The removed ranges go back to the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm._scratch import save, ship, shuffle_partitions
from rivulet.llm._tables import table
from rivulet.llm._text import mix
from rivulet.llm.suffix_array import U, common_prefixes, eights, suffix_array

_SHORT = 16  # bytes of the substrings whose hashes are compared
_STEP = 1 << 18  # windows hashed at a time
_BLOCK = 2 << 20
_SORTED = 2 << 20  # bytes in one suffix array
_HOT_BLOCKS = 24
_PIECE = U(127)  # one in so many positions and one starts a piece
_DIGEST = 12  # bytes of a piece's digest that travel, besides its place
_BROADCAST_PIECES = 16_000_000
_PER_PLACE = 8 << 20  # bytes of text for each place
_NO_ID = (1 << 63) - 1
_PLACE = U((1 << 20) - 1)
_C1, _C2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def _pack(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks: id, documents' ids and sizes, and their bytes (compressed)."""
    names = ["block", "ids", "sizes", "payload"]

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6).compress
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        data: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            return pa.record_batch(
                [
                    pa.array([part << 32 | number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(d) for d in data]], pa.list_(pa.int64())), pa.array([pack(b"".join(data))], pa.binary()),
                ],
                names,
            )

        for batch in rows:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                data.append((text or "").encode("utf-8", "surrogatepass"))
                held += len(data[-1])
                if held >= block_bytes:
                    yield block()
                    ids, data, held, number = [], [], 0, number + 1
        if ids:
            yield block()

    return docs.mapInArrow(packed, "block long, ids array<long>, sizes array<long>, payload binary")


def _pieces(data: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of the documents: first window, end of the windows that start in it, and document number."""
    cuts = [begin[size >= length]]
    stop = begin + size
    for low in range(0, len(data), _STEP):
        x = eights(data[low : low + _STEP + _SHORT])
        n = min(_STEP, len(x) - _SHORT)
        if n > 0:
            at = np.flatnonzero((mix(x[:n] * _C2 + x[8 : n + 8]) & _PIECE) == 0) + low
            cuts.append(at[at + _SHORT <= stop[np.searchsorted(begin, at, side="right") - 1]])
    start = np.unique(np.concatenate(cuts))
    doc = np.searchsorted(begin, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(data)), stop[doc] - length + 1)
    full = end > start
    return start[full], end[full], doc[full]


def _segments(pieces: tuple[np.ndarray, ...], gone: list[bytes] | None) -> tuple[np.ndarray, ...]:
    """Neighbouring pieces that take part, as one: first window, end of windows, document number."""
    start, end, doc = pieces
    keep = np.ones(len(start), dtype=bool)
    keep[_numbers(gone)] = False
    new = keep.copy()
    new[1:] &= ~(keep[:-1] & (end[:-1] == start[1:]) & (doc[:-1] == doc[1:]))
    first = np.flatnonzero(new)
    count = np.cumsum(keep)
    last = np.flatnonzero(keep)[np.append(count[first[1:] - 1], count[-1]) - 1] if len(first) else first
    return start[first], end[last], doc[first]


def _numbers(packed: list[bytes] | None) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    return np.concatenate([np.zeros(0, dtype=np.int32), *[np.frombuffer(unpack(x), dtype=np.int32) for x in packed or []]])


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed bytes of an array: the first, second... bytes of all numbers stand together."""
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes(), 3)


def _spread(packed: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    data = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8)
    return np.ascontiguousarray(data.reshape(width, -1).T).view(kind).ravel()


def _windows(data: np.ndarray, start_: np.ndarray, stop_: np.ndarray, doc_: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one hash: hash, first window, windows, document number."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    wide = length - _SHORT + 1
    half = (length - _SHORT) // 2
    more = min(16, half) if half >= 8 else 0  # bytes beside the anchor
    for low in range(0, max(0, len(data) - length + 1), _STEP):
        high = min(low + _STEP, len(data) - length + 1)
        first = max(0, np.searchsorted(start_, low, side="right") - 1)
        own = np.arange(first, np.searchsorted(start_, high))
        start, stop = np.maximum(start_[own], low), np.minimum(stop_[own], high)
        own, start, stop = (v[stop > start] for v in (own, start, stop))
        if not len(own):
            continue
        x = eights(data[low : high + length - 1])
        n = len(x) - _SHORT + 1
        h = mix(x[:n] * _C1 + mix(x[8 : n + 8] * _C2))
        key = (h & ~_PLACE) | np.arange(n, dtype=U)  # unique, and its end says where
        reach = 1
        while reach * 2 <= wide:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        if reach < wide:
            key = np.minimum(key[: len(key) - (wide - reach)], key[wide - reach :])
        new = np.empty(high - low, dtype=bool)
        new[0], new[1:] = True, key[1:] != key[:-1]
        new[start - low] = True
        use = np.zeros(high - low + 1, dtype=np.int32)
        use[start - low] += 1
        np.add.at(use, stop - low, -1)
        at = np.flatnonzero(new & (np.cumsum(use[:-1]) > 0))
        of = np.searchsorted(start, at + low, side="right") - 1
        doc, end = doc_[own[of]], np.minimum(np.append(at[1:], high - low), stop[of] - low)
        anchor = (key[at] & _PLACE).astype(np.int64)
        middle = np.clip(anchor - half + 1, at, end)  # before it the anchor's left side is the longer one
        for side, a, b in ((0, at, middle), (1, middle, end)):
            full = np.flatnonzero(b > a)
            p = anchor[full]
            found = h[p] * _C2 + U(side)
            if more:
                one, two = (p - more, p - 8) if not side else (p + _SHORT, p + _SHORT + more - 8)
                found = mix(found + mix(x[one] * _C1 + U(side))) + mix(x[two] * _C2)
            for o, v in zip(out, (mix(found), a[full] + low, (b - a)[full], doc[full]), strict=True):
                o.append(v)
    if not out[0]:
        return (np.zeros(0, dtype=U), *(np.zeros(0, dtype=np.int64),) * 3)
    return tuple(np.concatenate(o) for o in out)


def _at_place(h: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of a hash, and 32 further bits of it."""
    rest, place = np.divmod(h, U(places))
    return place.astype(np.int64), rest.astype(np.uint32)


def _unpacked(payload: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array(sizes, dtype=np.int64)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload, max_output_size=max(1, int(size.sum()))), dtype=np.uint8)
    return data, np.cumsum(size) - size, size


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a sorted partition by their first column."""
    now, rows = None, []
    for batch in batches:
        for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(tuple(row))
    if rows:
        yield now, rows


def _own_place(block: int, places: int) -> int:
    """Where what a block has found out by itself passes through."""
    return ((block >> 32) + (block & 0xFFFFFFFF)) % places


def _united(spans: list[tuple[int, int]]) -> np.ndarray:
    """Ranges in order, those that touch as one."""
    a, b = np.array(sorted(spans), dtype=np.int32).reshape(-1, 2).T
    reach = np.maximum.accumulate(b)
    first = np.flatnonzero(np.append(True, a[1:] > reach[:-1])) if len(a) else np.zeros(0, dtype=np.int64)
    return np.stack([a[first], reach[np.append(first[1:], len(a))[: len(first)] - 1]], axis=1)


def _least_of_equal(found: np.ndarray, id_of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of equal digests: the first of the smallest id, those of larger ids, and (number, first) of further ones of the smallest id."""
    high, low = np.ascontiguousarray(found).view(U).reshape(-1, 2).T
    order = np.lexsort((id_of, low, high))
    new = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))[: len(order)]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    larger = id_of[order] > id_of[first]
    twin = ~new & ~larger
    return order[new], order[larger].astype(np.int32), np.stack([order[twin], first[twin]], axis=1).astype(np.int32)


def _digests(blocks: DataFrame, length: int, places: int) -> DataFrame:
    """By place and block: distinct digests of pieces (with the bytes that their last windows reach into), smallest document ids, piece numbers.

    One more row of a block, without digests, holds the pieces that it removes itself and the further ones of the smallest ids.
    """

    def digested(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in rows:
            for block, ids, sizes, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "sizes", "payload")), strict=True):
                data, begin, size = _unpacked(payload, sizes)
                start, end, doc = _pieces(data, begin, size, length)
                raw = memoryview(data)
                digest = xxhash.xxh3_128_digest
                found = np.frombuffer(b"".join(digest(raw[a : b + length - 1], b - a) for a, b in zip(start.tolist(), end.tolist(), strict=True)), dtype=np.uint8).reshape(-1, 16)
                place = np.ascontiguousarray(found[:, _DIGEST:]).view(np.uint32).ravel() % np.uint32(places)
                id_of = np.array([_NO_ID if x is None else x for x in ids], dtype=np.int64)[doc]
                least, larger, twins = _least_of_equal(found, id_of)
                order = least[np.argsort(place[least], kind="stable")]
                full, cut = np.unique(place[order], return_index=True)  # places that the block has something for
                parts = np.split(order, cut[1:]) if len(order) else []
                out = [
                    (to, block, np.ascontiguousarray(found[o, :_DIGEST]).tobytes(), _packed(id_of[o]), _packed(o.astype(np.int32)))
                    for to, o in zip(full.tolist(), parts, strict=True)
                ]
                if len(larger) or len(twins):
                    out.append((_own_place(block, places), block, None, pack(larger.tobytes()), pack(twins.tobytes())))
                if out:
                    types = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["place", "block", "digests", "ids", "numbers"])

    return blocks.mapInArrow(digested, "place int, block long, digests binary, ids binary, numbers binary")


def _known_pieces(digests: DataFrame, places: int) -> DataFrame:
    """For each block the numbers of pieces that a document with a smaller id has, too."""

    def found(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for _, blocks in _groups(rows):
            own = [x for x in blocks if x[1] is None]
            if own:
                yield pa.record_batch([pa.array([x[i] for x in own], t) for i, t in ((0, pa.int64()), (2, pa.binary()), (3, pa.binary()))], names)
            blocks = [x for x in blocks if x[1] is not None]
            if not blocks:
                continue
            raw = np.frombuffer(b"".join(x[1] for x in blocks), dtype=np.uint8).reshape(-1, _DIGEST)
            high = np.ascontiguousarray(raw[:, :8]).view(U).ravel()
            low = np.ascontiguousarray(raw[:, 8:]).view(np.uint32).ravel()
            ids = np.concatenate([_spread(x[2], np.int64) for x in blocks])
            numbers = [_spread(x[3], np.int32) for x in blocks]
            of = np.repeat(np.arange(len(blocks)), [len(n) for n in numbers])
            number = np.concatenate(numbers)
            order = np.lexsort((ids, low, high))
            new = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1]))
            least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            lost = np.sort(order[ids[order] > least])
            cut = np.searchsorted(of[lost], np.arange(len(blocks) + 1))
            full = [i for i in range(len(blocks)) if cut[i + 1] > cut[i]]
            if full:
                yield pa.record_batch(
                    [
                        pa.array([blocks[i][0] for i in full], pa.int64()), pa.array([pack(number[lost[cut[i] : cut[i + 1]]].tobytes()) for i in full], pa.binary()),
                        pa.nulls(len(full), pa.binary()),
                    ],
                    names,
                )

    def with_twins(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for block, gone, twins in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                numbers = _numbers(gone)
                if twins is not None:
                    number, like = _numbers([twins]).reshape(-1, 2).T
                    numbers = np.append(numbers, number[np.isin(like, numbers)])
                if len(numbers):
                    out.append((block, [zstandard.compress(numbers.tobytes(), 3)], len(numbers)))
            if out:
                types = [pa.int64(), pa.list_(pa.binary()), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["block", "gone", "n"])

    names = ["block", "gone", "twins"]

    dealt = digests.repartition(min(places, 4 * shuffle_partitions(digests.sparkSession)), "place").sortWithinPartitions("place")
    by_block = dealt.mapInArrow(found, "block long, gone binary, twins binary").groupBy("block").agg(F.collect_list("gone").alias("gone"), F.max("twins").alias("twins"))
    return by_block.mapInArrow(with_twins, "block long, gone array<binary>, n long")


def _hashes(blocks: DataFrame, length: int, places: int) -> DataFrame:
    """By place and block: the block's distinct hashes, and whether two of its documents have each."""

    def hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for block, sizes, payload, gone in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "payload", "gone")), strict=True):
                data, begin, size = _unpacked(payload, sizes)
                h, _, _, doc = _windows(data, *_segments(_pieces(data, begin, size, length), gone), length)
                place, h = _at_place(h, places)
                order = np.lexsort((doc, h, place))
                h, doc, place = h[order], doc[order], place[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (place[1:] != place[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
                more = doc[first] != doc[np.append(first[1:], len(h)) - 1] if len(h) else np.zeros(0, dtype=bool)
                h, place = h[first], place[first]
                full, cut = np.unique(place, return_index=True)
                ranges = list(zip(cut.tolist(), [*cut[1:].tolist(), len(h)], strict=True)) if len(h) else []
                yield pa.record_batch(
                    [
                        pa.array(full.tolist(), pa.int32()), pa.array([block] * len(full), pa.int64()),
                        pa.array([_packed(np.diff(h[a:b], prepend=np.uint32(0))) for a, b in ranges], pa.binary()),  # steps between sorted hashes
                        pa.array([np.packbits(more[a:b]).tobytes() for a, b in ranges], pa.binary()),
                    ],
                    ["place", "block", "hashes", "more"],
                )

    return blocks.select("block", "sizes", "payload", "gone").mapInArrow(hashed, "place int, block long, hashes binary, more binary")


def _shared(hashes: DataFrame, places: int, hot_blocks: int) -> DataFrame:
    """For each block the hashes that other documents have too, and whether many blocks have them."""

    def found(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, blocks in _groups(rows):
            parts = [np.cumsum(_spread(x[1], np.uint32), dtype=np.uint32) for x in blocks]
            h = np.concatenate(parts)
            more = np.concatenate([np.unpackbits(np.frombuffer(x[2], dtype=np.uint8), count=len(p)) for x, p in zip(blocks, parts, strict=True)]).astype(bool)
            of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.argsort(h, kind="stable")
            h, more, of = h[order], more[order], of[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(first, len(h)))
            keep = (count > 1) | np.logical_or.reduceat(more, first)
            keep, hot = np.repeat(keep, count), np.repeat(count >= hot_blocks, count)
            h, of, hot = h[keep], of[keep], hot[keep]
            order = np.argsort(of, kind="stable")
            h, of, hot = h[order], of[order], hot[order]
            cut = np.searchsorted(of, np.arange(len(parts) + 1))
            full = [i for i in range(len(parts)) if cut[i + 1] > cut[i]]
            if full:
                yield pa.record_batch(
                    [
                        pa.array([blocks[i][0] for i in full], pa.int64()), pa.array([place] * len(full), pa.int32()),
                        pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()),
                        pa.array([hot[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()),
                    ],
                    ["block", "place", "hashes", "hot"],
                )

    dealt = hashes.repartition(min(places, 4 * shuffle_partitions(hashes.sparkSession)), "place").sortWithinPartitions("place")
    return dealt.mapInArrow(found, "block long, place int, hashes binary, hot binary").groupBy("block").agg(F.collect_list(F.struct("place", "hashes", "hot")).alias("shared"))


def _fragments(blocks: DataFrame, length: int, places: int) -> DataFrame:
    """By place and block: distinct fragments with the smallest document and its positions.

    One more row of a block, with nothing but bytes, holds the ranges that it removes from its other documents itself.
    """
    names = ["place", "block", "keys", "sizes", "bytes", "counts", "ids", "at"]

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in rows:
            for block, ids, sizes, payload, shared, gone in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "sizes", "payload", "shared", "gone")), strict=True):
                data, begin, size = _unpacked(payload, sizes)
                h, at, n, doc = _windows(data, *_segments(_pieces(data, begin, size, length), gone), length)
                parts = [np.frombuffer(x["hashes"], dtype=np.uint32) for x in shared]
                known = np.concatenate([p.astype(np.int64) | x["place"] << 32 for p, x in zip(parts, shared, strict=True)])
                hot = np.concatenate([np.frombuffer(x["hot"], dtype=bool) for x in shared])
                order = np.argsort(known)
                known, hot = known[order], hot[order]
                place, h = _at_place(h, places)
                h = h.astype(np.int64) | place << 32
                where = np.minimum(np.searchsorted(known, h), len(known) - 1)
                keep = known[where] == h
                h, at, n, doc, hot = h[keep], at[keep], n[keep], doc[keep], hot[where[keep]]
                raw = data.tobytes()
                id_of = [_NO_ID if x is None else x for x in ids]
                by: dict[int, dict[bytes, list]] = {}
                lost: list[tuple[int, int]] = []

                def note(to: int, x: bytes, short: int, doc: int, at: int, by: dict = by, lost: list = lost) -> None:
                    own = by.setdefault(to, {}).setdefault(x, [short, doc, []])
                    if doc > own[1]:
                        lost.append((at, at + len(x)))
                        return
                    if doc < own[1]:
                        lost.extend((i, i + len(x)) for i in own[2])
                        own[1:] = doc, []
                    own[2].append(at)

                for key, start, windows, d, very in zip(h.tolist(), at.tolist(), n.tolist(), doc.tolist(), hot.tolist(), strict=True):
                    if very:
                        for i in range(start, start + windows):
                            x = raw[i : i + length]
                            to, short = divmod(xxhash.xxh3_64_intdigest(x), 1 << 32)
                            note(to % places, x, short, id_of[d], i)
                    else:
                        note(key >> 32, raw[start : start + windows + length - 1], key & 0xFFFFFFFF, id_of[d], start)
                out: list[tuple] = []
                for place, own in sorted(by.items()):
                    out.append(
                        (
                            place, block, np.array([x[0] for x in own.values()], dtype=np.uint32).tobytes(), pack(np.array([len(b) for b in own], dtype=np.int32).tobytes()),
                            pack(b"".join(own)), pack(np.array([len(x[2]) for x in own.values()], dtype=np.int32).tobytes()),
                            pack(np.array([x[1] for x in own.values()], dtype=np.int64).tobytes()), pack(np.array([i for x in own.values() for i in x[2]], dtype=np.int32).tobytes()),
                        )
                    )
                if lost:
                    out.append((_own_place(block, places), block, None, None, _packed(_united(lost).ravel()), None, None, None))
                if out:
                    types = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return blocks.mapInArrow(cut, "place int, block long, keys binary, sizes binary, bytes binary, counts binary, ids binary, at binary")


def first_documents(parts: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each part and each window in it the smallest owner of a part that has the window.

    The parts stand behind each other in one suffix array; windows whose suffixes share a prefix
    of ``length`` with their neighbours are one window.
    """
    size = np.array([len(p) for p in parts], dtype=np.int64)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    begin = np.cumsum(size) - size
    part = np.repeat(np.arange(len(parts)), size)
    whole = np.arange(len(data)) - begin[part] <= size[part] - length  # a window that does not leave its part
    array = suffix_array(data, length)
    array = array[whole[array]]
    apart = common_prefixes(data, array, length) < length
    apart[:1] = True
    start = np.flatnonzero(apart)
    least = np.minimum.reduceat(owners[part[array]], start)
    out = np.full(len(data), _NO_ID, dtype=np.int64)
    out[array] = np.repeat(least, np.diff(np.append(start, len(array))))
    return [out[b : b + s - length + 1] for b, s in zip(begin.tolist(), size.tolist(), strict=True)]


def _removed(fragments: DataFrame, length: int, places: int) -> DataFrame:
    """For each block ranges (first byte, end) that a document with a smaller id also has."""

    def sort_parts(batch: list[tuple[bytes, list]], spans: dict[int, list]) -> None:
        owners = np.array([min(o[1] for o in own) for _, own in batch], dtype=np.int64)
        for (_, own), first in zip(batch, first_documents([b for b, _ in batch], owners, length), strict=True):
            add(own, first, spans)

    def add(own: list, first: np.ndarray, spans: dict[int, list]) -> None:
        edge = np.flatnonzero(first[1:] != first[:-1]) + 1
        runs = list(zip([0, *edge.tolist()], [*edge.tolist(), len(first)], first[[0, *edge.tolist()]].tolist(), strict=True))
        for block, doc, at in own:
            for a, b, least in runs:
                if least < doc:
                    spans.setdefault(block, []).append((at + a, at + b + length - 1))

    def searched(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for _, blocks in _groups(rows):
            by_key: dict[int, dict[bytes, list]] = {}
            own_spans = [(block, data) for block, keys, _, data, *_ in blocks if keys is None]
            if own_spans:
                yield pa.record_batch([pa.array([x[0] for x in own_spans], pa.int64()), pa.array([x[1] for x in own_spans], pa.binary())], ["block", "spans"])
            for block, keys, sizes, data, counts, ids, at in blocks:
                if keys is None:
                    continue
                low = o = 0
                sizes, data, counts, ids, at = map(unpack, (sizes, data, counts, ids, at))
                ids, at = np.frombuffer(ids, dtype=np.int64).tolist(), np.frombuffer(at, dtype=np.int32).tolist()
                for key, n, count, doc in zip(*(np.frombuffer(x, dtype=t).tolist() for x, t in ((keys, np.uint32), (sizes, np.int32), (counts, np.int32))), ids, strict=True):
                    own = by_key.setdefault(key, {}).setdefault(data[low : low + n], [])
                    own.extend((block, doc, at[k]) for k in range(o, o + count))
                    low, o = low + n, o + count
            spans: dict[int, list] = {}
            batch: list = []
            held = 0
            for own in by_key.values():
                if len(own) == 1:  # equal fragments: all windows belong to the smallest document
                    ((x, where),) = own.items()
                    least = min(o[1] for o in where)
                    for block, doc, at in where:
                        if least < doc:
                            spans.setdefault(block, []).append((at, at + len(x)))
                    continue
                batch.extend(own.items())
                held += sum(map(len, own))
                if held >= _SORTED:
                    sort_parts(batch, spans)
                    batch, held = [], 0
            if batch:
                sort_parts(batch, spans)
            if spans:
                yield pa.record_batch(
                    [pa.array(list(spans), pa.int64()), pa.array([_packed(_united(s).ravel()) for s in spans.values()], pa.binary())], ["block", "spans"]
                )

    dealt = fragments.repartition(min(places, 4 * shuffle_partitions(fragments.sparkSession)), "place").sortWithinPartitions("place")
    return dealt.mapInArrow(searched, "block long, spans binary").groupBy("block").agg(F.collect_list("spans").alias("spans"))


_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _kept(blocks: DataFrame, length: int, keep_bytes: bool) -> DataFrame:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.int64()] * 4 + [pa.string(), pa.binary()]

    def applied(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for ids, sizes, payload, spans, known in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "payload", "spans", "gone")), strict=True):
                data, begin, size = _unpacked(payload, sizes)
                start, end, _ = _pieces(data, begin, size, length)
                known = _numbers(known)
                parts = [_spread(s, np.int32).reshape(-1, 2) for s in spans or []]
                a = np.concatenate([start[known], *[p[:, 0] for p in parts]])
                b = np.concatenate([end[known] + length - 1, *[p[:, 1] for p in parts]])
                change = np.bincount(a, minlength=len(data) + 1) - np.bincount(b, minlength=len(data) + 1)
                gone, out = np.cumsum(change[:-1]) > 0, []
                for doc_id, b, n in zip(ids, begin.tolist(), size.tolist(), strict=True):
                    own, mine = gone[b : b + n], data[b : b + n]
                    lost = int(own.sum())
                    left = (mine[~own] if lost else mine).tobytes()
                    runs = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if lost else 0
                    out.append((doc_id, n, lost, runs, hashlib.sha256(left).hexdigest(), left if keep_bytes else None))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return blocks.mapInArrow(applied, _SCHEMA)


def remove_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 50, keep_bytes: bool = True,
    block_bytes: int = _BLOCK, hot_blocks: int = _HOT_BLOCKS,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, and the ``kept`` bytes if wanted.

    A byte is removed if a string of ``length`` bytes over it also starts in a document with a
    smaller id; strings do not cross documents, overlap, and are judged on the input. Null texts
    are empty; texts shorter than ``length`` stay; null ids count as largest; rows of one id are
    one document, so repeated rows all stay. Empty tables give no rows; further columns are ignored.
    ``block_bytes`` and ``hot_blocks`` (blocks with one hash from which it is dealt out by window)
    change only how the work is dealt out.
    """
    if length <= _SHORT or _STEP + length > int(_PLACE):
        raise ValueError(f"length must be above {_SHORT} and below 700,000")
    ship(docs.sparkSession)
    blocks = save(_pack(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), block_bytes), "blocks")
    total = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    places = max(shuffle_partitions(docs.sparkSession), -(-total // _PER_PLACE))

    gone = save(_known_pieces(_digests(blocks, length, places), places), "gone")
    few = (gone.agg(F.sum("n")).first()[0] or 0) <= _BROADCAST_PIECES
    gone = F.broadcast(gone.drop("n")) if few else gone.drop("n")
    parts = blocks.join(gone, "block", "left")

    shared = save(_shared(_hashes(parts, length, places), places, hot_blocks), "shared")
    fragments = _fragments(parts.join(shared, "block"), length, places)
    spans = save(_removed(fragments, length, places), "spans")
    done = parts.join(spans, "block", "left")
    kept = _kept(done, length, keep_bytes)
    return kept if keep_bytes else kept.drop("kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_bytes=False)


OP8_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS id, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT rid, id, unnest(range(0, octet_length(b) - 49)) AS i, b FROM d WHERE octet_length(b) >= 50
), s AS (
  SELECT rid, id, i, b[i + 1:i + 50] AS x FROM w
), f AS (
  SELECT rid, i FROM s JOIN (SELECT x, min(id) AS least FROM s GROUP BY x HAVING min(id) < max(id)) USING (x) WHERE least < id
), g AS (
  SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS span
  FROM (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY rid ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh FROM f)
), p AS (
  SELECT rid, span, min(i) AS start, max(i) + 50 AS stop FROM g GROUP BY rid, span
), q AS (
  SELECT rid, start, stop, coalesce(lag(stop) OVER (PARTITION BY rid ORDER BY start), 0) AS prior FROM p
), k AS (
  SELECT rid, count(*) AS n_spans, sum(stop - start) AS n_removed, max(stop) AS tail,
    string_agg(CASE WHEN start > prior THEN hex(b[prior + 1:start]) ELSE '' END, '' ORDER BY start) AS head FROM q JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN tail IS NULL THEN b WHEN tail < octet_length(b) THEN unhex(head) || b[tail + 1:octet_length(b)] ELSE unhex(head) END) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
