"""N-gram Jaccard join of documents by a MinHash LSH forest with exact verification.

Texts with equal sets of five-word shingles are one node. Every tree of the forest is a trie of
MinHash signatures of its own, kept as sorted binary keys: what nodes share of their keys' beginnings
is their path in the trie. Candidates come from the longest prefix first. Then matched prefixes are
shortened: only trie nodes that branch below the shorter one bring new pairs, and pairs that met
under the longer prefix, or in an earlier tree, are not looked at again.

How far prefixes are shortened depends on what is found. A link of similarity s has met by now with
the probability 1 - (1 - s^length)^trees; so the similarities of the links found tell how many are
still missing and how short prefixes have to become to reach the recall; after that round the
estimate is made anew. It stops at :func:`shortest_prefix` at the latest, where even pairs just at
the threshold reach the recall.

Candidates are verified on their whole shingle sets, inside blocks of bounded size: a prefix with
more nodes than a block is dealt out as pairs of blocks, so that no pair is lost and none becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm._scratch import save, ship, shuffle_partitions
from rivulet.llm._tables import table
from rivulet.llm._text import U, batches, mix, shingles, word_hashes

TREES, LONGEST = 24, 8
_WIDTH = 2  # bytes of each minimum in a key
_BLOCK, _BLOCK_BYTES = 1024, 4 << 20
_BROADCAST_BYTES = 32 << 20
_BINS = 20  # of the similarities from the threshold to 1
_HOT_KEYS, _SALTS = 1_000, 64

_RANDOM = np.random.default_rng(7)
_A = _RANDOM.integers(1, 1 << 63, TREES * LONGEST, dtype=np.int64).astype(U) * U(2) + U(1)
_B = _RANDOM.integers(0, 1 << 63, TREES * LONGEST, dtype=np.int64).astype(U)


def met(similarity: float, length: int, trees: int = TREES) -> float:
    """Probability that a pair of this similarity shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def shortest_prefix(similarity: float, recall: float, trees: int = TREES, longest: int = LONGEST) -> int:
    """The longest prefix at which some tree matches a pair of this similarity with probability ``recall``."""
    return next((n for n in range(longest, 1, -1) if met(similarity, n, trees) >= recall), 1)


def estimated_recall(bins: list[int], length: int, similarity: float, at: int | None = None) -> float:
    """Share of all links that are found down to the prefix length ``at``, from the numbers of links
    by similarity that were found down to ``length``."""
    known = [met(similarity + k * (1 - similarity) / _BINS, length) for k in range(_BINS)]
    then = [met(similarity + k * (1 - similarity) / _BINS, at or length) for k in range(_BINS)]
    every = sum(n / p for n, p in zip(bins, known, strict=True))
    return sum(n / p * q for n, p, q in zip(bins, known, then, strict=True)) / every if every else 0.0


def trie_keys(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row per text (each has a shingle at least): by tree, its signature as 16-bit minima, high bytes first."""
    out = np.zeros((len(begin) - 1, TREES * LONGEST), dtype=">u2")
    for k in range(TREES * LONGEST):
        least = np.minimum.reduceat((values * _A[k] + _B[k]) >> U(32), begin[:-1])
        out[:, k] = mix(least) >> U(48)
    return out.reshape(len(out), TREES, LONGEST)


def _sets(texts: list[str | None], n: int) -> Iterator[tuple[int, np.ndarray]]:
    values, begin = shingles(*word_hashes(texts), n)
    for i in range(len(texts)):
        if begin[i + 1] > begin[i]:
            yield i, np.unique(values[begin[i] : begin[i + 1]])


def signatures(docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key, node (digest of the shingle set; null without words), its shingles' number and trie keys of every row."""
    names = ["doc_id", "text_key", "node", "shingles", "keys"]

    def signed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for start, texts in batches(batch, "text", 1 << 18):
                node: list = [None] * len(texts)
                size: list = [None] * len(texts)
                keys: list = [None] * len(texts)
                found = list(_sets(texts, n))
                if found:
                    begin = np.zeros(len(found) + 1, dtype=np.int64)
                    np.cumsum([len(s) for _, s in found], out=begin[1:])
                    values = np.concatenate([s for _, s in found])
                    for (i, s), own in zip(found, trie_keys(values, begin), strict=True):
                        node[i], size[i], keys[i] = xxhash.xxh3_128_hexdigest(s.tobytes()), len(s), own.tobytes()
                part = batch.slice(start, len(texts))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("text_key"), pa.array(node, pa.string()), pa.array(size, pa.int64()), pa.array(keys, pa.binary())], names
                )

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return slim.mapInArrow(signed, "doc_id long, text_key long, node string, shingles long, keys binary")


_LINK_NAMES, _LINK_TYPES = ["node", "other", "links", "bins"], (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))


def _verify(members: DataFrame, similarity: float, length: int, before: int | None) -> DataFrame:
    """Per group and node with links in it: the group's first linked node, how many documents it links
    to, and its links to later nodes of the group by similarity."""

    def hashed(keys: np.ndarray, upto: int) -> np.ndarray:
        """A hash of each tree's prefix."""
        out = np.zeros(keys.shape[:2], dtype=U)
        for k in range(upto):
            out = mix(out * U(0x9E3779B97F4A7C15) + keys[:, :, k].astype(U))
        return out

    def verified(tree: int, rows: dict[str, tuple]) -> list[tuple]:
        nodes = sorted(rows)
        side = np.array([rows[x][0] for x in nodes])
        copies = np.array([rows[x][1] for x in nodes])
        keys = np.stack([np.frombuffer(rows[x][2], dtype=">u2").reshape(TREES, LONGEST) for x in nodes])
        now, longer = hashed(keys, length), hashed(keys, before) if before else None
        sets = [np.frombuffer(rows[x][3], dtype=U) for x in nodes]
        size = np.array([len(s) for s in sets])
        begin = np.cumsum(size) - size
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        flag = np.zeros(int(ids.max()) + 1, dtype=np.int32)
        two = side.min() != side.max()
        root, links = np.arange(len(nodes)), np.zeros(len(nodes), dtype=np.int64)
        bins = np.zeros((len(nodes), _BINS), dtype=np.int64)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in range(len(nodes) - 1):
            later = np.arange(i + 1, len(nodes))
            wanted = np.minimum(size[later], size[i]) >= similarity * np.maximum(size[later], size[i])
            if two:
                wanted &= side[later] != side[i]
            later = later[wanted]
            if len(later):
                known = (now[later, :tree] == now[i, :tree]).any(axis=1)  # met in an earlier tree
                if longer is not None:
                    known |= (longer[later] == longer[i]).any(axis=1)  # met under a longer prefix
                later = later[~known]
            if not len(later):
                continue
            own = ids[begin[i] : begin[i] + size[i]]
            flag[own] = 1
            if len(later) * 2 < len(nodes):
                common = np.array([int(flag[ids[begin[j] : begin[j] + size[j]]].sum()) for j in later])
            else:
                common = np.add.reduceat(flag[ids], begin)[later]
            flag[own] = 0
            alike = common / (size[i] + size[later] - common)
            good = common >= similarity * (size[i] + size[later] - common) - 1e-9
            bins[i] = np.bincount(np.clip(((alike[good] - similarity) / (1 - similarity + 1e-9) * _BINS).astype(int), 0, _BINS - 1), minlength=_BINS)
            for j in later[good]:
                links[i] += copies[j]
                links[j] += copies[i]
                a, b = sorted((top(i), top(int(j))))
                root[b] = a
        return [(nodes[i], nodes[top(i)], int(links[i]), bins[i].tolist()) for i in np.flatnonzero(links)]

    def groups(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, {}, []
        for batch in batches_:
            for gid, node, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = tuple(gid.values())
                if key != now:
                    if len(rows) > 1:
                        out += verified(now[0], rows)
                    now, rows = key, {}
                rows[node] = tuple(row)
            if out:
                yield _links(out)
                out = []
        if len(rows) > 1 and (out := verified(now[0], rows)):
            yield _links(out)

    return members.mapInArrow(groups, "node string, other string, links long, bins array<long>")


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LINK_TYPES, strict=True)], _LINK_NAMES)


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """Edges (u, v) with ``m``, the smallest node next to u or u itself.

    A node with a large share of all edges is dealt out: at most ``_HOT_KEYS`` nodes have so many
    that their edges are joined by a further hash of v.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    many = F.col("n") > max(1_000, rows // _HOT_KEYS)
    hot = F.broadcast(least.where(many).select("u", F.lit(_SALTS).alias("salts")))
    salted = edges.join(hot, "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return salted.join(least.select("u", "m", F.explode(F.sequence(F.lit(0), F.when(many, _SALTS - 1).otherwise(0))).alias("salt")), ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected graph given as (node, other): the smallest node it reaches.

    Large-star and small-star steps in turn, each over edges only, until nothing changes; the number
    of rounds grows with the logarithm of the longest path. Every round is written, which cuts lineage.
    """
    def measured(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    held = save(edges.where("node != other").select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct(), "edges")
    now = measured(held)
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
        small = _with_least(large, now[0]).select(F.explode(F.when(F.col("v") != F.col("m"), F.array(pair("v", "m"), pair("u", "m"))).otherwise(F.array(pair("u", "m")))).alias("e")).select("e.*").distinct()
        held = save(small, "edges")
        before, now = now, measured(held)
        if now == before:
            return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _candidates(matched: DataFrame, length: int, before: int | None, blocks: tuple[int, int] = (_BLOCK, _BLOCK_BYTES)) -> DataFrame:
    """node, first, copies and ``at``: the groups (and the pairs of blocks in them) of each node under
    prefixes of this length that bring pairs which did not meet ``before``, at that length. Groups of the same nodes in several trees are one."""
    prefix = F.substring("key", 1, _WIDTH * length)
    longer = F.substring("key", 1, _WIDTH * (before or LONGEST))
    held = matched.withColumn("prefix", prefix)
    full = held.groupBy("tree", "prefix").agg(
        F.count("*").alias("size"), F.sum("shingles").alias("shingles"), F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit("two"), F.col("node"))).alias("two"), (F.min(longer) != F.max(longer)).alias("branches"),
    ).where("size > 1")
    if before:
        full = full.where("branches")
    parts = F.greatest(F.ceil(F.col("size") / blocks[0]), F.ceil(F.col("shingles") * 8 / blocks[1])).cast("int")
    once = full.groupBy("size", "shingles", "one", "two").agg(F.min(F.struct("tree", "prefix")).alias("at")).select("at.*", F.least(parts, "size").cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    return (
        held.join(once, ["tree", "prefix"])
        .withColumn("side", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "first", "copies", F.struct("tree", "prefix", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side").alias("at"))
        .groupBy("node", "first", "copies").agg(F.collect_list("at").alias("at"))
    )


def _compared(spark: SparkSession, texts: DataFrame, wanted: DataFrame, similarity: float, length: int, before: int | None, n: int) -> DataFrame:
    """Links among the nodes of each group, from the texts (first, text) of the nodes."""
    size = wanted.agg(F.sum(F.size("at") * 48 + 120)).first()[0] or 0
    gid_type = pa.struct([("tree", pa.int32()), ("prefix", pa.binary()), ("low", pa.int32()), ("high", pa.int32())])
    types = (gid_type, pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def gathered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for start, part_texts in batches(batch, "text", 1 << 18):
                part = batch.slice(start, len(part_texts))
                node, copies, at = (part.column(c).to_pylist() for c in ("node", "copies", "at"))
                found = [(i, s) for i, s in _sets(part_texts, n) if xxhash.xxh3_128_hexdigest(s.tobytes()) == node[i]]
                if not found:
                    continue
                begin = np.zeros(len(found) + 1, dtype=np.int64)
                np.cumsum([len(s) for _, s in found], out=begin[1:])
                keys = trie_keys(np.concatenate([s for _, s in found]), begin)
                out, held = [], 0
                for (i, s), own in zip(found, keys, strict=True):
                    own, s = own.tobytes(), s.tobytes()
                    for g in at[i]:
                        out.append(({k: g[k] for k in ("tree", "prefix", "low", "high")}, node[i], g["side"], copies[i], own, s))
                        held += len(s) + 500
                        if held > 8 << 20:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _MEMBERS)
                            out, held = [], 0
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _MEMBERS)

    sets = texts.join(F.broadcast(wanted) if size <= _BROADCAST_BYTES else wanted, "first").select("node", "copies", "at", "text").mapInArrow(
        gathered, "gid struct<tree:int,prefix:binary,low:int,high:int>, node string, side int, copies long, keys binary, set binary"
    )
    dealt = sets.repartition(2 * shuffle_partitions(spark), "gid").sortWithinPartitions("gid")
    return _verify(dealt, similarity, length, before)


_MEMBERS = ["gid", "node", "side", "copies", "keys", "set"]


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, recall: float = 0.9999, n: int = 5
) -> DataFrame:
    """One row per input row: doc_id, text_key, class_id (smallest id it is linked to, over any steps), n_links.

    ``n_links``: further rows with a Jaccard similarity of ``similarity`` or more, copies included.
    Texts of fewer than ``n`` words have one shingle. Null and wordless texts, and rows with null
    ids, are compared with nothing: their class is their id. Repeated rows are copies of each
    other. Empty tables give no rows; further columns are ignored.
    """
    spark = ship(docs.sparkSession)
    signed = save(signatures(docs, n, doc_id, text), "signatures")
    known = signed.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = save(known.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.any_value("shingles").alias("shingles"), F.any_value("keys").alias("keys")), "nodes")
    texts = docs.select(F.col(doc_id).cast("long").alias("first"), F.col(text).alias("text"))

    last = shortest_prefix(similarity, recall)
    width = _WIDTH * LONGEST
    each = nodes.select("node", "first", "copies", "shingles", "keys", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    placed = each.select("node", "first", "copies", "shingles", "tree", F.substring("keys", F.col("tree") * width + 1, F.lit(width)).alias("key"))
    placed = placed.withColumn("start", F.substring("key", 1, _WIDTH * last))
    matched = save(placed.join(placed.groupBy("tree", "start").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["tree", "start"]).drop("start"), "matched")

    found, bins, before, length = [], [0] * _BINS, None, LONGEST
    while True:
        wanted = save(_candidates(matched, length, before), "candidates")
        found.append(save(_compared(spark, texts, wanted, similarity, length, before, n), "links"))
        new = found[-1].agg(*[F.coalesce(F.sum(F.get("bins", F.lit(k))), F.lit(0)) for k in range(_BINS)]).first()
        bins = [a + b for a, b in zip(bins, new, strict=True)]
        if length == last or estimated_recall(bins, length, similarity) >= recall:
            break
        before, length = length, next((k for k in range(length - 1, last, -1) if estimated_recall(bins, length, similarity, k) >= recall), last)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    roots = components(links)
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = roots.join(nodes.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("class"))
    of_node = (
        nodes.select("node", "first", "copies")
        .join(degree, "node", "left")
        .join(roots.join(classes, "root").select("node", "class"), "node", "left")
        .select("node", F.coalesce("class", "first").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    )
    linked = save(of_node.where(F.col("links") > 0), "linked")  # read again, Spark can split the join of a node with many copies
    return signed.select("doc_id", "text_key", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(linked, "node", "left").select(
        "doc_id", "text_key",
        F.coalesce("class", "doc_id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id; of repeated rows one stays."""
    names = docs.columns
    found = near_duplicates(docs, doc_id=doc_id, text=text, similarity=similarity).where("n_links > 0")
    verdict = found.groupBy(F.col("doc_id").alias("_rv_id"), F.col("text_key").alias("_rv_key")).agg(
        F.max(F.col("class_id") != F.col("doc_id")).alias("_rv_drop"), F.count("*").alias("_rv_rows")
    )
    verdict = save(verdict.where("_rv_drop OR _rv_rows > 1"), "verdicts")
    same = (F.col(doc_id) == F.col("_rv_id")) & (F.xxhash64(text) == F.col("_rv_key"))
    rest = docs.join(verdict, same, "left_anti")
    again = docs.join(verdict.where("NOT _rv_drop"), same).select(*names).dropDuplicates([doc_id, text])
    return rest.select(*names).unionByName(again)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")
