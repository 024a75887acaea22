"""Cutting a table into ranges of a key whose rows can look at their neighbours.

The cuts come from a bounded sample of keys; every range is at most a few times its even share,
however hot a prefix of the key is, because the key itself is (nearly) unique.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SAMPLE = 64  # keys for each range
_HASHES = 1 << 30


def cut_points(df: DataFrame, key: Column, n: int) -> list:
    """At most ``n - 1`` keys that part ``df`` into about even ranges."""
    keys = df.select(key.alias("k"))
    total = keys.count()
    if not total or n < 2:
        return []
    least = int(_HASHES * min(1.0, _SAMPLE * n / total))
    found = sorted(r["k"] for r in keys.where(F.pmod(F.xxhash64("k"), F.lit(_HASHES)) < least).collect())
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def range_of(key: Column, cuts: list, kind: str) -> Column:
    """The number of cuts that are not above ``key``, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    held = F.from_json(F.lit(json.dumps(cuts)), f"array<{kind}>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= key, at + s).otherwise(at)
    )


def with_neighbours(df: DataFrame, key: str, kind: str, n: int, *, before: bool, after: bool, ring: bool = False) -> DataFrame:
    """``df`` with ``chunk`` and ``lent``, dealt out and sorted by chunk, ``lent``-last on ties, and key.

    ``before``: each range also gets the last row(s) of the range before it, ``after``: the first of
    the range after it; with ``ring`` the first range follows the last. Such rows are ``lent``.
    """
    cuts = cut_points(df, F.col(key), n)
    chunk = range_of(F.col(key), cuts, kind)
    ends = sorted(
        (r["chunk"], r["low"], r["high"])
        for r in df.select(chunk.alias("chunk"), F.col(key).alias("k")).groupBy("chunk").agg(F.min("k").alias("low"), F.max("k").alias("high")).collect()
    )  # as many rows as there are ranges
    to: dict = {}
    for i, (_, low, high) in enumerate(ends):
        if after and (i or ring):
            to.setdefault(low, []).append(ends[i - 1][0])
        if before and (i + 1 < len(ends) or ring):
            to.setdefault(high, []).append(ends[(i + 1) % len(ends)][0])
    own = F.array(F.struct(chunk.alias("chunk"), F.lit(False).alias("lent")))
    if to:
        rows = [{"k": k, "c": c} for k, c in to.items()]
        lend = F.from_json(F.lit(json.dumps(rows)), f"array<struct<k:{kind},c:array<int>>>")
        lend = F.map_from_entries(F.transform(lend, lambda x: F.struct(x["k"], x["c"])))
        more = F.transform(F.coalesce(F.element_at(lend, F.col(key)), F.array().cast("array<int>")), lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("lent")))
        own = F.concat(own, more)
    dealt = df.withColumn("_to", F.explode(own)).select("*", "_to.chunk", "_to.lent").drop("_to")
    return dealt.repartition(n, "chunk")
