"""Joins, look-ups in dimension tables, correlation of sources, and enrichment by address ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.ip import ip_to_int, is_ipv4
from rivulet.operators._cols import Expr, Step, expr, field, fresh, quoted
from rivulet.scratch import save

#: Kinds of join by their names.
KINDS = {
    "inner": "inner", "left": "left", "left outer": "left", "right": "right", "right outer": "right",
    "full": "full", "full outer": "full", "outer": "full", "semi": "left_semi", "left semi": "left_semi",
    "anti": "left_anti", "left anti": "left_anti", "cross": "cross",
}


def join(
    other: DataFrame, on: Expr | list[str] | None = None, kind: str = "inner", *, left: str | None = None, right: str | None = None,
    left_hint: str | None = None, right_hint: str | None = None,
) -> Step:
    """Join of any kind on any condition; ``left`` and ``right`` name the sides for the condition.

    Without a condition it is a cross join. Hints (broadcast, merge, shuffle_hash, rebalance...) go
    to Spark; without them Spark picks the strategy by the sides' sizes.
    """
    how = KINDS.get(kind.lower().replace("_", " "))
    if how is None:
        raise ValueError(f"unknown kind of join {kind!r}")

    def step(df: DataFrame) -> DataFrame:
        a = df.alias(left) if left else df
        b = other.alias(right) if right else other
        a, b = (a.hint(left_hint) if left_hint else a), (b.hint(right_hint) if right_hint else b)
        if on is None:
            if how not in ("inner", "cross"):
                raise ValueError(f"a {kind} join needs a condition")
            return a.crossJoin(b)
        return a.join(b, on if isinstance(on, list) else expr(on), "inner" if how == "cross" else how)

    return step


def lookup(
    table: DataFrame, keys: Mapping[str, str] | Sequence[str], *, replace: Mapping[str, str] | Sequence[str] = (),
    append: Mapping[str, str] | Sequence[str] = (),
) -> Step:
    """Enrich rows from a dimension table by a left join on ``keys`` ({lookup column: source column}).

    ``replace`` ({lookup column: output}) overwrites, ``append`` fills only nulls; output columns
    move to the end. Without either, every other column of the table replaces the one so named.
    """
    on = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    if replace and append:
        raise ValueError("either replace or append")

    def as_map(x: Mapping[str, str] | Sequence[str]) -> dict[str, str]:
        return dict(x) if isinstance(x, Mapping) else {c: c for c in x}

    def step(df: DataFrame) -> DataFrame:
        outputs = as_map(replace or append) or {c: c for c in table.columns if c not in on}
        side = table.select(
            *[F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(on)],
            *[F.col(quoted(c)).alias(f"__v{i}") for i, c in enumerate(outputs)],
        )
        same = reduce(lambda a, b: a & b, [field(s) == F.col(f"__k{i}") for i, s in enumerate(on.values())])
        joined = df.join(side, same, "left")
        existing = {c.lower(): c for c in df.columns}
        new = {}
        for i, name in enumerate(outputs.values()):
            value = F.col(f"__v{i}")
            if append and name.lower() in existing:
                value = F.coalesce(F.col(quoted(existing[name.lower()])), value)
            new[name] = value
        kept = [F.col(quoted(c)) for c in df.columns if c.lower() not in {n.lower() for n in new}]
        return joined.select(*kept, *[v.alias(n) for n, v in new.items()])

    return step


_HEAVY = 1 << 16  # pairs of a key from which it is shared out
_RUN = 252  # partners in a row of a row: half of a group of Parquet's bit packing, so that repeats look alike
_HELD = 32 * _RUN  # most rows of a block that a task holds
_HELD_BYTES = 1 << 19  # and most bytes, about
_STREAMED = 1 << 16  # most rows of a block that streams past it; so many different values fit a file's dictionary
_CELL = 1 << 23  # pairs that a cell is meant to make
_CELLS_A_CORE = 16  # cells for a core at least, so that chance shares them out
_TASKS = 4096  # beyond that cells grow
#: Types whose equal values are alike in every bit.
_ALIKE = {"boolean", "tinyint", "smallint", "int", "bigint", "date", "timestamp", "timestamp_ntz", "string", "binary"}


def _bytes(column: str, kind: str) -> Column:
    """About how many bytes a value takes."""
    if kind.startswith(("array<", "map<", "struct<")):
        return 16 + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return 16 + F.coalesce(F.octet_length(column), F.lit(0)) if kind.startswith(("string", "char", "varchar", "binary")) else F.lit(16)


def _pair_up(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Inner equi-join of sides without common column names, shared out by the pairs it makes.

    Spark shares out a join by bytes read, so a few megabytes that agree in a few keys meet in one
    task, however many pairs they make. Here pairs are counted by key. Rows of a key with many are
    dealt into blocks, and each block of one side meets each of the other in a cell of its own. A
    block of ``b`` is held as one array of short runs; rows of ``a`` stream past one run after the
    other, so that what follows sees few values at a time and files of pairs compress well.
    Keys of ``b`` are not sent where those of ``a`` say the same. Rows alike in all columns share a
    block of ``a``. Keys of different types are left to Spark.
    """
    equal = reduce(lambda x, y: x & y, [F.col(x) == F.col(y) for x, y in pairs])
    kinds_a, kinds_b = dict(a.dtypes), dict(b.dtypes)
    if any(kinds_a[x] != kinds_b[y] for x, y in pairs):
        return a.join(b, equal)
    xs, ys = list(dict.fromkeys(x for x, _ in pairs)), list(dict.fromkeys(y for _, y in pairs))
    known = {y: x for x, y in pairs if kinds_b[y] in _ALIKE}
    sent = [c for c in b.columns if c not in known] or b.columns[:1]
    width = reduce(lambda x, y: x + y, [_bytes(c, kinds_b[c]) for c in sent])
    sizes = a.groupBy(*xs).agg(F.count("*").alias("__na")).join(b.groupBy(*ys).agg(F.count("*").alias("__nb"), F.sum(width).alias("__bytes")), equal)
    made = F.col("__na").cast("double") * F.col("__nb")
    held = F.least(F.col("__nb"), F.ceil(F.greatest(F.col("__nb") / _HELD, F.col("__bytes") / _HELD_BYTES))).cast("int").alias("__held")
    heavy = save(sizes.where(made > _HEAVY).select(*xs, *ys, "__na", "__nb", held, F.monotonically_increasing_id().alias("__key")), "heavy-keys")
    total, most = heavy.agg(F.sum(made), F.max("__held")).first()
    if not total:
        return a.join(b, equal)
    cores = a.sparkSession.sparkContext.defaultParallelism
    cell = max(min(_CELL, total / cores / _CELLS_A_CORE), total / _TASKS)
    tasks = min(max(-int(-total // cell), cores), _TASKS)
    block = F.ceil(F.col("__nb") / F.col("__held"))
    streamed = F.ceil(F.col("__na") / F.least(F.greatest(F.floor(cell / block), F.lit(1)), F.lit(_STREAMED)))
    counts = ["__held", streamed.cast("int").alias("__streamed"), F.ceil(block / _RUN).cast("int").alias("__runs")]

    def dealt(df: DataFrame, keys: list[str], count: str) -> DataFrame:
        """Rows of heavy keys with the key's number and counts, and their block."""
        counted = heavy.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "__key", *counts)
        same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(keys)])
        hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
        return df.join(counted, same).withColumn("__block", F.pmod(F.xxhash64(*hashed), count).cast("int"))

    def numbers(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    right = dealt(b, ys, "__held").select(*sent, "__key", "__block", "__held", "__streamed", "__runs")
    if most > 1:  # rows alike that are too many for a block go on to the next ones
        order = [c for c in sent if not any(x in kinds_b[c] for x in ("map<", "variant", "interval"))] or [F.lit(0)]
        place = F.row_number().over(Window.partitionBy("__key", "__block").orderBy(*order))
        right = right.withColumn("__block", F.pmod(F.col("__block") + F.floor((place - 1) / (2 * _RUN * F.col("__runs"))), "__held").cast("int"))
    right = right.groupBy("__key", "__block", "__streamed", "__runs").agg(F.collect_list(F.struct(*sent)).alias("__rows"))
    last = F.col("__runs") - 1
    runs = F.transform(numbers("__runs"), lambda i: F.slice("__rows", i * _RUN + 1, F.when(i < last, F.lit(_RUN)).otherwise(F.greatest(F.size("__rows") - last * _RUN, F.lit(0)))))
    right = right.select(F.col("__key").alias("__key_b"), F.explode(numbers("__streamed")).alias("__row_b"), F.col("__block").alias("__column_b"), runs.alias("__each"))
    right = right.repartition(tasks, "__key_b", "__row_b", "__column_b")
    left = dealt(a, xs, "__streamed").select(*a.columns, F.col("__key").alias("__key_a"), F.col("__block").alias("__row_a"), F.explode(numbers("__held")).alias("__column_a"), "__runs")
    left = left.repartition(tasks, "__key_a", "__row_a", "__column_a").select("*", F.explode(numbers("__runs")).alias("__run"))
    left = left.sortWithinPartitions("__key_a", "__row_a", "__column_a", "__run").where(F.spark_partition_id() >= 0)  # always true; without it the order below a join is dropped
    met = left.join(right.hint("merge"), reduce(lambda x, y: x & y, [F.col(f"{c}_a") == F.col(f"{c}_b") for c in ("__key", "__row", "__column")]))
    met = met.select(*a.columns, F.inline(F.get("__each", F.col("__run"))).alias(*sent))
    met = met.select(*a.columns, *[F.col(c if c in sent else known[c]).alias(c) for c in b.columns])
    few = heavy.select(*[F.col(x).alias(f"__k{i}") for i, x in enumerate(xs)])
    light = a.join(few, reduce(lambda x, y: x & y, [F.col(x) == F.col(f"__k{i}") for i, x in enumerate(xs)]), "left_anti").join(b, equal)
    return met.union(light.select(*met.columns))


def correlate(left: DataFrame, right: DataFrame, mapping: Sequence[tuple[str, str]], kind: str = "exact") -> DataFrame:
    """Correlate two sources by pairs of columns.

    exact: all pairs are equal (inner join). approximate: any pair is equal, and rows without a
    partner stay. That is one equi-join for each pair, so that no condition with OR makes Spark
    compare all rows with all rows; a pair of rows counts for the first mapping that holds.
    Pairs are counted first, so that many are made in many tasks.
    """
    if not mapping:
        raise ValueError("no mapping")
    a = left.select(*[F.col(quoted(c)).alias(f"__a{i}") for i, c in enumerate(left.columns)])
    b = right.select(*[F.col(quoted(c)).alias(f"__b{i}") for i, c in enumerate(right.columns)])
    pairs = [(f"__a{left.columns.index(x)}", f"__b{right.columns.index(y)}") for x, y in mapping]
    equal = [F.col(x) == F.col(y) for x, y in pairs]
    if kind == "exact":
        out = _pair_up(a, b, pairs)
    elif kind == "approximate":
        parts = []
        for i, pair in enumerate(pairs):
            part = _pair_up(a, b, [pair])
            for earlier in equal[:i]:
                part = part.where(~F.coalesce(earlier, F.lit(False)))
            parts.append(part)
        alone_a, alone_b = a, b
        for x, y in pairs:
            alone_a = alone_a.join(b.select(F.col(y).alias("__y")), F.col(x) == F.col("__y"), "left_anti")
            alone_b = alone_b.join(a.select(F.col(x).alias("__x")), F.col(y) == F.col("__x"), "left_anti")
        parts += [alone_a, alone_b]
        out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return out.select(
        *[F.col(f"__a{i}").alias(c) for i, c in enumerate(left.columns)],
        *[F.col(f"__b{i}").alias(c) for i, c in enumerate(right.columns)],
    )


def self_correlate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of one source that agree in the columns, with each other."""
    return correlate(df, df, [(c, c) for c in columns])


#: Properties of an address range.
GEO_PROPERTIES = (
    "COUNTRY_ISO_CODE", "COUNTRY_NAME", "CONTINENT_NAME", "REGION_ISO_CODE", "REGION_NAME", "CITY_NAME", "TIME_ZONE", "LOCATION",
)
_CELLS = ((True, 1 << 16), (False, 1 << 112))  # addresses in a cell: a /16 of each version


def geoip(name: str, ip: Expr, ranges: DataFrame, properties: Sequence[str] = ()) -> Step:
    """Add where an address lies, from a table of disjoint ranges (start inclusive, end exclusive).

    One property gives a plain column, several or none a struct; addresses in no range give nulls.
    Ranges are cut into cells, so that addresses meet ranges by an equality and only then by
    comparison; Spark broadcasts the ranges if they are small enough for it, and else shuffles.
    """
    wanted = [p.upper() for p in properties] or list(GEO_PROPERTIES)
    if len(set(wanted)) != len(wanted) or set(wanted) - set(GEO_PROPERTIES):
        raise ValueError("properties must be known and named once")

    def cell(address: Column, v4: Column) -> Column:
        width = F.when(v4, F.lit(Decimal(_CELLS[0][1]))).otherwise(F.lit(Decimal(_CELLS[1][1])))
        return F.floor(address.cast("decimal(38,0)") / width).cast("bigint")

    def step(df: DataFrame) -> DataFrame:
        value = F.col(wanted[0].lower()) if len(properties) == 1 else F.struct(*[F.col(p.lower()).alias(p.lower()) for p in wanted])
        low, high, v4, geo, at, address, is4, mine = (fresh(df, n) for n in ("__s", "__e", "__v4", "__geo", "__cell", "__ip", "__is4", "__mine"))
        side = ranges.select(F.col("ip_range_start").alias(low), F.col("ip_range_end").alias(high), F.col("ipv4").alias(v4), value.alias(geo))
        side = side.withColumn(at, F.explode(F.sequence(cell(F.col(low), F.col(v4)), cell(F.col(high) - 1, F.col(v4)))))
        left = df.withColumn(address, ip_to_int(field(ip))).withColumn(is4, is_ipv4(field(ip)))
        left = left.withColumn(mine, cell(F.col(address), F.col(is4)))
        inside = (F.col(address) >= F.col(low)) & (F.col(address) < F.col(high))
        joined = left.join(side, (F.col(is4) == F.col(v4)) & (F.col(mine) == F.col(at)) & inside, "left")
        kept = [F.col(quoted(c)) for c in df.columns if c.lower() != name.lower()]
        return joined.select(*kept, F.col(geo).alias(name))

    return step
