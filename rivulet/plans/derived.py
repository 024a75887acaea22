"""Indexes, materialised views and streams, each built from the given tables and then queried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.indexes import covering, skipping, views
from rivulet.plans._registry import Tables, query
from rivulet.scratch import new_place
from rivulet.streaming import refresh_view, tumble


_FILE_ROWS = 500_000  # meant for a file of a table that is laid out by ranges


def _place(t: Tables, name: str) -> str:
    return new_place(t.spark, name)


def _by_ranges(df: DataFrame, column: str) -> DataFrame:
    """As many ranges as the rows need, so that files and tasks stay of one size; counting reads footers only."""
    return df.repartitionByRange(max(8, -(-df.count() // _FILE_ROWS)), column)


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 200 AND l_returnflag = 'A'")
def skipping_read(t: Tables) -> DataFrame:
    place = _place(t, "skipping")
    _by_ranges(t.lineitem, "l_orderkey").write.parquet(f"{place}/table")
    columns = {"l_orderkey": "MIN_MAX", "l_returnflag": "VALUE_SET", "l_partkey": "BLOOM_FILTER"}
    skipping.build(t.spark.read.parquet(f"{place}/table"), columns).write.parquet(f"{place}/index")
    index = t.spark.read.parquet(f"{place}/index")
    found = skipping.read(t.spark, f"{place}/table", index, columns, [("l_orderkey", ">=", 100), ("l_orderkey", "<", 200), ("l_returnflag", "=", "A")])
    return found.select("l_orderkey", "l_linenumber", "l_shipdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (17, 42)")
def skipping_bloom(t: Tables) -> DataFrame:
    place = _place(t, "bloom")
    _by_ranges(t.lineitem, "l_partkey").write.parquet(f"{place}/table")
    columns = {"l_partkey": "BLOOM_FILTER"}
    skipping.build(t.spark.read.parquet(f"{place}/table"), columns).write.parquet(f"{place}/index")
    index = t.spark.read.parquet(f"{place}/index")
    return skipping.read(t.spark, f"{place}/table", index, columns, [("l_partkey", "in", [17, 42])]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def covering_read(t: Tables) -> DataFrame:
    index = covering.CoveringIndex(t.path("orders"), _place(t, "covering"), ("o_totalprice", "o_orderkey"), (("o_totalprice", ">", 200000.0),))
    index.refresh(t.spark)
    return covering.read(t.spark, t.path("orders"), ["o_orderkey", "o_totalprice"], [("o_totalprice", ">", 250000.0)], [index])


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def view_full(t: Tables) -> DataFrame:
    def hourly(df: DataFrame) -> DataFrame:
        rows = df.groupBy("event_type", tumble("ts", "1 hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        return rows.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "total")

    return views.refresh_full(t.spark, t.path("events"), hourly, _place(t, "view"))


@query("""
SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) GROUP BY ALL
""")
def view_incremental(t: Tables) -> DataFrame:
    place = _place(t, "stream")

    def daily(df: DataFrame) -> DataFrame:
        rows = df.groupBy("event_type", tumble("ts", "1 day")).agg(F.count("*").alias("n"))
        return rows.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")

    t.events.write.parquet(f"{place}/events")  # a folder that files arrive in
    refresh_view(t.spark, f"{place}/events", daily, f"{place}/view", f"{place}/checkpoint", time="ts").awaitTermination()
    return t.spark.read.parquet(f"{place}/view")
