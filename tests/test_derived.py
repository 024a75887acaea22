"""Indexes, views, streams, the registry and document sources."""

import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from oracle import assert_same
from pyspark.sql import functions as F

from rivulet.indexes import covering, skipping
from rivulet.indexes.registry import Registry
from rivulet.plans import QUERIES, SQL, derived
from rivulet.sources import geo_point, read_documents, spark_schema, store_mapping, write_documents
from rivulet.streaming import refresh_index, refresh_view, tumble


@pytest.fixture
def place(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"


def test_skipping_reads_few_files_and_all_new_ones(spark, place):
    table, columns = f"{place}/t", {"id": "MIN_MAX", "name": ("VALUE_SET", 5), "code": "BLOOM_FILTER"}
    rows = spark.range(1000).selectExpr("id", "concat('n', id div 300) as name", "concat('c', id) as code")
    rows.repartitionByRange(10, "id").write.parquet(table)
    skipping.build(spark.read.parquet(table), columns).write.parquet(f"{place}/i")
    index = spark.read.parquet(f"{place}/i")
    kinds = dict(spark.read.parquet(table).dtypes)
    count = lambda c: skipping.matching_files(index, columns, c, kinds).count()
    assert index.count() == 10 and count([("id", "=", 5)]) == 1 and count([("id", "<", 0)]) == 0
    assert count([("code", "=", "c77")]) <= 2 and count([("code", "in", ["c77", "c901"])]) <= 4
    assert skipping.read(spark, table, index, columns, [("code", "=", "c77")]).collect()[0]["id"] == 77
    assert count([("name", "=", "n3")]) < 10
    rows.selectExpr("id + 1000 as id", "name", "code").limit(5).write.mode("append").parquet(table)
    assert skipping.read(spark, table, index, columns, [("id", ">=", 998)]).count() == 7
    assert skipping.read(spark, table, index, columns, [("id", "<", -1)]).count() == 0


def test_recommendation(spark):
    df = spark.createDataFrame([(1, "a", True)], "n int, s string, b boolean")
    assert skipping.recommend(df, ["s"]) == {"n": "MIN_MAX", "s": "PARTITION", "b": "VALUE_SET"}
    with pytest.raises(ValueError):
        skipping.Sketch("x", "HASH")


def test_covering_index_is_used_only_where_it_suffices(spark, place, sf_dir):
    source = f"{sf_dir}/orders.parquet"
    index = covering.CoveringIndex(source, f"{place}/c", ("o_totalprice", "o_orderkey"), (("o_totalprice", ">", 1000.0),))
    index.refresh(spark)
    assert index.covers(["o_orderkey"], [("o_totalprice", ">=", 1500.0)])
    assert not index.covers(["o_orderkey"], [("o_totalprice", ">", 10.0)]) and not index.covers(["o_custkey"], [("o_totalprice", ">", 2000.0)])
    plan = covering.read(spark, source, ["o_orderkey"], [("o_totalprice", ">", 2000.0)], [index])._jdf.queryExecution().toString()
    assert f"{place}/c".removeprefix("file://") in plan


OPS = ["=", "<", "<=", ">", ">="]


@given(st.sampled_from(OPS), st.integers(-3, 3), st.sampled_from(OPS), st.integers(-3, 3))
def test_implication_is_sound(op, v, limit_op, limit):
    meets = lambda x, o, y: {"=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[o]
    if covering.implies(("c", op, v), ("c", limit_op, limit)):
        assert all(meets(x / 2, limit_op, limit) for x in range(-20, 21) if meets(x / 2, op, v))


def test_streams_refresh_incrementally(spark, place):
    source = f"{place}/s"
    events = lambda days: spark.createDataFrame([(f"2024-01-0{d} 01:00:00", d) for d in days], "ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    daily = lambda df: df.groupBy(tumble("ts", "1 day")).agg(F.sum("v").alias("v")).select("window.start", "v")
    run = lambda: refresh_view(spark, source, daily, f"{place}/v", f"{place}/k", time="ts").awaitTermination()
    events([1, 1, 2]).write.parquet(source)
    run()
    assert [r["v"] for r in spark.read.parquet(f"{place}/v").collect()] == [2]
    events([3]).write.mode("append").parquet(source)
    run()
    assert sorted(r["v"] for r in spark.read.parquet(f"{place}/v").collect()) == [2, 2]
    with pytest.raises(ValueError):
        refresh_view(spark, source, daily, f"{place}/v", "")
    refresh_index(spark, source, lambda df: skipping.build(df, {"v": "MIN_MAX"}) if "_metadata" in df.columns else df, f"{place}/i", f"{place}/ki").awaitTermination()
    assert spark.read.parquet(f"{place}/i").count() >= 2


def test_registry_keeps_to_its_states(spark, place):
    log = Registry(spark, f"{place}/log")
    assert log.apply("create", "i", "skipping", "t", "{}") == "active"
    assert log.apply("start", "i") == "refreshing" and log.apply("recover", "i") == "refreshing"
    with pytest.raises(ValueError):
        log.apply("vacuum", "i")
    assert log.apply("drop", "i") == "deleted" and [r["state"] for r in log.indexes().collect()] == ["deleted"]
    assert log.apply("vacuum", "i") == "empty" and log.indexes().count() == 0
    assert log.apply("create", "i", "skipping", "t", "{}") == "active"


def test_documents_round_trip(spark, place):
    mapping = {"id": {"type": "integer"}, "at": {"type": "date"}, "o": {"properties": {"t": {"type": "text"}}}, "a": {"type": "alias", "path": "o.t"}}
    schema = spark_schema(mapping)
    assert [f.dataType.simpleString() for f in schema] == ["int", "timestamp", "struct<t:string>", "string"]
    assert store_mapping(schema)["at"]["format"].startswith("strict_date_optional_time")
    df = spark.createDataFrame([(1, None, ("x",), None)], schema)
    write_documents(df, f"{place}/docs")
    assert read_documents(spark, f"{place}/docs", mapping).first()["o"]["t"] == "x"
    with pytest.raises(ValueError):
        spark_schema({"x": {"type": "nested_thing"}})


def test_geo_points(spark):
    df = spark.createDataFrame([("40.5,-70",), ("POINT (-70 40.5)",), ("somewhere",), (None,)], "p string")
    assert [tuple(r[0]) if r[0] else None for r in df.select(geo_point("p")).collect()] == [(40.5, -70.0), (40.5, -70.0), None, None]


def test_bitmaps_are_built_without_sorting_the_rows(spark, place):
    spark.range(20_000).selectExpr("id", "string(id % 7) as s").repartitionByRange(3, "id").write.parquet(f"{place}/table")
    table = spark.read.parquet(f"{place}/table")
    index = skipping.build(table, {"id": "BLOOM_FILTER"})
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    bits = table.groupBy("_metadata.file_path").agg(*skipping.Sketch("id", "BLOOM_FILTER").aggregates())
    assert index.columns == bits.columns
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, bits.collect()))


@pytest.mark.parametrize("name", ["skipping_read", "skipping_bloom"])
def test_files_of_skipping_queries_do_not_grow_with_the_table(spark, sf_dir, place, monkeypatch, name):
    monkeypatch.setattr(derived, "_FILE_ROWS", 200, raising=False)
    monkeypatch.setattr(derived, "_place", lambda t, name: place)
    assert_same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)
    files = spark.read.parquet(f"{place}/table").groupBy("_metadata.file_path").count()
    assert files.agg({"count": "max"}).first()[0] <= 400
    assert files.agg({"count": "sum"}).first()[0] == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
