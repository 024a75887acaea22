"""Operators on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from rivulet import operators as O
from rivulet.operators import pipe


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            (1000, "Jake", "Engineer", "England", 100000), (1001, "Hello", "Artist", "USA", 70000), (1002, "John", "Doctor", "Canada", 120000),
            (1003, "David", "Doctor", None, 120000), (1004, "David", None, "Canada", 0), (1005, "Jane", "Scientist", "Canada", 90000),
        ],
        "id int, name string, occupation string, country string, salary int",
    )


@pytest.fixture(scope="module")
def work(spark):
    return spark.createDataFrame(
        [(1000, "Jake", "IT", "Engineer"), (1002, "John", "DATA", "Scientist"), (1003, "David", "HR", "Doctor"), (1005, "Jane", "DATA", "Engineer"), (1006, "Tom", "SALES", "Artist")],
        "uid int, name string, department string, occupation string",
    )


@pytest.fixture(scope="module")
def states(spark):
    return spark.createDataFrame(
        [("Jake", 70, "California", "USA"), ("Hello", 30, "New York", "USA"), ("John", 25, "Ontario", "Canada"), ("Jane", 20, "Quebec", "Canada")],
        "name string, age int, state string, country string",
    )


@pytest.fixture(scope="module")
def doubles(spark):
    text = "AX AY AY BZ BZ BZ CX -Y DZ E- AX AY -X B- BY -Z CX --".split()
    rows = [(i + 1, None if a == "-" else a, None if b == "-" else b) for i, (a, b) in enumerate(text)]
    return spark.createDataFrame(rows, "id int, name string, category string")


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_lookup_replaces_and_moves_to_the_end(people, work):
    df = pipe(people, O.lookup(work, {"uid": "id"}, replace=["department"]))
    assert df.columns[-1] == "department"
    assert [r[-1] for r in sorted(tuples(df))] == ["IT", None, "DATA", "HR", None, "DATA"]
    df = pipe(people, O.lookup(work, {"uid": "id"}, replace={"department": "country"}))
    assert df.columns == ["id", "name", "occupation", "salary", "country"]
    df = pipe(people, O.lookup(work, {"uid": "id"}, append={"department": "country"}))
    assert [r[-1] for r in sorted(tuples(df))] == ["England", "USA", "Canada", "HR", "Canada", "Canada"]


def test_lookup_of_all_columns(people, work):
    df = pipe(people, O.lookup(work, {"uid": "id"}))
    assert df.columns == ["id", "country", "salary", "name", "department", "occupation"]


def test_dedup(doubles):
    assert sorted(r["name"] for r in pipe(doubles, O.dedup("name")).collect()) == list("ABCDE")
    pairs = {(r["name"], r["category"]) for r in pipe(doubles, O.dedup(["name", "category"])).collect()}
    assert pairs == {("A", "X"), ("A", "Y"), ("B", "Z"), ("C", "X"), ("D", "Z"), ("B", "Y")}
    kept = pipe(doubles, O.dedup("name", keepempty=True))
    assert sorted(r["id"] for r in kept.where("name is null").collect()) == [8, 13, 16, 18]
    assert pipe(doubles, O.dedup("name", 2, order=["id"])).count() == 8
    with pytest.raises(ValueError):
        O.dedup("name", 0)
    with pytest.raises(ValueError):
        O.dedup("name", consecutive=True)


def test_trendlines(states):
    df = pipe(states, O.trendline(O.sma(2, "age"), sort=["-age"]), O.sort("-age"))
    assert [r["age_trendline"] for r in df.collect()] == [None, 50.0, 27.5, 22.5]
    df = pipe(states, O.trendline(O.wma(2, "age", "w"), sort=["age"]), O.sort("age"))
    assert [None if r["w"] is None else round(r["w"], 4) for r in df.collect()] == [None, round((20 + 50) / 3, 4), round((25 + 60) / 3, 4), round((30 + 140) / 3, 4)]
    with pytest.raises(ValueError):
        O.sma(0, "age")
    with pytest.raises(ValueError):
        O.trendline(O.wma(2, "age"))


def test_eventstats(states):
    assert {r["avg(age)"] for r in pipe(states, O.eventstats(O.avg("age"))).collect()} == {36.25}
    by = {(r["country"], r["a"]) for r in pipe(states, O.eventstats(O.avg("age").alias("a"), by="country")).collect()}
    assert by == {("Canada", 22.5), ("USA", 50.0)}


def test_eventstats_keeps_rows_with_null_keys(people):
    df = pipe(people, O.eventstats(O.count().alias("n"), by="country"))
    assert df.count() == 6 and df.where("country is null").first()["n"] == 1


def test_stats_order_and_names(states):
    df = pipe(states, O.stats(O.avg("age"), O.count(), by=["country", O.span("age", 10)]))
    assert df.columns == ["avg(age)", "count()", "country", "span(age,10)"]
    with pytest.raises(ValueError):
        O.stats(O.count(), by=[O.span("a", 1), O.span("b", 1)])
    with pytest.raises(ValueError):
        O.percentile("age", 101)


def test_top_and_rare(spark):
    rows = ["Engineer England", "Artist USA", "Doctor Canada", "Doctor Canada", "Doctor Canada", "Engineer USA", "Engineer USA", "Unemployed Canada", "Scientist Canada", "Scientist Canada"]
    df = spark.createDataFrame([tuple(r.split()) for r in rows], "occupation string, country string")
    assert tuples(pipe(df, O.top("country", 3))) == [(6, "Canada"), (3, "USA"), (1, "England")]
    assert tuples(pipe(df, O.top("country", 3, by="occupation"))) == [(3, "Canada", "Doctor"), (2, "Canada", "Scientist"), (2, "USA", "Engineer")]
    assert tuples(pipe(df, O.rare("country")))[0] == (1, "England")


def test_rename_and_fillnull_move_columns(people):
    assert pipe(people, O.rename(name="who")).columns == ["id", "occupation", "country", "salary", "who"]
    df = pipe(people, O.fillnull(F.lit("?"), ["country"]))
    assert df.columns[-1] == "country" and df.where("country = '?'").count() == 1
    with pytest.raises(ValueError):
        O.fillnull(0)


def test_fields_except_knows_its_columns(people):
    assert pipe(people, O.fields_except("id", "salary")).columns == ["name", "occupation", "country"]
    with pytest.raises(ValueError):
        pipe(people, O.fields_except("nothing"))


def test_flatten_and_expand(spark):
    rows = [(1, [("1_one", 1), (None, 11), ("1_three", None)]), (2, [("2_Monday", 2), None]), (3, [("3_third", 3), ("3_4th", 4)]), (4, None)]
    df = spark.createDataFrame(rows, "int_col int, multi_value array<struct<name:string,value:int>>")
    assert pipe(df, O.expand("multi_value", "e")).count() == 7
    assert pipe(df, O.expand("multi_value")).columns == ["int_col", "multi_value", "col"]
    flat = pipe(df, O.flatten("multi_value"))
    assert flat.columns == ["int_col", "name", "value"] and flat.count() == 8
    struct = df.selectExpr("int_col", "multi_value[0] as s")
    assert pipe(struct, O.flatten("s", ["a", "b"])).columns == ["int_col", "a", "b"]


def test_parse_grok_patterns(spark):
    mails = [("Alice", 30, "alice@example.com"), ("Charlie", 65, "charlie@domain.net"), ("Eve", 21, "eve@examples.com"), ("Frank", 76, "frank@sample.org"), ("Ivy", 9, "ivy@examples.com"), (None, 1, None)]
    df = spark.createDataFrame(mails, "name string, age int, email string")
    parsed = pipe(df, O.parse("email", ".+@(?<host>.+)"), O.where("age > 45"), O.sort("-age"), O.fields("age", "host"))
    assert tuples(parsed) == [(76, "sample.org"), (65, "domain.net")]
    assert pipe(df, O.grok("email", ".+@%{HOSTNAME:host}"), O.where("host is not null"), O.top("host", 1)).first() == (2, "examples.com")
    assert {r[0] for r in pipe(df, O.patterns("email"), O.fields("patterns_field")).collect()} == {"@.", None}
    with pytest.raises(ValueError):
        O.grok("email", "%{NOTHING:x}")(df)


def test_grok_of_an_access_log(spark):
    line = '177.95.8.74 - upton5450 [28/Sep/2022:10:15:57 -0700] "HEAD /e-business/mindshare HTTP/1.0" 404 19927'
    row = pipe(spark.createDataFrame([(line,)], "message string"), O.grok("message", "%{COMMONAPACHELOG}")).first()
    assert (row["clientip"], row["auth"], row["verb"], row["response"], row["bytes"]) == ("177.95.8.74", "upton5450", "HEAD", "404", "19927")


def test_appendcol(states):
    df = pipe(states, O.appendcol(lambda t: pipe(t, O.stats(O.count().alias("n"), by="country")), order=["name"], sub_order=["country"]), O.sort("name"))
    assert [(r[0], r["n"]) for r in df.collect()] == [("Hello", 2), ("Jake", 2), ("Jane", None), ("John", None)]
    over = pipe(states, O.appendcol(lambda t: t.selectExpr("age + 1 as age"), override=True, order=["name"], sub_order=["age"]))
    assert over.columns == ["name", "state", "country", "age"]


def test_fieldsummary(spark):
    rows = [(1, 200), (2, None), (3, None), (4, 301), (5, 200), (6, 403)]
    df = spark.createDataFrame(rows, "id int, status_code int")
    (row,) = pipe(df, O.fieldsummary(["status_code"])).collect()
    assert tuple(row)[:7] == ("status_code", 4, 3, "200", "403", 276.0, 276.0) and abs(row["STDDEV"] - 97.1356439899038) < 1e-9
    assert (row["Nulls"], row["TYPEOF"]) == (2, "int")
    assert pipe(df, O.fieldsummary(["status_code"], nulls=True)).first()["AVG"] == 184.0
    assert pipe(df.limit(0), O.fieldsummary()).count() == 0


def test_correlate(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, n string")
    b = spark.createDataFrame([(1, "z"), (9, "y"), (7, "w")], "j int, m string")
    assert tuples(O.correlate(a, b, [("k", "j")])) == [(1, "x", 1, "z")]
    found = set(tuples(O.correlate(a, b, [("k", "j"), ("n", "m")], "approximate")))
    assert found == {(1, "x", 1, "z"), (2, "y", 9, "y"), (3, None, None, None), (None, None, 7, "w")}
    assert O.self_correlate(a, ["k"]).count() == 3


def test_join_needs_a_condition(people, work):
    with pytest.raises(ValueError):
        pipe(people, O.join(work, kind="left"))
    with pytest.raises(ValueError):
        O.join(work, "1 = 1", "sideways")


def test_not_in_with_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    some = spark.createDataFrame([(1,)], "j int")
    with_null = spark.createDataFrame([(1,), (None,)], "j int")
    assert tuples(pipe(a, O.in_subsearch("k", some, negate=True))) == [(2,)]
    assert pipe(a, O.in_subsearch("k", with_null, negate=True)).count() == 0
    assert pipe(a, O.in_subsearch("k", some.limit(0), negate=True)).count() == 3


def test_geoip(spark):
    ranges = spark.createDataFrame(
        [("JM", "Jamaica", 1123654912, 1123655168, True), ("CA", "Canada", 100, 200, True)],
        "country_iso_code string, country_name string, ip_range_start long, ip_range_end long, ipv4 boolean",
    ).withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("ip_range_start", "ip_range_end")})
    for c in ("continent_name", "region_iso_code", "region_name", "city_name", "time_zone", "location"):
        ranges = ranges.withColumn(c, F.lit(None).cast("string"))
    df = spark.createDataFrame([("66.249.157.90",), ("8.8.8.8",), (None,)], "ip string")
    assert sorted(map(str, tuples(pipe(df, O.geoip("country", "ip", ranges, ["COUNTRY_NAME"]))))) == sorted(map(str, [("66.249.157.90", "Jamaica"), ("8.8.8.8", None), (None, None)]))
    with pytest.raises(ValueError):
        O.geoip("x", "ip", ranges, ["CITY_NAME", "CITY_NAME"])


def test_explain_and_describe(spark, people):
    people.createOrReplaceTempView("people_view")
    assert "Physical Plan" in O.explain(people, "formatted")
    assert O.describe(spark, "people_view").count() >= 5
    with pytest.raises(ValueError):
        O.explain(people, "loudly")


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = pipe(spark.read.parquet(f"{sf_dir}/orders.parquet"), O.where("o_totalprice > 1000"), O.stats(O.count().alias("n"), by="o_orderstatus"))
    plan = O.explain(df, "formatted")
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plan


def test_moving_averages_over_pieces(spark, monkeypatch):
    """Frames that reach into the piece before see its last rows."""
    monkeypatch.setattr("rivulet.operators.windows._PIECE", 5)
    values = [float((i * 37) % 23) for i in range(43)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(3)
    got = pipe(df, O.trendline(O.sma(4, "v", "a"), O.wma(3, "v", "w"), sort=["i"]), O.sort("i")).collect()
    for i, r in enumerate(got):
        assert r["a"] == (None if i < 3 else pytest.approx(sum(values[i - 3 : i + 1]) / 4))
        assert r["w"] == (None if i < 2 else pytest.approx((values[i - 2] + 2 * values[i - 1] + 3 * values[i]) / 6))


def test_row_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1009 as k").repartition(7)
    rows = O.numbered(df, ["-k"], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 1001)) and [r["k"] for r in rows] == sorted((r["k"] for r in rows), reverse=True)
    assert O.numbered(df.limit(0), ["k"], "n").count() == 0


def test_take_keeps_few_rows(people):
    df = pipe(people, O.take("salary", 2, by="occupation", alias="low"))
    assert {(r["occupation"], tuple(r["low"])) for r in df.collect()} >= {("Doctor", (120000, 120000)), ("Artist", (70000,)), (None, (0,))}


def test_names_of_columns_and_expressions(states):
    df = pipe(states, O.stats(O.avg(F.col("age")), O.sum_("age * 2"), O.max_("age"), by=O.span(F.col("age"), 25)))
    assert df.columns == ["avg(age)", "sum(age * 2)", "max(age)", "span(age,25)"]


def test_not_in_with_several_keys_has_sql_rules(spark):
    rows = [(1, 2), (1, None), (None, None), (3, 4)]
    left = spark.createDataFrame(rows, "a long, __left long")

    def kept(right):
        df = spark.createDataFrame(right, "x long, y long")
        return sorted((tuple(r) for r in pipe(left, O.in_subsearch(["a", "__left"], df, negate=True)).collect()), key=repr)

    def want(right):  # not in: for every row the comparison is false
        false = lambda l, r: any(x is not None and y is not None and x != y for x, y in zip(l, r))
        return sorted((l for l in rows if all(false(l, r) for r in right)), key=repr)

    for right in ([], [(1, None)], [(2, 3)], [(1, 2)], [(None, None)], [(None, 4)], [(1, 2), (None, 9)], [(5, 6), (5, 6)]):
        assert kept(right) == want(right), right


def test_columns_of_the_user_survive(spark):
    df = spark.createDataFrame([(i, float(i), i, i, i) for i in range(5)], "i long, v double, __id long, __piece long, __row long")
    out = pipe(df, O.trendline(O.sma(2, "v", "a"), sort=["i"]), O.sort("i")).collect()
    assert [(r["__id"], r["__piece"], r["__row"], r["a"]) for r in out] == [(i, i, i, None if not i else i - 0.5) for i in range(5)]
    ranked = spark.createDataFrame([(1, 7)], "__rank long, v long")
    assert pipe(ranked, O.take("__rank", 2, by="v", alias="t")).first()["t"] == [1]
    with pytest.raises(ValueError):
        O.trendline(O.sma(2, "v"), by=["i"])


def test_frames_longer_than_a_piece(spark, monkeypatch):
    from rivulet.operators import windows

    monkeypatch.setattr(windows, "_PIECE", 4)
    got = pipe(spark.range(30).select("id", F.col("id").cast("double").alias("v")), O.trendline(O.sma(11, "v", "a"), sort=["id"]), O.sort("id")).collect()
    assert [r["a"] for r in got] == [None] * 10 + [float(i - 5) for i in range(10, 30)]


def test_skipping_over_folders_and_other_types(spark, tmp_path):
    from rivulet.indexes import skipping

    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(2022 + id % 2 as int) as year", "lpad(cast(id % 10 as string), 2, '0') as s").write.partitionBy("year").parquet(path)
    table = spark.read.parquet(path)
    for kinds in ({"year": "PARTITION"}, {"id": "MIN_MAX"}, {"id": "PARTITION"}, {"s": "BLOOM_FILTER"}):
        index = skipping.build(table, kinds)
        for conditions in ([("year", "=", 2023)], [("id", "<", 10)], [("id", "=", 50)], [("s", "=", 5)], [("s", "=", "05")], [("year", "in", [2022, 2030])]):
            want = table
            for c, op, v in conditions:
                want = want.where(F.col(c).isin(v) if op == "in" else F.col(c) < v if op == "<" else F.col(c) == F.lit(v))
            got = skipping.read(spark, path, index, kinds, conditions)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (kinds, conditions)


def test_written_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from rivulet.scratch import shared_dir

    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master, applicationId="a")))
    here = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="local[2]", applicationId="a"))
    assert shared_dir(here) == shared_dir(here)


def _sources(spark, keys):
    """Two sources whose keys have so many rows on either side, and rows without a key or a partner."""
    left = [(k, i % 3, f"a{i // 2}") for k, (n, _) in keys.items() for i in range(n)] + [(None, 7, "a"), (-1, 8, "b")]
    right = [(k, i % 4, f"b{i}") for k, (_, n) in keys.items() for i in range(n)] + [(None, 7, "c"), (-2, 9, "d")]
    return spark.createDataFrame(left, "k int, n int, x string"), spark.createDataFrame(right, "j int, m int, z string")


def test_correlate_shares_out_the_pairs_of_a_key(spark):
    a, b = _sources(spark, {5: (9000, 1500), 6: (40, 30)})
    shares = [r["count"] for r in O.correlate(a, b, [("k", "j")]).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 9000 * 1500 + 40 * 30 and max(shares) <= 0.8 * sum(shares)
    alone = O.correlate(a, b, [("k", "j")], "approximate")
    shares = [r["count"] for r in alone.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 9000 * 1500 + 40 * 30 + 4 and max(shares) <= 0.8 * sum(shares)


@pytest.mark.parametrize("mapping", [[("k", "j")], [("k", "j"), ("n", "m")], [("k", "j"), ("k", "m")], [("n", "m")]])
@pytest.mark.parametrize("kind", ["exact", "approximate"])
def test_correlate_with_heavy_keys_equals_a_plain_join(spark, mapping, kind):
    a, b = _sources(spark, {1: (3000, 50), 2: (300, 300), 3: (5, 4), 4: (0, 9)})
    a.createOrReplaceTempView("one"), b.createOrReplaceTempView("two")
    on = (" and " if kind == "exact" else " or ").join(f"{x} = {y}" for x, y in mapping)
    want = spark.sql(f"select * from one {'' if kind == 'exact' else 'full'} join two on {on}")
    found = O.correlate(a, b, mapping, kind)
    digest = ["count(*)", "sum(hash(k, n, x, j, m, z))", "bit_xor(xxhash64(k, n, x, j, m, z))", "count(x)", "count(z)"]
    assert found.columns == want.columns and found.selectExpr(*digest).first() == want.selectExpr(*digest).first()


@pytest.mark.parametrize("mapping", [[("k", "j")], [("k", "j"), ("n", "m")]])
def test_correlate_with_many_blocks_equals_a_plain_join(spark, monkeypatch, mapping):
    for name, value in {"_HEAVY": 50, "_RUN": 3, "_HELD": 12, "_STREAMED": 40, "_CELL": 100}.items():
        monkeypatch.setattr(f"rivulet.operators.joins.{name}", value)
    a, b = _sources(spark, {1: (300, 50), 2: (60, 90), 3: (5, 4), 4: (0, 9), 5: (1, 400), 6: (400, 1)})
    b = b.unionAll(spark.range(200).selectExpr("int(2)", "int(1)", "'alike'")).selectExpr("*", "map(m, z) as map", "array(z, z) as list")
    a.createOrReplaceTempView("one"), b.createOrReplaceTempView("two")
    want = spark.sql(f"select * from one join two on {' and '.join(f'{x} = {y}' for x, y in mapping)}")
    digest = ["count(*)", "sum(hash(k, n, x, j, m, z, list))", "bit_xor(xxhash64(k, n, x, j, m, z, list))", "sum(hash(map[m]))"]
    assert O.correlate(a, b, mapping).selectExpr(*digest).first() == want.selectExpr(*digest).first()


def test_blocks_of_wide_rows_hold_fewer_of_them(spark, monkeypatch):
    from rivulet.operators import joins

    saved, save = [], joins.save
    monkeypatch.setattr(joins, "save", lambda df, name: saved.append(save(df, name)) or saved[-1])
    wide = spark.range(600).selectExpr("id", "1 as j", "repeat(char(65 + id % 26), 20000) as text", "array(id) as list")
    found = O.correlate(spark.range(200).selectExpr("id as i", "1 as k"), wide, [("k", "j")]).select("i", "id", "text")
    assert found.selectExpr("count(distinct i, id)", "sum(length(text))").first() == (200 * 600, 200 * 600 * 20000)
    assert saved[0].first()["__held"] >= 600 * 20000 // joins._HELD_BYTES


def test_correlate_goes_through_partners_in_short_runs(spark):
    a, b = _sources(spark, {5: (9000, 1500)})
    first = O.correlate(a, b, [("k", "j")]).select("z").limit(5000)
    assert first.distinct().count() <= 300


def test_written_pairs_take_little_room(spark, tmp_path):
    """Partners come in short runs that repeat, so that files of pairs compress."""
    n = 6000
    pairs = O.self_correlate(spark.range(n).selectExpr("id * 7919 as id", "1 as k"), ["k"]).toDF("one", "k", "other", "k2")
    pairs.select("one", "other").coalesce(1).write.parquet(str(tmp_path / "pairs"))
    found = spark.read.parquet(str(tmp_path / "pairs")).selectExpr("count(*)", "sum(one)", "sum(other)").first()
    assert tuple(found) == (n * n, 7919 * n * n * (n - 1) // 2, 7919 * n * n * (n - 1) // 2)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.25 * n * n


def test_self_correlation_with_a_heavy_key_and_keys_of_other_types(spark):
    a = spark.range(700).selectExpr("id", "id % 2 as k", "map(id, id) as m")
    found = O.self_correlate(a, ["k"]).toDF("one", "k", "m", "other", "k2", "m2")
    assert found.select("one", "other").distinct().count() == found.count() == 2 * 350 * 350
    assert O.correlate(a, a.selectExpr("string(k) as j"), [("k", "j")]).count() == 2 * 350 * 350
