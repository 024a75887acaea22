import datetime
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import assert_same, duck

import __spark_entry__ as entry
from rivulet.plans import QUERIES, SQL


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert_same(df, SQL[name], sf_dir)
    else:
        assert df.count() > 0


@pytest.mark.parametrize(
    ("name", "column", "table", "key"),
    [(f"join_{kind}_all", "o_orderkey", "orders", "o_orderkey") for kind in ("inner", "left", "right", "full")]
    + [(f"join_{kind}{all_}", "c_custkey", "customer", "c_custkey") for kind in ("left", "full") for all_ in ("", "_all")]
    + [(f"correlate_{kind}", "s_suppkey", "supplier", "s_suppkey") for kind in ("exact", "approximate")],
)
def test_whole_tables_enter_the_operator(spark, sf_dir, name, column, table, key):
    want = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct().count()
    assert QUERIES[name](spark, sf_dir).where(f"{column} is not null").select(column).distinct().count() == want


@pytest.mark.parametrize("name", ["correlate_exact", "correlate_approximate", "self_correlation"])
def test_correlations_of_shared_out_keys_match_sql(spark, sf_dir, monkeypatch, name):
    for constant, value in {"_HEAVY": 1, "_RUN": 2, "_HELD": 4, "_CELL": 20}.items():
        monkeypatch.setattr(f"rivulet.operators.joins.{constant}", value)
    df = QUERIES[name](spark, sf_dir)
    sent = set(re.findall(r"collect_list\(struct\((.*?)\),", df._jdf.queryExecution().optimizedPlan().toString()))
    assert sent and all(len(set(re.findall(r"__b\d+", x))) == 1 for x in sent)  # the partner's key, nothing else
    assert_same(df, SQL[name], sf_dir)


@pytest.mark.parametrize("all_", ["", "_all"])
def test_semi_and_anti_joins_share_out_all_customers(spark, sf_dir, all_):
    parts = [QUERIES[f"join_{kind}{all_}"](spark, sf_dir).count() for kind in ("semi", "anti")]
    assert sum(parts) == spark.read.parquet(f"{sf_dir}/customer.parquet").count()


def test_conditions_see_all_orders(spark, sf_dir):
    assert QUERIES["condition_functions"](spark, sf_dir).agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_whole_seconds_are_those_of_the_sql(spark, sf_dir, tmp_path):
    """Compared exactly: the other comparison keeps seven digits, and a second is the tenth."""
    day, odd = datetime.datetime(2024, 1, 1), datetime.datetime(1969, 12, 31, 23, 59, 50)
    micros = [0, 1, 499_999, 500_000, 500_001, 999_999, 1_499_999, 1_500_000, 1_500_001]
    times = [t + datetime.timedelta(microseconds=m) for t in (day, odd) for m in micros] + [None]
    pq.write_table(pa.table({"event_id": pa.array(range(len(times)), pa.int64()), "ts": pa.array(times, pa.timestamp("us"))}), tmp_path / "events.parquet")
    for place in (sf_dir, str(tmp_path)):
        names, want = duck(SQL["date_functions_named"], place)
        found = QUERIES["date_functions_named"](spark, place).select(*names).collect()
        assert sorted(map(tuple, found)) == sorted(want)
