"""Filters, projections, expressions, order and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet import functions as R
from rivulet.operators import (
    avg,
    case,
    count,
    evaluate,
    fields,
    fields_except,
    fillnull,
    head,
    if_,
    join,
    pipe,
    rename,
    sort,
    source,
    stats,
    sum_,
    where,
)
from rivulet.plans._registry import Tables, query


@query("""
SELECT sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price, sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price,
  sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price,
  avg(l_discount) AS avg_disc, count(*) AS count_order, l_returnflag, l_linestatus
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
""")
def pricing_summary(t: Tables) -> DataFrame:
    return pipe(
        t.lineitem,
        where("l_shipdate <= date'1998-09-02'"),
        stats(
            sum_("l_quantity").alias("sum_qty"), sum_("l_extendedprice").alias("sum_base_price"),
            sum_("l_extendedprice * (1 - l_discount)").alias("sum_disc_price"),
            sum_("l_extendedprice * (1 - l_discount) * (1 + l_tax)").alias("sum_charge"),
            avg("l_quantity").alias("avg_qty"), avg("l_extendedprice").alias("avg_price"), avg("l_discount").alias("avg_disc"),
            count().alias("count_order"), by=["l_returnflag", "l_linestatus"],
        ),
        sort("l_returnflag", "l_linestatus"),
    )


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus IN ('F', 'O')
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20
""")
def where_fields_sort_head(t: Tables) -> DataFrame:
    return pipe(
        t.orders, where("o_totalprice > 200000", "o_orderstatus in ('F', 'O')"), sort("-o_totalprice", "o_orderkey"), head(20),
        fields("o_orderkey", "o_custkey", "o_totalprice"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10")
def head_from(t: Tables) -> DataFrame:
    return pipe(t.orders, sort("o_orderkey"), head(5, offset=10), fields("o_orderkey", "o_totalprice"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def fields_minus(t: Tables) -> DataFrame:
    return pipe(t.customer, fields_except("c_nationkey", "c_acctbal"))


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross,
  upper(l_returnflag) AS l_returnflag FROM lineitem
""")
def eval_chain(t: Tables) -> DataFrame:
    return pipe(
        t.lineitem, evaluate(net="l_extendedprice * (1 - l_discount)", gross="net * (1 + l_tax)", l_returnflag="upper(l_returnflag)"),
        fields("l_orderkey", "l_linenumber", "net", "gross", "l_returnflag"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
  CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS dear FROM part WHERE p_size BETWEEN 5 AND 40 AND NOT p_name LIKE '%red%'
""")
def case_if_between_like(t: Tables) -> DataFrame:
    return pipe(
        t.part, where("p_size between 5 and 40", "not p_name like '%red%'"),
        evaluate(size_class=case(("p_size < 10", F.lit("small")), ("p_size < 30", F.lit("medium")), default=F.lit("large")), dear=if_("p_retailprice > 1000", F.lit(1), F.lit(0))),
        fields("p_partkey", "size_class", "dear"),
    )


@query("""
SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS priority, TRY_CAST(o_orderpriority AS INTEGER) AS nothing,
  CAST(o_orderkey AS VARCHAR) AS key_text FROM orders
""")
def cast_types(t: Tables) -> DataFrame:
    return pipe(
        t.orders,
        evaluate(priority=R.cast(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), "integer"), nothing=R.cast("o_orderpriority", "integer"), key_text=R.cast("o_orderkey", "string")),
        fields("o_orderkey", "priority", "nothing", "key_text"),
    )


@query("SELECT s_suppkey, s_name, s_nationkey AS nation_key, s_acctbal AS balance FROM supplier")
def rename_fields(t: Tables) -> DataFrame:
    return pipe(t.supplier, rename(s_nationkey="nation_key", s_acctbal="balance"))


@query("""
SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(o_orderstatus, 'none') AS o_orderstatus
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) ON c_custkey = o_custkey
""")
def fillnull_columns(t: Tables) -> DataFrame:
    return pipe(
        t.customer, join(t.orders.where("o_totalprice > 450000"), "c_custkey = o_custkey", "left"),
        fillnull(o_orderkey=-1, o_orderstatus=F.lit("none")), fields("c_custkey", "o_orderkey", "o_orderstatus"),
    )


@query("""
SELECT name, key, balance, segment FROM (
  SELECT c_name AS name, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
  UNION ALL SELECT s_name, s_suppkey, s_acctbal, NULL FROM supplier)
WHERE balance > 5000
""")
def union_by_name(t: Tables) -> DataFrame:
    customers = t.customer.selectExpr("c_name as name", "c_custkey as key", "c_acctbal as balance", "c_mktsegment as segment")
    suppliers = t.supplier.selectExpr("s_acctbal as balance", "s_name as name", "s_suppkey as key")
    return pipe(source(t.spark, customers, suppliers), where("balance > 5000"), fields("name", "key", "balance", "segment"))


@query("""
SELECT event_id, (value > 50) <> (event_type = 'click') AS odd, value % 7 AS rest, value / nullif(user_id, 0) AS share, user_id + event_id AS total
FROM events WHERE user_id > 0
""")
def arithmetic_and_xor(t: Tables) -> DataFrame:
    return pipe(
        t.events, where("user_id > 0"),
        evaluate(odd=R.xor(F.expr("value > 50"), F.expr("event_type = 'click'")), rest=R.modulus(F.col("value"), 7.0), share=R.divide(F.col("value"), F.col("user_id")), total=R.add(F.col("user_id"), F.col("event_id"))),
        fields("event_id", "odd", "rest", "share", "total"),
    )
