"""Joins of all kinds, look-ups, correlation and subsearches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet import operators as O  # noqa: N812
from rivulet.operators import count, exists_in, fields, in_subsearch, join, lookup, pipe, stats, where
from rivulet.plans._registry import Tables, query


def _big(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 300000")


def _kind(kind: str, sql: str) -> None:
    def run(t: Tables) -> DataFrame:
        out = pipe(t.customer, join(_big(t), "l.c_custkey = r.o_custkey", kind, left="l", right="r"))
        return out.select(*[c for c in ("c_custkey", "c_nationkey", "o_orderkey") if c in out.columns])

    run.__name__ = f"join_{kind}"
    columns = "c_custkey, c_nationkey" + ("" if kind in ("semi", "anti") else ", o_orderkey")
    query(f"SELECT {columns} FROM customer {sql} JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")(run)


def _kind_all(kind: str, sql: str) -> None:
    def run(t: Tables) -> DataFrame:
        out = pipe(t.customer, join(t.orders, "l.c_custkey = r.o_custkey", kind, left="l", right="r"))
        return out.select(*[c for c in ("c_custkey", "c_nationkey", "o_orderkey") if c in out.columns])

    run.__name__ = f"join_{kind}_all"
    columns = "c_custkey, c_nationkey" + ("" if kind in ("semi", "anti") else ", o_orderkey")
    query(f"SELECT {columns} FROM customer {sql} JOIN orders ON c_custkey = o_custkey")(run)


for _name, _sql in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("semi", "SEMI"), ("anti", "ANTI")):
    _kind(_name, _sql)
    _kind_all(_name, _sql)


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    return pipe(t.region, join(t.nation), fields("r_name", "n_name"))


@query("SELECT a.s_suppkey AS one, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(t: Tables) -> DataFrame:
    return pipe(
        t.supplier, join(t.supplier, "a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey", left="a", right="b", right_hint="broadcast")
    ).select(F.col("a.s_suppkey").alias("one"), F.col("b.s_suppkey").alias("other"))


@query("""
SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1998-01-01' AND r_name = (SELECT min(r_name) FROM region) GROUP BY n_name
""")
def local_supplier_revenue(t: Tables) -> DataFrame:
    first = t.region.agg(F.min("r_name").alias("r_name"))
    nations = pipe(t.nation, join(pipe(t.region, in_subsearch("r_name", first)), "n_regionkey = r_regionkey"))
    return pipe(
        t.customer, join(t.orders.where("o_orderdate >= date'1995-01-01' and o_orderdate < date'1998-01-01'"), "c_custkey = o_custkey"),
        join(t.lineitem, "l_orderkey = o_orderkey"), join(t.supplier, "l_suppkey = s_suppkey and c_nationkey = s_nationkey"),
        join(nations, "s_nationkey = n_nationkey"), stats(O.sum_("l_extendedprice * (1 - l_discount)").alias("revenue"), by="n_name"),
    )


@query("""
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10
""")
def shipping_priority(t: Tables) -> DataFrame:
    return pipe(
        t.customer.where("c_mktsegment = 'BUILDING'"), join(t.orders.where("o_orderdate < date'1998-03-15'"), "c_custkey = o_custkey"),
        join(t.lineitem.where("l_shipdate > date'1998-03-15'"), "l_orderkey = o_orderkey"),
        stats(F.round(O.sum_("l_extendedprice * (1 - l_discount)"), 2).alias("revenue"), by=["l_orderkey", "o_orderdate"]),
        O.sort("-revenue", "o_orderdate", "l_orderkey"), O.head(10), fields("l_orderkey", "revenue", "o_orderdate"),
    )


@query("SELECT c_custkey, n_name AS nation, n_regionkey AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_replace(t: Tables) -> DataFrame:
    return pipe(
        t.customer, fields("c_custkey", "c_nationkey"),
        lookup(t.nation, {"n_nationkey": "c_nationkey"}, replace={"n_name": "nation", "n_regionkey": "region"}), fields("c_custkey", "nation", "region"),
    )


@query("""
SELECT s_suppkey, coalesce(CASE WHEN s_nationkey % 2 = 0 THEN s_name END, n_name) AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
""")
def lookup_append(t: Tables) -> DataFrame:
    suppliers = t.supplier.selectExpr("s_suppkey", "s_nationkey", "case when s_nationkey % 2 = 0 then s_name end as label")
    return pipe(suppliers, lookup(t.nation, {"n_nationkey": "s_nationkey"}, append={"n_name": "label"}), fields("s_suppkey", "label"))


@query("SELECT n_regionkey AS r_regionkey, n_nationkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_all(t: Tables) -> DataFrame:
    return pipe(t.nation.selectExpr("n_regionkey as r_regionkey", "n_nationkey"), lookup(t.region, ["r_regionkey"]))


@query("SELECT c_custkey, s_suppkey, c_nationkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def correlate_exact(t: Tables) -> DataFrame:
    customers, suppliers = t.customer.select("c_custkey", "c_nationkey"), t.supplier.select("s_suppkey", "s_nationkey")
    return pipe(O.correlate(customers, suppliers, [("c_nationkey", "s_nationkey")]), fields("c_custkey", "s_suppkey", "c_nationkey"))


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey OR c_custkey = s_suppkey")
def correlate_approximate(t: Tables) -> DataFrame:
    customers, suppliers = t.customer.select("c_custkey", "c_nationkey"), t.supplier.select("s_suppkey", "s_nationkey")
    return pipe(O.correlate(customers, suppliers, [("c_nationkey", "s_nationkey"), ("c_custkey", "s_suppkey")], "approximate"), fields("c_custkey", "s_suppkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def subsearch_in(t: Tables) -> DataFrame:
    return pipe(t.customer, in_subsearch("c_custkey", t.orders.where("o_totalprice > 400000").select("o_custkey")), fields("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def subsearch_not_in(t: Tables) -> DataFrame:
    return pipe(t.customer, in_subsearch("c_custkey", t.orders.where("o_totalprice > 100000").select("o_custkey"), negate=True), fields("c_custkey"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority")
def subsearch_exists(t: Tables) -> DataFrame:
    return pipe(t.orders, exists_in(t.lineitem.where("l_quantity > 45"), "l_orderkey = o_orderkey"), stats(count().alias("n"), by="o_orderpriority"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.05)")
def subsearch_not_exists(t: Tables) -> DataFrame:
    return pipe(t.part, exists_in(t.lineitem.where("l_discount > 0.05"), "l_partkey = p_partkey", negate=True), fields("p_partkey"))


@query("SELECT o_orderkey, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS above FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def subsearch_scalar(t: Tables) -> DataFrame:
    mean = t.orders.agg(F.avg("o_totalprice"))
    return pipe(t.orders, O.with_scalar("mean", mean), where("o_totalprice > mean"), O.evaluate(above="o_totalprice - mean"), fields("o_orderkey", "above"))


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest FROM customer")
def subsearch_correlated_scalar(t: Tables) -> DataFrame:
    most = t.orders.where(F.col("o_custkey") == F.col("c_custkey").outer()).select(F.max("o_totalprice"))
    return pipe(t.customer, O.with_scalar("largest", most), fields("c_custkey", "largest"))
