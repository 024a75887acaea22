"""Groups, buckets, statistics on rows, frequent values, distinct rows and moving averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet import operators as O  # noqa: N812
from rivulet.operators import count, dedup, eventstats, fields, pipe, sma, sort, span, stats, trendline, where, wma
from rivulet.plans._registry import Tables, query


@query("SELECT count(*) AS n, avg(l_extendedprice) AS mean_price, floor(l_quantity / 10) * 10 AS bucket FROM lineitem GROUP BY ALL")
def stats_span_number(t: Tables) -> DataFrame:
    return pipe(t.lineitem, stats(count().alias("n"), O.avg("l_extendedprice").alias("mean_price"), by=span("l_quantity", 10.0, alias="bucket")))


@query("SELECT count(*) AS n, sum(value) AS total, event_type, date_trunc('day', ts) AS day FROM events GROUP BY ALL")
def stats_span_day(t: Tables) -> DataFrame:
    return pipe(
        t.events, stats(count().alias("n"), O.sum_("value").alias("total"), by=["event_type", span("ts", 1, "d", alias="w")])
    ).select("n", "total", "event_type", F.col("w.start").cast("timestamp_ntz").alias("day"))


@query("SELECT count(*) AS n, to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS quarter_hour FROM events GROUP BY ALL")
def stats_span_minutes(t: Tables) -> DataFrame:
    return pipe(t.events, stats(count().alias("n"), by=span("ts", 15, "m", alias="w"))).select("n", F.col("w.start").cast("timestamp_ntz").alias("quarter_hour"))


@query("SELECT count(*) AS n, date_trunc('quarter', o_orderdate) AS quarter FROM orders GROUP BY ALL")
def stats_span_quarter(t: Tables) -> DataFrame:
    return pipe(t.orders, stats(count().alias("n"), by=span("o_orderdate", 1, "q", alias="w"))).select("n", F.col("w.start").alias("quarter"))


@query("""
SELECT count(DISTINCT user_id) AS users, stddev_pop(value) AS sd_pop, stddev_samp(value) AS sd_samp, var_pop(value) AS v_pop, var_samp(value) AS v_samp,
  min(value) AS low, max(value) AS high, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.9) AS p90, event_type FROM events GROUP BY event_type
""")
def stats_functions(t: Tables) -> DataFrame:
    return pipe(
        t.events,
        stats(
            O.distinct_count("user_id").alias("users"), O.stddev("value").alias("sd_pop"), O.stddev_samp("value").alias("sd_samp"),
            O.variance("value").alias("v_pop"), O.var_samp("value").alias("v_samp"), O.min_("value").alias("low"), O.max_("value").alias("high"),
            O.percentile("value", 25).alias("p25"), O.percentile("value", 90).alias("p90"), by="event_type",
        ),
    )


@query()
def stats_approximate(t: Tables) -> DataFrame:
    return pipe(
        t.events,
        stats(O.distinct_count_approx("user_id").alias("users"), O.percentile_approx("value", 50).alias("median"), by="event_type"),
    )


@query("SELECT array_to_string(list(s_suppkey ORDER BY s_suppkey)[1:3], ',') AS first_three, s_nationkey FROM supplier GROUP BY s_nationkey")
def stats_take(t: Tables) -> DataFrame:
    return pipe(t.supplier, O.take("s_suppkey", 3, by="s_nationkey", alias="first")).select(F.array_join("first", ",").alias("first_three"), "s_nationkey")


@query("""
SELECT event_id, value, event_type, avg(value) OVER (PARTITION BY event_type) AS mean_value, count(*) OVER (PARTITION BY event_type) AS n FROM events
""")
def eventstats_by(t: Tables) -> DataFrame:
    return pipe(t.events, fields("event_id", "value", "event_type"), eventstats(O.avg("value").alias("mean_value"), count().alias("n"), by="event_type"))


@query("""
SELECT e.event_id, e.user_id, u.kinds, t.total FROM events e JOIN (SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id) u
ON e.user_id = u.user_id CROSS JOIN (SELECT sum(value) AS total FROM events) t
""")
def eventstats_distinct(t: Tables) -> DataFrame:
    return pipe(
        t.events, eventstats(O.distinct_count("event_type").alias("kinds"), by="user_id"), eventstats(O.sum_("value").alias("total")),
        fields("event_id", "user_id", "kinds", "total"),
    )


@query("SELECT count(o_orderpriority) AS n, o_orderpriority FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 3")
def top_values(t: Tables) -> DataFrame:
    return pipe(t.orders, O.top("o_orderpriority", 3, count_name="n"))


@query("SELECT count(p_brand) AS count_p_brand, p_brand, p_type FROM part GROUP BY p_brand, p_type ORDER BY 1 DESC, p_brand, p_type LIMIT 10")
def top_by(t: Tables) -> DataFrame:
    return pipe(t.part, O.top_approx("p_brand", 10, by="p_type"))


@query("SELECT count(c_nationkey) AS count_c_nationkey, c_nationkey FROM customer GROUP BY c_nationkey ORDER BY 1, 2 LIMIT 5")
def rare_values(t: Tables) -> DataFrame:
    return pipe(t.customer, O.rare("c_nationkey", 5))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL")
def dedup_one(t: Tables) -> DataFrame:
    return pipe(t.customer, dedup(["c_nationkey", "c_mktsegment"]), fields("c_nationkey", "c_mktsegment"))


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2
""")
def dedup_two(t: Tables) -> DataFrame:
    return pipe(t.orders, dedup("o_custkey", 2, order=["-o_totalprice", "o_orderkey"]), fields("o_custkey", "o_orderkey"))


@query("""
WITH j AS (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey),
k AS (SELECT o_orderkey % 10 AS digit FROM j)
SELECT DISTINCT digit FROM k WHERE digit IS NOT NULL UNION ALL SELECT digit FROM k WHERE digit IS NULL
""")
def dedup_keep_empty(t: Tables) -> DataFrame:
    joined = t.customer.join(t.orders.where("o_totalprice > 400000"), F.expr("c_custkey = o_custkey"), "left")
    return pipe(joined.selectExpr("o_orderkey % 10 as digit"), dedup("digit", keepempty=True))


@query("""
SELECT n_nationkey, CASE WHEN count(*) OVER w >= 3 THEN avg(n_regionkey) OVER w END AS smooth,
  CASE WHEN count(*) OVER v >= 2 THEN (lag(n_regionkey) OVER (ORDER BY n_nationkey) * 1 + n_regionkey * 2) / 3.0::DOUBLE END AS weighted
FROM nation WINDOW w AS (ORDER BY n_nationkey ROWS 2 PRECEDING), v AS (ORDER BY n_nationkey ROWS 1 PRECEDING)
""")
def trendlines(t: Tables) -> DataFrame:
    return pipe(t.nation, trendline(sma(3, "n_regionkey", "smooth"), wma(2, "n_regionkey", "weighted"), sort=["n_nationkey"]), fields("n_nationkey", "smooth", "weighted"))


@query("""
SELECT event_id, CASE WHEN count(*) OVER w >= 4 THEN avg(value) OVER w END AS value_trendline FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING)
""")
def trendline_by(t: Tables) -> DataFrame:
    return pipe(t.events, trendline(sma(4, "value"), sort=["ts", "event_id"], by=["user_id"]), fields("event_id", "value_trendline"))


@query("""
WITH a AS (SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY o_orderpriority) AS k FROM orders GROUP BY 1),
b AS (SELECT o_orderstatus, max(o_totalprice) AS high, row_number() OVER (ORDER BY o_orderstatus) AS k FROM orders GROUP BY 1)
SELECT n, o_orderpriority, high, o_orderstatus FROM a FULL JOIN b USING (k)
""")
def append_columns(t: Tables) -> DataFrame:
    orders = t.orders
    return pipe(
        orders, stats(count().alias("n"), by="o_orderpriority"),
        O.appendcol(lambda _: pipe(orders, stats(O.max_("o_totalprice").alias("high"), by="o_orderstatus")), order=["o_orderpriority"], sub_order=["o_orderstatus"]),
    )


@query("""
SELECT 'l_quantity' AS "Field", count(l_quantity) AS "COUNT", count(DISTINCT l_quantity) AS "DISTINCT", min(l_quantity)::VARCHAR AS "MIN", max(l_quantity)::VARCHAR AS "MAX", avg(l_quantity) AS "AVG", avg(l_quantity) AS "MEAN",
  stddev_samp(l_quantity) AS "STDDEV", count(*) - count(l_quantity) AS "Nulls", 'double' AS "TYPEOF" FROM lineitem
UNION ALL SELECT 'l_linenumber', count(l_linenumber), count(DISTINCT l_linenumber), min(l_linenumber)::VARCHAR, max(l_linenumber)::VARCHAR, avg(l_linenumber), avg(l_linenumber), stddev_samp(l_linenumber), count(*) - count(l_linenumber), 'int' FROM lineitem
UNION ALL SELECT 'l_returnflag', count(l_returnflag), count(DISTINCT l_returnflag), min(l_returnflag), max(l_returnflag), NULL, NULL, NULL, count(*) - count(l_returnflag), 'string' FROM lineitem
""")
def field_summary(t: Tables) -> DataFrame:
    return pipe(t.lineitem, O.fieldsummary(["l_quantity", "l_linenumber", "l_returnflag"]))


@query("SELECT * FROM (SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC NULLS LAST LIMIT 7) WHERE n_nationkey > 1")
def sort_head_where(t: Tables) -> DataFrame:
    return pipe(t.nation, sort("-n_name"), O.head(7), where("n_nationkey > 1"), fields("n_nationkey", "n_name"))
