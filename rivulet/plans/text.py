"""Fields from text, and nested data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet import operators as O  # noqa: N812
from rivulet.operators import count, expand, fields, flatten, grok, parse, patterns, pipe, stats
from rivulet.plans._registry import Tables, query


@query(r"""
SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)', 2) AS host,
  regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)', 3) AS lang FROM pages
""")
def parse_url(t: Tables) -> DataFrame:
    return pipe(t.pages, parse("url", r"^(?<scheme>https?)://(?<host>[^/]+)/(?<lang>[a-z]+)"), fields("page_id", "scheme", "host", "lang"))


@query(r"""
SELECT count(*) AS n, regexp_extract(url, '([A-Za-z]+)://(\b(?:[0-9A-Za-z][0-9A-Za-z-]{0,62})(?:\.(?:[0-9A-Za-z][0-9A-Za-z-]{0,62}))*)', 2) AS host FROM pages GROUP BY ALL
""")
def grok_host(t: Tables) -> DataFrame:
    return pipe(t.pages, grok("url", "%{URIPROTO:scheme}://%{HOSTNAME:host}"), stats(count().alias("n"), by="host"))


@query("SELECT doc_id, regexp_replace(text, '[a-zA-Z0-9]', '', 'g') AS patterns_field FROM documents")
def patterns_default(t: Tables) -> DataFrame:
    return pipe(t.documents, patterns("text"), fields("doc_id", "patterns_field"))


@query(r"SELECT doc_id, regexp_replace(text, '[^.!?]', '', 'g') AS ends FROM documents")
def patterns_custom(t: Tables) -> DataFrame:
    return pipe(t.documents, patterns("text", "ends", r"[^.!?]"), fields("doc_id", "ends"))


@query("SELECT n_nationkey, n_name AS label, n_regionkey AS code FROM nation")
def flatten_struct(t: Tables) -> DataFrame:
    return pipe(t.nation.selectExpr("n_nationkey", "struct(n_name as label, n_regionkey as code) as info"), flatten("info"))


@query("SELECT r_name, n_nationkey, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey")
def flatten_array(t: Tables) -> DataFrame:
    members = t.nation.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("members"))
    return pipe(t.region.join(members, F.expr("n_regionkey = r_regionkey"), "left").select("r_name", "members"), flatten("members"))


@query("SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings")
def expand_array(t: Tables) -> DataFrame:
    return pipe(t.embeddings, fields("vec_id", "embedding"), expand("embedding", "x")).select("vec_id", F.col("x").cast("double").alias("x"))


@query("""
SELECT key, sum(value) AS total FROM (SELECT 'size' AS key, p_size::DOUBLE AS value FROM part UNION ALL SELECT 'price', p_retailprice FROM part) GROUP BY key
""")
def expand_map(t: Tables) -> DataFrame:
    facts = t.part.select(F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice")).alias("facts"))
    return pipe(facts, expand("facts", "fact"), stats(O.sum_("value").alias("total"), by="key"))
