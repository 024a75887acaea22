"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight. Inside a source the
documents stand in order of their keys; complete epochs come first, and the rest of the source's
word budget goes to the documents whose prefix sum of words reaches it.

No source is gathered in one task: word counts are summed by (source, key range), which shows in
which of the ranges the budget ends, and only the documents of that one range are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm._scratch import save
from rivulet.llm._tables import table

WORD = r"[^\x20\x09-\x0D]+"
_RANGES = 4096
_BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, quality: Column, seed: str = "mix") -> Column:
    """``-ln(u) / quality`` with u in (0, 1] drawn from the id, so that reruns agree."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(1 << 52))
    return -F.ln(u) / quality


def source_targets(sizes: DataFrame, weights: Sequence[int], ratio: float, max_epochs: int) -> DataFrame:
    """Targets from (source, source_size): one row per source, so the windows see no documents.

    Sources by code point (null last) take the weights in turn and share ``ratio`` of all words;
    none takes over ``max_epochs`` times its size. With sources in order of cap/weight, those
    below the common level are capped and the others get the level times their weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = Window.orderBy("cap_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
        .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("cap_ratio", F.col("cap") / F.col("weight"))
    )
    left = F.lit(ratio) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(level), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(level), F.lit(0))
    leveled = ranked.withColumn("level", left / open_weight)
    fits = F.when(F.col("level") <= F.col("cap_ratio"), F.struct("cap_ratio", "level"))
    return leveled.withColumn("level", F.min(fits).over(everything)["level"]).select(
        "source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target")
    )


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    quality: DataFrame | None = None,
    weights: Sequence[int] = (5, 2, 1),
    ratio: float = 1.5,
    max_epochs: int = 2,
) -> DataFrame:
    """How often the mix takes each document: doc_id, text_key, source, size, source_size, target, epochs, taken.

    ``quality`` has (doc_id, quality 0 or 1): quality 1 weighs 2, 0 weighs 0.5, others 1. Whole
    documents are taken; the one at which the budget ends is taken if that comes closer to it.
    Null texts have no words; null sources are one source, null ids draw one key. Ties of keys
    go by id and size; repeated rows are separate documents. An empty table gives no rows.
    """
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_key"),
        F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
    )
    weight = F.lit(1.0)
    if quality is not None:
        known = quality.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"))
        slim = slim.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id")
        weight = F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0)
    slim = slim.withColumn("key", sampling_key(F.col("doc_id"), weight)).drop("_quality")
    slim = slim.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * _RANGES).cast("int"))
    slim = save(slim, "mix-sizes")

    ranges = save(slim.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ratio, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("whole", epochs.cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    upto = Window.partitionBy("source").orderBy("range")
    summed = ranges.withColumn("upto", F.sum("words").over(upto)).withColumnRenamed("source", "_source")
    ends = (
        plan.join(summed, F.col("source").eqNullSafe(F.col("_source")))
        .groupBy("source", "source_size", "target", "whole", "rest")
        .agg(F.min(F.when(F.col("upto") > F.col("rest"), F.struct("range", F.col("upto") - F.col("words")))).alias("end"))
        .select(
            F.col("source").alias("_source"), "source_size", "target", "whole", "rest",
            F.coalesce(F.col("end")["range"], F.lit(_RANGES + 1)).alias("end"),
            F.coalesce(F.col("end")["col2"], F.lit(0)).alias("base"),
        )
    )
    ends = save(ends, "mix-plan")
    if ends.count() <= _BROADCAST_SOURCES:
        ends = F.broadcast(ends)
    joined = slim.join(ends, F.col("source").eqNullSafe(F.col("_source")))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "text_key")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("base")
    last = joined.where(F.col("range") == F.col("end")).withColumn(
        "extra", (before + F.col("size") / F.lit(2.0) <= F.col("rest")).cast("long")
    )
    others = joined.where(F.col("range") != F.col("end")).withColumn("extra", (F.col("range") < F.col("end")).cast("long"))
    times = F.least(F.col("whole") + F.col("extra"), F.lit(max_epochs))  # texts without words fit any rest
    return others.unionByName(last).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", times.alias("epochs"), (F.col("size") * times).alias("taken")
    )


def mixed_documents(docs: DataFrame, *, quality: DataFrame | None = None) -> DataFrame:
    """The documents that the mix takes, with ``epochs``: how often.

    Each of several rows with one id and text gets a number of its own, so that together they stay
    within the budget; the rows are told apart by their other columns. Null texts and ids are
    documents like others; an empty table stays empty.
    """
    names = [n for n in docs.columns if n != "epochs"]
    taken = (
        mix(docs, quality=quality)
        .groupBy(F.col("doc_id").alias("_rv_id"), F.col("text_key").alias("_rv_key"))
        .agg(F.sort_array(F.collect_list("epochs"), asc=False).alias("_rv_epochs")).where(F.element_at("_rv_epochs", 1) > 0)
    )
    same = F.col("doc_id").eqNullSafe(F.col("_rv_id")) & (F.xxhash64("text") == F.col("_rv_key"))
    found = docs.select(*names).join(taken, same)
    once = found.where(F.size("_rv_epochs") == 1).withColumn("epochs", F.element_at("_rv_epochs", 1))
    order = Window.partitionBy("_rv_id", "_rv_key").orderBy(*names)
    again = found.where(F.size("_rv_epochs") > 1).withColumn("epochs", F.get("_rv_epochs", F.row_number().over(order) - 1))
    return once.unionByName(again).where("epochs > 0").select(*names, "epochs")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, quality=table(spark, sf_dir, "labels").select("doc_id", "quality")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS w
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)
), k AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0::DOUBLE) / w AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, (2 * source_size)::DOUBLE AS cap, (2 * source_size)::DOUBLE / weight AS cap_ratio FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM r WINDOW before AS (ORDER BY cap_ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, (SELECT min_by(level, cap_ratio) FROM l WHERE level <= cap_ratio) * weight) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
), c AS (
  SELECT k.doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
