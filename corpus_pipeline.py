"""From raw documents to a training mix: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm._scratch import save
from rivulet.llm._tables import table
from rivulet.llm.decontaminate import benchmark_items, drop_contaminated
from rivulet.llm.language_id import keep_known
from rivulet.llm.mixing import mixed_documents
from rivulet.llm.near_duplicates import keep_first
from rivulet.llm.secrets import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or far from every language that is known."""
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates."""
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return drop_contaminated(docs, benchmark_items(spark, sf_dir))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace live-looking credentials by a mark."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the mix takes, with the number of times."""
    return mixed_documents(docs, quality=table(spark, sf_dir, "labels").select("doc_id", "quality"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]

#: Language identification, MinHash and BM25 are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
