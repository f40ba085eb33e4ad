"""A corpus pipeline of five stages, each applied to what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skytally.lineage import stash
from skytally.llm.decontaminate import decontaminated
from skytally.llm.language import held_out, known_language, prototypes
from skytally.llm.minhash import near_duplicates
from skytally.llm.mixing import mixed
from skytally.llm.sharding import sharded


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters, or too unlike every language, go."""
    names, protos = prototypes(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return known_language(docs, names, protos)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    dropped = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the mix takes it."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that each is written to."""
    return sharded(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Language profiles and seeded signatures have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
