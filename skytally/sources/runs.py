"""Storing results by run, and count tables by correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import stash
from ..operators.counts import CELL, add_counts, assign_counts


def _stored(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_run(df: DataFrame, path: str) -> int:
    """Store a result under the next run number, which is returned."""
    spark = df.sparkSession
    last = None
    if _stored(spark, path):
        last = spark.read.parquet(path).agg(F.max("run_id")).first()[0]
    run = 0 if last is None else int(last) + 1
    df.write.mode("errorifexists").parquet(f"{path}/run_id={run}")
    return run


def pick_run(runs: DataFrame, n: int) -> DataFrame:
    """Rows of run number ``n``, or of the n-th latest for a negative ``n``."""
    if n >= 0:
        return runs.where(F.col("run_id") == n)
    ids = runs.select("run_id").distinct()
    ranked = ids.withColumn("_r", F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy(F.desc("run_id"))))
    return runs.join(ranked.where(F.col("_r") == -n).select("run_id"), "run_id", "left_semi")


def load_run(spark: SparkSession, path: str, n: int = -1) -> DataFrame:
    return pick_run(spark.read.parquet(path), n)


PARTS = ("corr_id", "zbin", "term")


def save_counts(counts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a count table in one folder per correlation, redshift bin and term.

    Rows are rebalanced by these keys: small terms share a task, and a term larger than a task is
    split over several.
    """
    counts.hint("rebalance", *PARTS).write.mode(mode).partitionBy(*PARTS).parquet(path)


def update_counts(delta: DataFrame, path: str, how: str = "add") -> None:
    """Add a count table onto stored ones (``how='add'``), or replace the entries that it has (``'assign'``).

    Only the folders of correlations, bins and terms that ``delta`` has are read and written; all others
    stay as they are. The new rows are written aside first, so a lost executor or a failed
    write leaves the stored table whole; the swap is one commit. Without a stored table, ``delta`` becomes it.
    Two updates of one table must not run at once.
    """
    if how not in ("add", "assign"):
        raise ValueError(f"unknown update {how!r}")
    spark = delta.sparkSession
    columns = [*PARTS, *CELL, "n"]
    delta = delta.select(*columns)
    if _stored(spark, path):
        touched = delta.select(*PARTS).distinct()
        old = load_counts(spark, path).select(*[F.col(c).cast(delta.schema[c].dataType) for c in columns])
        old = old.join(touched, list(PARTS), "left_semi")
        delta = (add_counts if how == "add" else assign_counts)(old, delta, PARTS)
    new = stash(delta, "counts")
    (new.hint("rebalance", *PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTS).parquet(path))


def load_counts(spark: SparkSession, path: str, corr_id: int | None = None, zbin: int | None = None,
                term: str | None = None) -> DataFrame:
    """Stored counts; given keys prune whole folders."""
    df = spark.read.parquet(path)
    for name, value in (("corr_id", corr_id), ("zbin", zbin), ("term", term)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """A stored table, made and stored first if it is not there."""
    if not _stored(spark, path):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
