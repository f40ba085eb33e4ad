"""Reading and writing catalogs."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean_floats
from ..lineage import cut


def read_catalog(spark: SparkSession, path: str, ra: str = "ra", dec: str = "dec", z: str | None = None,
                 extra=(), fmt: str = "parquet") -> DataFrame:
    """Positions, and redshift if named, of a stored catalog; missing values as NULL."""
    cols = [F.col(ra).cast("double").alias("ra"), F.col(dec).cast("double").alias("dec")]
    if z is not None:
        cols.append(F.col(z).cast("double").alias("redshift"))
    return clean_floats(spark.read.format(fmt).load(path).select(*extra, *cols))


def flatten_schema(df: DataFrame) -> DataFrame:
    """Without array columns; names what it drops in a warning."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if arrays:
        warnings.warn(f"dropping array columns: {', '.join(arrays)}", stacklevel=2)
    return df.drop(*arrays)


def write_flat(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Store a catalog without array columns; an existing one is kept unless asked."""
    flatten_schema(df).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def number_rows(df: DataFrame, start: int = 0, name: str = "row_idx") -> DataFrame:
    """Consecutive row numbers from ``start``, without bringing rows together.

    Partitions are counted and each starts where the one before ends. The input is
    cut first so that both passes see the same partitions.
    """
    d = cut(df.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    w = W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    out = d.join(starts, "_p")
    return out.withColumn(name, F.lit(start) + F.col("_before") + F.col("_m") - F.col("_first")).drop(
        "_p", "_m", "_first", "_before")


def row_count(spark: SparkSession, path: str) -> int:
    """Stored rows; Parquet answers from its footers."""
    return spark.read.parquet(path).count()


def append_indexed(df: DataFrame, path: str, reindex: bool = True, mode: str = "append") -> None:
    """Append rows, their numbers continuing from the stored ones; ``mode='overwrite'`` replaces."""
    spark = df.sparkSession
    if not reindex:
        df.write.mode(mode).parquet(path)
        return
    start = 0
    if mode == "append":
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            start = row_count(spark, path)
    number_rows(df, start).write.mode(mode).parquet(path)


def copy_columns(df: DataFrame, path: str, columns=("ra", "dec"), mode: str = "append") -> None:
    df.select(*columns).write.mode(mode).parquet(path)
