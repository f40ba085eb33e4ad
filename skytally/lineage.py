"""Cutting a growing plan in iterative operators.

Tables and checkpoints go to the folder the cluster names in
`spark.checkpoint.dir`, which all executors share, so a lost executor never
loses a cut result.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(df_or_spark) -> str:
    """The folder the cluster names for checkpoints.

    A session on one machine (`local[...]`) that names none gets a folder under
    its warehouse; on a cluster a missing setting is an error, because a folder
    made up here would lie on one machine only.
    """
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cut"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df)
    return df.checkpoint(eager=True)


def wide_tasks(df: DataFrame) -> int:
    """How many tasks share work that is large for its few bytes; AQE leaves a given number alone."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def stash(df: DataFrame, name: str = "stash") -> DataFrame:
    """The rows written once as a Parquet table in the shared folder, and read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
