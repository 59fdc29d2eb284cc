"""Driver tables (one parquet file per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table. A table stored in fewer splits than the cluster
    has task slots (a single small file) is spread round-robin so that the
    regex-heavy text work is not confined to one task; a large table already
    has enough splits and is read as is."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    slots = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        df = df.repartition(slots)
    return df
