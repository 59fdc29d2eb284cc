"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.llm.common import shared_folder


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again, which cuts the lineage."""
    folder = shared_folder(df.sparkSession, "edges")
    df.write.parquet(folder)
    return df.sparkSession.read.schema("u long, v long").parquet(folder)


def _sum(df: DataFrame) -> tuple:
    """Number of rows and an order-free sum over them."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has an edge, but the smallest of its component, with that smallest one.

    A step never lengthens a path and each round at least halves the longest, so the number of
    rounds follows the logarithm of the longest path; the loop ends when a round changes nothing.
    """
    now = _kept(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _sum(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")).hint("rebalance")
        large = both.join(low, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        pointed = large.join(least.hint("rebalance"), F.col("u") == F.col("k")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = _kept(pointed.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct())
        before, state = state, _sum(following)
        now = following
        if state == before:
            break
    return now
