"""Dataset splitting and sampling.

Seeded shuffles use md5(seed ':' key) as the sort key, so the order is the
same on every engine and every run (Python's Mersenne-twister order is not
reproduced). Global positions are computed with a range-partitioned sort plus
per-partition offsets, never with an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.session import cut_lineage


def seeded_key(seed: int, key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def global_rank(df: DataFrame, order_col: str, rank_col: str = "pos") -> DataFrame:
    """1-based position of every row in ``order_col`` order (ties broken by
    the row's other columns being irrelevant: keys are assumed unique).

    Stage 1: range-partitioned sort, materialised once (a reliable
    checkpoint) so that recomputation cannot move partition boundaries.
    Stage 2: per-partition row counts (one row per partition, broadcast) give
    each partition's offset; position = offset + index inside the partition."""
    ordered = df.orderBy(order_col).select("*", F.spark_partition_id().alias("_pid"),
                                           F.monotonically_increasing_id().alias("_mid"))
    ordered = cut_lineage(ordered)
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_base"))
    from pyspark.sql import Window
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_base", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per partition: bounded by the partition count, safe to broadcast
    out = ordered.join(F.broadcast(offsets), "_pid")
    return out.select(*[c for c in df.columns],
                      (F.col("_off") + (F.col("_mid") - F.col("_base")) + 1).cast("bigint").alias(rank_col))


def temporal_split(repos: DataFrame, date: str = P.SPLIT_DATE, ts_col: str = "created_at") -> DataFrame:
    """Created strictly after ``date`` -> held out, else train. String
    dates (dataset metadata) are parsed as ISO-8601 with an optional 'Z' (T11)."""
    from pyspark.sql.types import StringType
    from reposcope.functions.text import parse_iso_timestamp
    ts = (parse_iso_timestamp(ts_col) if isinstance(repos.schema[ts_col].dataType, StringType)
          else F.col(ts_col).cast("timestamp"))
    if isinstance(repos.schema[ts_col].dataType, StringType):
        # a date that cannot be read is an error, not a training row
        ts = F.when(F.col(ts_col).isNull() | ts.isNotNull(), ts).otherwise(
            F.raise_error(F.concat(F.lit("date cannot be read: "), F.col(ts_col))).cast("timestamp"))
    held = ts > F.lit(date).cast("timestamp")
    return repos.withColumn("split", F.when(held, F.lit("heldout")).otherwise(F.lit("train")))


def dev_test_split(repos: DataFrame, key: str = "full_name", date: str = P.SPLIT_DATE,
                   dev_ratio: float = P.DEV_RATIO, seed: int = P.SPLIT_SEED) -> DataFrame:
    """Held-out rows in seeded order; the first int(n * ratio + 1) are dev,
    the rest test; fewer than 2 held-out rows is an error."""
    t = temporal_split(repos, date)
    held = t.where(F.col("split") == "heldout").withColumn("_k", seeded_key(seed, key))
    ranked = global_rank(held, "_k", "_pos")
    n = held.count()  # one scalar to the driver
    if n < 2:
        raise ValueError(f"need at least two held-out rows to split dev/test, found {n}")
    n_dev = int(n * dev_ratio + 1)
    split = ranked.select(*repos.columns,
                          F.when(F.col("_pos") <= n_dev, F.lit("dev")).otherwise(F.lit("test")).alias("split"))
    return t.where(F.col("split") == "train").select(*repos.columns, "split").unionByName(split)


def split_counts(splits: DataFrame) -> DataFrame:
    """Rows per split."""
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def split_disjoint(splits: DataFrame, key: str = "full_name") -> DataFrame:
    """K4: per split, its row count and how many of its keys also occur in
    another split (0 when the splits are disjoint)."""
    a = splits.select(key, F.col("split").alias("s"))
    b = splits.select(key, F.col("split").alias("o"))
    shared = a.join(b, key).where(F.col("s") != F.col("o")).select(key, "s").distinct()
    n = a.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    m = shared.groupBy("s").agg(F.count(F.lit(1)).alias("n_shared"))
    return (n.join(m, "s", "left")
            .select(F.col("s").alias("split"), "n", F.coalesce("n_shared", F.lit(0)).alias("n_shared")))


def shuffle_corpus(df: DataFrame, key: str = "full_name", seed: int = P.SHUFFLE_SEED) -> DataFrame:
    """D3: seeded global order; ``pos`` is the row's place in the shuffled corpus."""
    ranked = global_rank(df.withColumn("_k", seeded_key(seed, key)), "_k", "pos")
    return ranked.drop("_k")


def head_sample(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """L4: the first ``n`` rows in dataset order (max_*_samples): a
    distributed top-k (TakeOrderedAndProject), no full sort."""
    return df.orderBy(order_col).limit(n)


def resume_antijoin(new: DataFrame, emitted: DataFrame, key: str = "full_name") -> DataFrame:
    """Only inputs not emitted yet (exactly once per key)."""
    return new.join(emitted.select(key).distinct(), key, "left_anti")


def ab_blind(predictions: DataFrame, row_key: str, system_col: str, seed: int = P.SHUFFLE_SEED) -> DataFrame:
    """Per row a seeded order of the systems (position shown to the rater)."""
    from pyspark.sql import Window
    k = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_key).cast("string"), F.col(system_col)))
    w = Window.partitionBy(row_key).orderBy(k)
    return predictions.withColumn("position", (F.row_number().over(w) - 1).cast("int"))
