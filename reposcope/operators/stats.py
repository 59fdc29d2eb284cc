"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.functions import text as T
from reposcope.operators.segments import medians

STAT_METRICS = ["n_reference_tokens", "n_repo_tokens", "n_excluded", "n_files"]


def repo_stats(tree: DataFrame, readmes: DataFrame, repos: DataFrame,
               tokenizer: T.Tokenizer = T.DEFAULT_TOKENIZER) -> DataFrame:
    """A2: per repository reference tokens, repo tokens (sum over Python
    files), #Python files, #excluded (excluded or not Python) and the
    per-file token counts in path order. One aggregate keyed by repo_id; the
    only list is the result's own, one number per file of the repository."""
    is_py = (T.python_base_name("name") != "") & ~F.col("excluded")
    per_file = tree.select("repo_id", "path_str", is_py.alias("_py"),
                           F.when(is_py, T.token_count("content", tokenizer)).alias("_n"))
    per_repo = per_file.groupBy("repo_id").agg(
        F.count_if(~F.col("_py")).alias("n_excluded"),
        F.count_if(F.col("_py")).alias("n_files"),
        F.sum(F.coalesce("_n", F.lit(0))).alias("n_repo_tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_py"), F.struct("path_str", "_n")))),
                                 lambda x: x["_n"].cast("string")), ",").alias("n_file_tokens"))
    ref = readmes.select("repo_id", T.token_count("content", tokenizer).alias("n_reference_tokens"))
    return (repos.select("repo_id", "full_name")
            .join(per_repo, "repo_id", "left")
            .join(ref, "repo_id", "left")
            .select("full_name",
                    F.coalesce("n_reference_tokens", F.lit(0)).cast("bigint").alias("n_reference_tokens"),
                    F.coalesce("n_repo_tokens", F.lit(0)).cast("bigint").alias("n_repo_tokens"),
                    F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files"),
                    F.coalesce("n_excluded", F.lit(0)).cast("bigint").alias("n_excluded"),
                    F.coalesce("n_file_tokens", F.lit("")).alias("n_file_tokens")))


def corpus_summary(stats: DataFrame, metrics: list[str] = STAT_METRICS) -> DataFrame:
    """A1: mean, population std, interpolated median, max, min per metric. The
    medians are exact, by passes that narrow a bracket (``segments.medians``)."""
    long = stats.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [], metrics, "metric", "v")
    middle = medians(long)
    pairs = [x for m in metrics if m in middle for x in (F.lit(m), F.lit(middle[m]))]
    of = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return long.groupBy("metric").agg(
        F.round(F.avg("v"), 6).alias("mean"),
        F.round(F.stddev_pop("v"), 6).alias("std"),
        F.round(F.max("v"), 6).alias("max"),
        F.round(F.min("v"), 6).alias("min")).select(
        "metric", "mean", "std", F.round(F.try_element_at(of, F.col("metric")), 6).alias("median"), "max", "min")


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """A5: rows per group."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys occurring more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
