"""Weak supervision over the vote matrix.

The vote matrix is never collected: summaries are aggregates, and the label
model runs EM in one task over the histogram of *distinct vote patterns*
(sufficient statistics, at most 2^12 * 3^2 rows whatever the corpus size, in
practice a few hundred).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions import patterns as P


def _counts(lfs: list[str]) -> tuple[Column, Column, Column]:
    nn = sum((F.col(c) != -1).cast("int") for c in lfs)
    npos = sum((F.col(c) == 1).cast("int") for c in lfs)
    nneg = sum((F.col(c) == 0).cast("int") for c in lfs)
    return nn, npos, nneg


def lf_summary(votes: DataFrame, lfs: list[str] = P.VOTE_NAMES) -> DataFrame:
    """Polarity, coverage, overlaps, conflicts per labeling function."""
    nn, npos, nneg = _counts(lfs)
    v = votes.select(*lfs, nn.alias("_nn"), npos.alias("_np"), nneg.alias("_ng"))
    long = v.unpivot(["_nn", "_np", "_ng"], lfs, "lf", "vote")
    labeled = F.col("vote") != -1
    conflict = labeled & (((F.col("vote") == 1) & (F.col("_ng") > 0)) | ((F.col("vote") == 0) & (F.col("_np") > 0)))
    return long.groupBy("lf").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(labeled, F.col("vote").cast("string")))), ",").alias("polarity"),
        F.round(F.avg(labeled.cast("double")), 6).alias("coverage"),
        F.round(F.avg((labeled & (F.col("_nn") >= 2)).cast("double")), 6).alias("overlaps"),
        F.round(F.avg(conflict.cast("double")), 6).alias("conflicts"))


def nonabstain_ratio(votes: DataFrame, lfs: list[str] = P.VOTE_NAMES) -> DataFrame:
    """Share of rows each labeling function votes on (per function; the
    source averages over the wrong axis)."""
    long = votes.select(*lfs).unpivot([], lfs, "lf", "vote")
    return long.groupBy("lf").agg(F.round(F.avg((F.col("vote") != -1).cast("double")), 6).alias("nonabstain_ratio"))


def majority_vote(votes: DataFrame, lfs: list[str] = P.VOTE_NAMES) -> DataFrame:
    """1 / 0 by majority of non-abstaining votes, -1 on tie or no vote."""
    _, npos, nneg = _counts(lfs)
    lab = F.when(npos > nneg, 1).when(nneg > npos, 0).otherwise(-1).cast("int")
    return votes.select("repo_id", "path_str", npos.alias("n_pos"), nneg.alias("n_neg"), lab.alias("label"))


def posterior(acc: dict[str, float], prior: float, lfs: list[str] = P.VOTE_NAMES) -> Column:
    """M4: P(y=1 | votes) for conditionally independent LFs with accuracy
    ``acc[lf]`` (symmetric), abstains ignored; all-abstain -> prior."""
    logit = F.lit(math.log(prior / (1 - prior)))
    for c in lfs:
        a = min(max(acc[c], 1e-6), 1 - 1e-6)
        w = math.log(a / (1 - a))
        logit = logit + F.when(F.col(c) == 1, F.lit(w)).when(F.col(c) == 0, F.lit(-w)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-logit))


DEFAULT_ACC = 0.7


def label_proba(votes: DataFrame, acc: dict[str, float] | None = None, prior: float = 0.5,
                lfs: list[str] = P.VOTE_NAMES) -> DataFrame:
    acc = acc or {c: DEFAULT_ACC for c in lfs}
    return votes.select("repo_id", "path_str", F.round(posterior(acc, prior, lfs), 6).alias("proba"))


def _em(lfs: list[str], n_iter: int, tol: float, init_acc: float, prior: float, learn_prior: bool):
    """EM over the pattern histogram, inside one task (it has at most 2^12 * 3^2 rows)."""
    def run(batches):
        import numpy as np
        import pandas as pd

        pdf = pd.concat(list(batches) or [pd.DataFrame(columns=[*lfs, "n"])])
        pdf = pdf.sort_values(lfs)
        v, n = pdf[lfs].to_numpy(dtype=np.int8), pdf["n"].to_numpy(dtype=np.float64)
        sign, voted = (v == 1).astype(float) - (v == 0), v != -1
        acc, p = np.full(len(lfs), init_acc), prior
        for _ in range(n_iter):
            a = np.clip(acc, 1e-6, 1 - 1e-6)
            q = 1.0 / (1.0 + np.exp(-(math.log(p / (1 - p)) + sign @ np.log(a / (1 - a)))))
            agree = n @ np.where(v == 1, q[:, None], np.where(v == 0, 1 - q[:, None], 0.0))
            total = n @ voted
            # Beta(1,1)-smoothed accuracy; a function that never votes keeps its value
            new = np.where(total > 0, (agree + 1.0) / (total + 2.0), acc)
            new_p = float(np.clip(n @ q / n.sum(), 1e-3, 1 - 1e-3)) if learn_prior and n.sum() > 0 else p
            delta = float(np.abs(new - acc).max()) + abs(new_p - p)
            acc, p = new, new_p
            if delta < tol:
                break
        yield pd.DataFrame({"lf": [*lfs, "_prior"], "value": [*acc, p]})
    return run


def fit_label_model(votes: DataFrame, lfs: list[str] = P.VOTE_NAMES, n_iter: int = 500,
                    tol: float = 1e-7, init_acc: float = 0.7, prior: float = 0.5,
                    learn_prior: bool = False) -> tuple[dict[str, float], float, DataFrame]:
    """M3: unsupervised LF accuracies by EM (one-coin Dawid-Skene) over the
    distinct vote patterns: sufficient statistics whose number the functions
    bound, whatever the data size. The iterations run in one task on them; only
    the fitted accuracies reach the driver. Returns (acc, prior, patterns) with
    the posterior per pattern."""
    from reposcope.session import cut_lineage

    patterns = cut_lineage(votes.groupBy(*lfs).agg(F.count(F.lit(1)).alias("n")))
    fitted = patterns.repartition(1).mapInPandas(_em(lfs, n_iter, tol, init_acc, prior, learn_prior), "lf string, value double")
    acc = {r["lf"]: r["value"] for r in fitted.collect()}
    prior = acc.pop("_prior")
    return acc, prior, patterns.select(*lfs, "n", posterior(acc, prior, lfs).alias("proba"))
