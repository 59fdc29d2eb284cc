"""Label model from agreement moments (M3) and its posterior (M4).

An indicator is a pair (labeling function, vote); abstaining is no indicator.
If the functions are independent given the class, the covariance of two
indicators of different functions is p(1-p) d_i d_j, where p is the share of
class 1 and d_i = P(i | 1) - P(i | 0): a matrix of rank one off its diagonal
blocks. With x_i = sqrt(p(1-p)) d_i, all triples (i, j, k) of different
functions have C_ij C_ik = x_i^2 C_jk, whose least-squares solution is
x_i^2 = sum C_ij C_ik C_jk / sum C_jk^2. The sign of x_i is that of the
covariance with the other indicators counted by their polarity (functions are
right more often than not). Third central moments are (1-2p)/sqrt(p(1-p))
x_i x_j x_k and give the class balance. There is no iteration and no start
value.

The moments are counts of indicators, pairs and triples over the histogram of
distinct vote patterns, which the functions bound whatever the corpus; they
are the only thing that reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.session import cut_lineage

#: bounds of the class balance, and of a class's rate as a share of the overall rate
BALANCE = (0.05, 0.95)
LEAST_RATE = 0.02


def vote_patterns(votes: DataFrame, lfs: list[str] = P.VOTE_NAMES) -> DataFrame:
    """Distinct rows of votes and how often each occurs."""
    return votes.groupBy(*lfs).agg(F.count(F.lit(1)).alias("n"))


def _indicators(lfs: list[str]) -> Column:
    """Numbers 2 * function + vote of the votes that are cast, ascending."""
    one = [F.when(F.col(c) >= 0, F.lit(2 * i) + F.col(c).cast("int")) for i, c in enumerate(lfs)]
    return F.filter(F.array(*one), lambda x: x.isNotNull())


def vote_moments(patterns: DataFrame, lfs: list[str] = P.VOTE_NAMES, most: int = 3) -> DataFrame:
    """(i, j, k, n): how many rows hold an indicator, a pair or a triple (up to ``most`` of them,
    i < j < k, the others NULL), and the number of rows under three NULLs."""
    none = F.lit(None).cast("int")
    ids = patterns.select(_indicators(lfs).alias("ids"), "n")
    sets = [F.array(F.struct(none.alias("i"), none.alias("j"), none.alias("k"))),
            F.transform("ids", lambda a: F.struct(a.alias("i"), none.alias("j"), none.alias("k")))]
    later = lambda at: F.slice("ids", at + 2, F.size("ids"))
    pairs = F.flatten(F.transform("ids", lambda a, x: F.transform(later(x), lambda b: F.struct(a.alias("i"), b.alias("j"), none.alias("k")))))
    triples = F.flatten(F.transform("ids", lambda a, x: F.flatten(F.transform(
        later(x), lambda b, y: F.transform(F.slice("ids", x + y + 3, F.size("ids")), lambda c: F.struct(a.alias("i"), b.alias("j"), c.alias("k")))))))
    sets += [pairs, triples][: most - 1]
    return ids.select(F.explode(F.concat(*sets)).alias("m"), "n").groupBy("m").agg(F.sum("n").alias("n")).select("m.*", "n")


@dataclass
class LabelModel:
    """Class balance and, per indicator (function, vote), its rate in both classes."""

    balance: float
    rates: dict[tuple[str, int], tuple[float, float]]

    def weight(self, lf: str, vote: int) -> float:
        """What the vote adds to the log odds of class 1."""
        one, zero = self.rates.get((lf, vote), (1.0, 1.0))
        return math.log(one / zero)

    def posterior(self) -> Column:
        """M4: P(class 1 | votes), functions that abstain left out."""
        logit = F.lit(math.log(self.balance / (1 - self.balance)))
        for lf in dict.fromkeys(lf for lf, _ in self.rates):
            logit = logit + F.when(F.col(lf) == 1, F.lit(self.weight(lf, 1))).when(F.col(lf) == 0, F.lit(self.weight(lf, 0))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-logit))


def solve(counts: dict[tuple, int], lfs: list[str]) -> LabelModel:
    """The model of some moments, by sorted tuples of indicator numbers; () is the number of rows."""
    total = counts.get((), 0)
    ids = sorted(t[0] for t in counts if len(t) == 1)
    if not total or not ids:
        return LabelModel(0.5, {})
    at = {i: k for k, i in enumerate(ids)}
    m = np.array([counts[i,] / total for i in ids])
    fn = np.array([i // 2 for i in ids])
    apart = fn[:, None] != fn[None, :]
    both = np.zeros((len(ids), len(ids)))
    for t, n in counts.items():
        if len(t) == 2:
            a, b = at[t[0]], at[t[1]]
            both[a, b] = both[b, a] = n / total
    cov = np.where(apart, both - np.outer(m, m), 0.0)
    # pairs j < k of functions other than i's: the diagonal blocks of cov are zero, so full sums count each pair twice
    above = np.einsum("ij,ik,jk->i", cov, cov, cov)
    below = np.array([(cov[np.ix_(fn != f, fn != f)] ** 2).sum() for f in fn])
    polarity = np.where(np.array(ids) % 2 == 1, 1.0, -1.0)
    size = np.sqrt(np.where((above > 0) & (below > 0), above / np.where(below > 0, below, 1.0), 0.0))
    x = np.where(cov @ polarity >= 0, 1.0, -1.0) * size
    top = bottom = 0.0
    for a, b, c in combinations(range(len(ids)), 3):
        if apart[a, b] and apart[a, c] and apart[b, c]:
            raw = counts.get((ids[a], ids[b], ids[c]), 0) / total
            third = raw - m[a] * both[b, c] - m[b] * both[a, c] - m[c] * both[a, b] + 2 * m[a] * m[b] * m[c]
            product = x[a] * x[b] * x[c]
            top += third * product
            bottom += product * product
    skew = top / bottom if bottom > 0 else 0.0
    p = min(max(0.5 - skew / (2 * math.sqrt(4 + skew * skew)), BALANCE[0]), BALANCE[1])
    d = x / math.sqrt(p * (1 - p))
    inside = lambda r, mean: min(max(r, LEAST_RATE * mean), 1.0)
    rates = {(lfs[i // 2], i % 2): (inside(m[k] + (1 - p) * d[k], m[k]), inside(m[k] - p * d[k], m[k])) for i, k in at.items()}
    return LabelModel(float(p), {k: (float(a), float(b)) for k, (a, b) in rates.items()})


def fit(votes: DataFrame, lfs: list[str] = P.VOTE_NAMES) -> LabelModel:
    """M3: see the module. Without votes, or without agreement beyond chance, all weights are 0."""
    rows = vote_moments(cut_lineage(vote_patterns(votes, lfs)), lfs).collect()
    return solve({tuple(v for v in (r["i"], r["j"], r["k"]) if v is not None): r["n"] for r in rows}, lfs)


def weights(model: LabelModel, spark: SparkSession) -> DataFrame:
    """One row per indicator: rates in both classes, weight, and the class balance."""
    rows = [(lf, v, one, zero, model.weight(lf, v), model.balance) for (lf, v), (one, zero) in sorted(model.rates.items())]
    return spark.createDataFrame(rows, "lf string, vote int, rate_1 double, rate_0 double, weight double, balance double").select(
        "lf", "vote", *[F.round(c, 6).alias(c) for c in ("rate_1", "rate_0", "weight", "balance")])
