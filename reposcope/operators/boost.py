"""Boosted pairwise ranker (M5, M6): histogram trees over all pairs of a repository.

The loss of a pair whose targets differ is exp(-(s_i - s_j)), i being the file
with the larger target; pairs of a repository weigh together as much as it has
files. The exponential splits into a factor per file, so the gradient of a file
needs only two sums over its repository: exp(s) of the files below its target
and exp(-s) of those above. Both are running sums over the distinct targets of
the repository (as many as there are vote patterns), never over pairs, and a
repository of any size adds up in partial aggregates first.

Values are cut into at most ``BINS`` bins per feature (NULL is a bin of its
own, left of all others); files alike in repository, target and bins are one
weighted row. A tree needs one pass for the gradients, summed per pattern of
bins, and one aggregate over (node, feature, bin) per level; only those sums
reach the driver, at most 2^level x features x bins rows. Scores are columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reposcope.session import cut_lineage, merged, stored

TREES, DEPTH, BINS, RATE, RIDGE = 20, 3, 32, 0.3, 1.0
#: gains are compared to this many digits, so that the order of summation does not choose a split
DIGITS = 9


@dataclass
class Node:
    value: float
    feature: int = -1
    bin: int = 0
    left: int = -1
    right: int = -1


@dataclass
class BoostedRanker:
    """Trees as lists of nodes; ``cuts`` holds the upper ends of the bins of each feature but the last."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[list[Node]] = field(default_factory=list)

    def threshold(self, node: Node) -> float:
        """A value above it goes right; NULL always goes left."""
        return float("-inf") if node.bin == 0 else self.cuts[node.feature][node.bin - 1]

    def _raw(self, node: Node) -> Column:
        x = F.col(self.features[node.feature]).cast("double")
        right = x.isNotNull() if node.bin == 0 else x > F.lit(self.threshold(node))
        return F.coalesce(right, F.lit(False))

    def score(self) -> Column:
        """The score of a row of the feature table."""
        return _total([_tree(t, self._raw, lambda i, n: F.lit(n.value)) for t in self.trees])


def _total(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def _tree(nodes: list[Node], right, leaf, at: int = 0) -> Column:
    n = nodes[at]
    if n.feature < 0:
        return leaf(at, n)
    return F.when(right(n), _tree(nodes, right, leaf, n.right)).otherwise(_tree(nodes, right, leaf, n.left))


def _by_bin(n: Node) -> Column:
    return F.element_at("bins", n.feature + 1) > F.lit(n.bin)


def bin_cuts(df: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Up to ``bins`` - 1 distinct quantiles of each feature, without its maximum."""
    shares = [i / bins for i in range(1, bins)]
    x = [F.col(c).cast("double") for c in features]
    row = df.agg(*[F.percentile_approx(c, shares, 100_000).alias(f"q{i}") for i, c in enumerate(x)],
                 *[F.max(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    return [sorted({v for v in (row[f"q{i}"] or []) if v < row[f"m{i}"]}) for i in range(len(features))]


def _cells(df: DataFrame, features: list[str], cuts: list[list[float]], target: str, group: str) -> DataFrame:
    """(group, y, bins, n): files alike in all three are one row."""
    def bin_of(name: str, ends: list[float]) -> Column:
        x = F.col(name).cast("double")
        above = _total([F.when(x > F.lit(v), 1).otherwise(0) for v in ends]) if ends else F.lit(0)
        return F.when(x.isNull(), 0).otherwise(1 + above).cast("int")

    return (df.where(F.col(target).isNotNull())
            .select(F.col(group).alias("g"), F.col(target).cast("double").alias("y"),
                    F.array(*[bin_of(f, c) for f, c in zip(features, cuts)]).alias("bins"))
            .groupBy("g", "y", "bins").agg(F.count(F.lit(1)).alias("n")))


def _weighted(cells: DataFrame) -> DataFrame:
    """The cells of the repositories that have pairs, with what a pair weighs there."""
    w = Window.partitionBy("g").orderBy("y")
    sizes = cells.groupBy("g", "y").agg(F.sum("n").cast("double").alias("m"))
    below = F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pairs = sizes.withColumn("p", F.col("m") * below)
    total = pairs.groupBy("g").agg(F.try_divide(F.sum("m"), F.sum("p")).alias("weight")).where("weight IS NOT NULL")
    return cells.join(merged(total), "g")


def _gradients(cells: DataFrame, score: Column) -> DataFrame:
    """(bins, grad, hess): first and second derivatives of the loss over all pairs, per pattern of bins."""
    scored = cells.withColumn("s", score)
    w = Window.partitionBy("g").orderBy("y")
    sums = scored.groupBy("g", "y").agg(F.sum(F.col("n") * F.exp("s")).alias("up"), F.sum(F.col("n") * F.exp(-F.col("s"))).alias("down"))
    sides = (sums.withColumn("below", F.sum("up").over(w.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("above", F.sum("down").over(w.rowsBetween(1, Window.unboundedFollowing))).na.fill(0.0, ["below", "above"]))
    pulled = F.exp(-F.col("s")) * F.col("below")
    pushed = F.exp("s") * F.col("above")
    rows = scored.join(merged(sides.select("g", "y", "below", "above")), ["g", "y"])
    factor = F.col("n") * F.col("weight")
    return rows.groupBy("bins").agg(F.sum(factor * (pushed - pulled)).alias("grad"), F.sum(factor * (pushed + pulled)).alias("hess"))


def _grow(patterns: DataFrame, n_features: int, n_bins: list[int], depth: int, rate: float, ridge: float) -> list[Node]:
    """One tree, level by level, from the sums per (node, feature, bin), which also give the values of both sides of a split."""
    nodes = [Node(0.0)]
    open_ = [0]
    for level in range(depth):
        at = _tree(nodes, _by_bin, lambda i, n: F.lit(i))
        cells = (patterns.select(at.alias("node"), "grad", "hess", "bins").where(F.col("node").isin(open_))
                 .select("node", "grad", "hess", F.posexplode("bins").alias("f", "b")))
        sums = cells.groupBy("node", "f", "b").agg(F.sum("grad").alias("grad"), F.sum("hess").alias("hess")).collect()
        hist = {i: np.zeros((2, n_features, max(n_bins) + 1)) for i in open_}
        for r in sums:
            hist[r["node"]][:, r["f"], r["b"]] = r["grad"], r["hess"]
        following = []
        for i in open_:
            total = hist[i][:, 0].sum(axis=1)
            if level == 0:
                nodes[i].value = _value(*total, rate, ridge)
            split = best_split(hist[i], n_bins, ridge)
            if split is None:
                continue
            f, b = nodes[i].feature, nodes[i].bin = split
            left = hist[i][:, f, : b + 1].sum(axis=1)
            nodes[i].left, nodes[i].right = len(nodes), len(nodes) + 1
            nodes += [Node(_value(*left, rate, ridge)), Node(_value(*(total - left), rate, ridge))]
            following += [nodes[i].left, nodes[i].right]
        open_ = following
        if not open_:
            break
    return nodes


def _value(grad: float, hess: float, rate: float, ridge: float) -> float:
    return float(-rate * grad / (hess + ridge))


def best_split(hist: np.ndarray, n_bins: list[int], ridge: float) -> tuple[int, int] | None:
    """(feature, last bin to the left) with the largest gain; ties go to the first feature, then bin."""
    g, h = hist.cumsum(axis=2)
    tg, th = g[0, -1], h[0, -1]
    gain = g**2 / (h + ridge) + (tg - g) ** 2 / (th - h + ridge) - tg**2 / (th + ridge)
    for f, n in enumerate(n_bins):
        gain[f, n:] = -1.0
    gain[(h <= 1e-9 * th) | (th - h <= 1e-9 * th)] = -1.0
    top = gain.max()
    if not top > 1e-9 * (1 + th):
        return None
    near = gain >= top * (1 - 10.0**-DIGITS)
    f, b = np.argwhere(near)[0]
    return int(f), int(b)


def fit_boosted_ranker(df: DataFrame, features: list[str], target: str, group: str = "repo_id", trees: int = TREES, depth: int = DEPTH,
                       bins: int = BINS, rate: float = RATE, ridge: float = RIDGE) -> BoostedRanker:
    """M5: see the module. Rows without a target are not learned from; repositories without two
    different targets have no pair; with no pair at all every score is 0."""
    cuts = bin_cuts(df, features, bins)
    model = BoostedRanker(list(features), cuts)
    cells = stored(_weighted(stored(_cells(df, features, cuts, target, group), "rank_cells")), "rank_pairs")
    if cells.isEmpty():
        return model
    n_bins = [len(c) + 1 for c in cuts]
    for _ in range(trees):
        score = _total([_tree(t, _by_bin, lambda i, n: F.lit(n.value)) for t in model.trees])
        patterns = cut_lineage(_gradients(cells, score))
        model.trees.append(_grow(patterns, len(features), n_bins, depth, rate, ridge))
    return model


def nodes(model: BoostedRanker, spark: SparkSession) -> DataFrame:
    """One row per node: (tree, node, feature, threshold, left, right, value); leaves have no feature."""
    rows = [(t, i, model.features[n.feature] if n.feature >= 0 else None, model.threshold(n) if n.feature >= 0 else None,
             n.bin, n.left, n.right, n.value) for t, tree in enumerate(model.trees) for i, n in enumerate(tree)]
    return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, bin int, left int, right int, value double")


def save(model: BoostedRanker, spark: SparkSession, path: str) -> None:
    """Nodes, features and cuts as two Parquet tables."""
    nodes(model, spark).write.mode("overwrite").parquet(f"{path.rstrip('/')}/nodes")
    rows = [(i, f, c) for i, (f, c) in enumerate(zip(model.features, model.cuts))]
    spark.createDataFrame(rows, "i int, feature string, cuts array<double>").write.mode("overwrite").parquet(f"{path.rstrip('/')}/features")


def load(spark: SparkSession, path: str) -> BoostedRanker:
    """A ranker saved by ``save``."""
    feats = spark.read.parquet(f"{path.rstrip('/')}/features").orderBy("i").collect()
    model = BoostedRanker([r["feature"] for r in feats], [list(r["cuts"]) for r in feats])
    number = {f: i for i, f in enumerate(model.features)}
    for r in spark.read.parquet(f"{path.rstrip('/')}/nodes").orderBy("tree", "node").collect():
        if r["node"] == 0:
            model.trees.append([])
        model.trees[-1].append(Node(r["value"], number.get(r["feature"], -1), r["bin"], r["left"], r["right"]))
    return model


def score(model: BoostedRanker, df: DataFrame) -> DataFrame:
    """M6: the rows with their ``score``."""
    return df.withColumn("score", model.score())
