"""Boosted pairwise ranker against a boost over all pairs, one by one."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from reposcope.operators import boost as B
from reposcope.operators import rank as RK


def pairwise_boost(rows, cuts, trees, depth, rate, ridge):
    """rows: (group, x values or None, y). Every pair of a group is visited; every split is tried on the rows."""
    binned = [[0 if v is None else 1 + sum(c < v for c in cs) for v, cs in zip(x, cuts)] for _, x, _ in rows]
    pairs = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[0] == b[0] and a[2] is not None and b[2] is not None and a[2] > b[2]]
    size, count = {}, {}
    for g, _, y in rows:
        size[g] = size.get(g, 0) + (y is not None)
    for i, _ in pairs:
        count[rows[i][0]] = count.get(rows[i][0], 0) + 1
    score = [0.0] * len(rows)
    learned = [i for i, r in enumerate(rows) if r[2] is not None and r[0] in count]
    for _ in range(trees):
        grad, hess = [0.0] * len(rows), [0.0] * len(rows)
        for i, j in pairs:
            w = size[rows[i][0]] / count[rows[i][0]] * math.exp(-(score[i] - score[j]))
            grad[i] -= w
            grad[j] += w
            hess[i] += w
            hess[j] += w
        leaf = {i: () for i in range(len(rows))}

        def grow(members, path, level):
            g, h = sum(grad[i] for i in members if i in learned_set), sum(hess[i] for i in members if i in learned_set)
            best = None
            if level < depth:
                for f, cs in enumerate(cuts):
                    for b in range(len(cs) + 1):
                        left = [i for i in members if i in learned_set and binned[i][f] <= b]
                        lg, lh = sum(grad[i] for i in left), sum(hess[i] for i in left)
                        if lh <= 1e-9 * h or h - lh <= 1e-9 * h:
                            continue
                        gain = lg**2 / (lh + ridge) + (g - lg) ** 2 / (h - lh + ridge) - g**2 / (h + ridge)
                        if best is None or gain > best[0] * (1 + 1e-9):
                            best = gain, f, b
            if best is None or best[0] <= 1e-9 * (1 + h):
                for i in members:
                    leaf[i] = -rate * g / (h + ridge)
                return
            _, f, b = best
            grow([i for i in members if binned[i][f] <= b], path + (0,), level + 1)
            grow([i for i in members if binned[i][f] > b], path + (1,), level + 1)

        learned_set = set(learned)
        grow(list(range(len(rows))), (), 0)
        for i in range(len(rows)):
            score[i] += leaf[i]
    return score


def table(spark, rows):
    flat = [(g, i, *x, y) for i, (g, x, y) in enumerate(rows)]
    names = ", ".join(f"x{k} double" for k in range(len(rows[0][1])))
    return spark.createDataFrame(flat, f"repo_id long, ord int, {names}, y double")


def test_equals_a_boost_over_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(6):
        for _ in range(int(rng.integers(1, 14))):
            x = [float(rng.integers(0, 2)), float(rng.normal()) if rng.random() < 0.85 else None, float(rng.integers(0, 5))]
            y = round(x[0] * 0.5 + (x[1] or 0.0) * 0.2 - abs(x[2] - 2) * 0.3 + float(rng.integers(0, 3)) * 0.1, 1)
            rows.append((g, x, y if rng.random() < 0.95 else None))
    rows += [(9, [1.0, 0.0, 3.0], 0.5), (9, [0.0, 0.0, 1.0], 0.5), (10, [0.0, None, 0.0], 1.0)]
    df = table(spark, rows)
    model = B.fit_boosted_ranker(df, ["x0", "x1", "x2"], "y", trees=4, depth=2, bins=8)
    assert len(model.trees) == 4 and any(n.feature == 1 for t in model.trees for n in t)
    got = [r.score for r in B.score(model, df).orderBy("ord").collect()]
    want = pairwise_boost(rows, model.cuts, 4, 2, B.RATE, B.RIDGE)
    assert np.allclose(got, want, atol=1e-9)


def pair_accuracy(scored):
    pdf = scored.select("repo_id", "y", "score").toPandas()
    right = total = 0
    for _, g in pdf.groupby("repo_id"):
        dy, ds = np.subtract.outer(g.y.values, g.y.values), np.subtract.outer(g.score.values, g.score.values)
        right += ((dy > 0) & (ds > 0)).sum()
        total += (dy > 0).sum()
    return right / total


def test_beats_the_linear_fit_where_the_order_is_not_linear(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(60):
        for _ in range(12):
            x = [float(rng.normal()), float(rng.integers(0, 2)), float(rng.integers(0, 2))]
            rows.append((g, x, -abs(x[0]) + 1.5 * (x[1] * x[2])))
    train, test = table(spark, rows[:480]), table(spark, rows[480:])
    boosted = B.fit_boosted_ranker(train, ["x0", "x1", "x2"], "y", trees=12, depth=3)
    linear = RK.fit_pairwise_ranker(train, ["x0", "x1", "x2"], "y")
    a, b = pair_accuracy(B.score(boosted, test)), pair_accuracy(RK.score(linear, test, ["x0", "x1", "x2"]))
    assert a > 0.9 and b < 0.8


def test_save_and_load(spark):
    rng = np.random.default_rng(1)
    rows = [(g, [float(rng.normal()), None if j == 2 else float(j)], float(rng.normal())) for g in range(4) for j in range(6)]
    df = table(spark, rows)
    model = B.fit_boosted_ranker(df, ["x0", "x1"], "y", trees=3, depth=2)
    folder = tempfile.mkdtemp(prefix="rs-boost-")
    B.save(model, spark, folder)
    back = B.load(spark, folder)
    assert back == model
    assert B.nodes(model, spark).where("feature IS NOT NULL").count() > 0


@pytest.mark.parametrize("rows", [
    [(1, [1.0], None), (2, [2.0], None)],
    [(1, [1.0], 0.5), (1, [2.0], 0.5), (2, [None], 0.1)],
    [(1, [None], 0.5), (1, [None], 0.7)],
])
def test_nothing_to_learn_from(spark, rows):
    df = table(spark, rows)
    model = B.fit_boosted_ranker(df, ["x0"], "y", trees=2)
    assert {r.score for r in B.score(model, df).collect()} == {0.0}
    assert B.fit_boosted_ranker(df.limit(0), ["x0"], "y", trees=2).trees == []


def test_no_pairs_and_no_python_in_the_plan(spark):
    rows = [(g, [float(j)], float(j % 3)) for g in range(3) for j in range(5)]
    cells = B._cells(table(spark, rows), ["x0"], [[1.0, 2.0]], "y", "repo_id")
    plan = B._gradients(B._weighted(cells), F.lit(0.0))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
