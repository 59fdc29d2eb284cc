"""Label model from agreement moments: planted rates, plain counts, and its posterior."""

import math
import random
from itertools import combinations

import pytest

from reposcope.operators import moments as MO


def planted(n, balance, rates, seed):
    """rates: function -> (vote 1 given 1, vote 0 given 1, vote 1 given 0, vote 0 given 0)."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.random() < balance
        votes = []
        for a, b, c, d in rates.values():
            one, zero = (a, b) if y else (c, d)
            u = rnd.random()
            votes.append(1 if u < one else 0 if u < one + zero else -1)
        rows.append((i, int(y), *votes))
    return rows


RATES = {
    "pos_a": (0.7, 0.0, 0.1, 0.0), "pos_b": (0.5, 0.0, 0.15, 0.0), "neg_a": (0.0, 0.2, 0.0, 0.7),
    "neg_b": (0.0, 0.05, 0.0, 0.35), "both_a": (0.6, 0.1, 0.2, 0.5), "both_b": (0.45, 0.2, 0.1, 0.6), "weak": (0.32, 0.3, 0.3, 0.32),
}


def frame(spark, rows, lfs):
    return spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"{c} int" for c in lfs))


@pytest.mark.parametrize("balance", [0.5, 0.25])
def test_recovers_planted_rates_and_balance(spark, balance):
    lfs = list(RATES)
    df = frame(spark, planted(20_000, balance, RATES, 3), lfs)
    model = MO.fit(df, lfs)
    assert abs(model.balance - balance) < 0.06
    for lf, (a, b, c, d) in RATES.items():
        for vote, one, zero in ((1, a, c), (0, b, d)):
            if one or zero:
                got = model.rates[lf, vote]
                assert abs(got[0] - one) < 0.07 and abs(got[1] - zero) < 0.07, (lf, vote, got)
            else:
                assert (lf, vote) not in model.rates
    scored = df.select("y", model.posterior().alias("p")).toPandas()
    assert ((scored.p > 0.5) == (scored.y == 1)).mean() > 0.85
    high = scored[scored.p > 0.9]
    assert len(high) > 500 and (high.y == 1).mean() > 0.85  # weights are calibrated, not only ordered


def test_moments_are_plain_counts(spark):
    lfs = ["a", "b", "c", "d"]
    rnd = random.Random(5)
    rows = [(i, 0, *(rnd.choice([-1, -1, 0, 1]) for _ in lfs)) for i in range(300)]
    want = {(): len(rows)}
    for r in rows:
        ids = [2 * k + v for k, v in enumerate(r[2:]) if v >= 0]
        for size in (1, 2, 3):
            for t in combinations(ids, size):
                want[t] = want.get(t, 0) + 1
    got = {tuple(v for v in r[:3] if v is not None): r.n for r in MO.vote_moments(MO.vote_patterns(frame(spark, rows, lfs), lfs), lfs).collect()}
    assert got == want
    two = MO.vote_moments(MO.vote_patterns(frame(spark, rows, lfs), lfs), lfs, most=2)
    assert two.where("k IS NOT NULL").isEmpty() and two.count() == sum(len(t) < 3 for t in want)


def test_posterior_of_a_worked_model(spark):
    model = MO.LabelModel(0.25, {("a", 1): (0.6, 0.2), ("b", 0): (0.1, 0.4)})
    df = frame(spark, [(1, 0, 1, 0), (2, 0, -1, -1), (3, 0, 1, -1), (4, 0, 0, -1)], ["a", "b"])
    got = {r.id: r.p for r in df.select("id", model.posterior().alias("p")).collect()}
    odds = lambda *w: 1 / (1 + math.exp(-(math.log(1 / 3) + sum(w))))
    assert got[1] == pytest.approx(odds(math.log(3), math.log(0.25)))
    assert got[2] == pytest.approx(0.25) and got[3] == pytest.approx(odds(math.log(3)))
    assert got[4] == pytest.approx(0.25)  # a vote never seen in fitting says nothing


def test_no_votes_or_no_agreement(spark):
    lfs = ["a", "b", "c"]
    empty = frame(spark, [(1, 0, -1, -1, -1)], lfs)
    assert MO.fit(empty, lfs) == MO.LabelModel(0.5, {}) and MO.fit(empty.limit(0), lfs).rates == {}
    single = MO.fit(frame(spark, [(i, 0, i % 2, -1, -1) for i in range(10)], lfs), lfs)
    assert single.balance == 0.5 and all(abs(single.weight("a", v)) < 1e-12 for v in (0, 1))
    assert MO.weights(single, spark).count() == 2
