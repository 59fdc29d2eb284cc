"""Running sums over partitions, exact medians, path mentions: against plain Python."""

import contextlib
import io
import random
import statistics

import pytest
from pyspark.sql import functions as F

from reposcope.operators import extract as X
from reposcope.operators import segments as S


def test_running_sum_of_a_key_that_spans_partitions(spark):
    rnd = random.Random(4)
    rows = [(0 if i % 3 else rnd.randrange(1, 40), f"{rnd.random():.12f}", rnd.randrange(0, 9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "repo_id long, hkey string, n long").repartition(7)
    got = S.running_before(df, "repo_id", "hkey", "n").collect()
    total, want = {}, {}
    for k, h, n in sorted(rows):
        want[k, h] = total.get(k, 0)
        total[k] = want[k, h] + n
    assert {(r.repo_id, r.hkey): r._before for r in got} == want and len(got) == len(rows)


def test_no_task_holds_a_whole_key(spark):
    df = spark.range(1000).select(F.lit(1).alias("repo_id"), F.col("id").alias("ord"), F.lit(2).alias("n"))
    out = S.running_before(df, "repo_id", "ord", "n")
    assert out.agg(F.max("_before")).first()[0] == 1998
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain("formatted")
    windows = [x for x in buf.getvalue().splitlines() if "windowspecdefinition" in x and "ord" in x]
    assert windows and all("_pid" in x for x in windows)


@pytest.mark.parametrize("fetch", [3, 4096])
def test_medians_are_exact(spark, monkeypatch, fetch):
    monkeypatch.setattr(S, "FETCH", fetch)
    rnd = random.Random(6)
    groups = {
        "odd": [rnd.gauss(0, 1e6) for _ in range(501)], "even": [float(rnd.randrange(50)) for _ in range(400)],
        "ties": [5.0] * 300 + [7.0] * 300, "one": [3.25], "two": [1.0, 2.0], "skew": [10.0**rnd.randrange(-8, 9) for _ in range(333)],
        "wide": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0, 3.0, 1e300], "negative": [-float(x) for x in range(100)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("odd", None), ("none", None)]
    df = spark.createDataFrame(rows, "metric string, v double").repartition(5)
    got = S.medians(df)
    assert got == {g: statistics.median(v) for g, v in groups.items()}
    assert S.medians(df.limit(0)) == {}


def test_path_mentions_match_substring_search(spark):
    paths = ["a.py", "src/a.py", "src/b.pyx", "src/b.py", "x.pydir/mod.pyc", "ö/ü.py", "ö/ü😀.py", "deep/er/still/run.py", "s p/a c.py"]
    texts = ["see src/a.py.", "src/b.pyx only", "run x.pydir/mod.pyc now", "ö/ü.py and 😀 ö/ü😀.py", "", None, ".py", "a.pya.py", "deep/er/still/run.pyc", "S p/a c.py s p/a c.py",
             "src/b.py" * 50, "deep/er/still/run.p y"]
    files = spark.createDataFrame([(i, p) for i in range(len(texts)) for p in paths], "repo_id long, path_str string")
    readmes = spark.createDataFrame(list(enumerate(texts)) + [(99, "src/a.py")], "repo_id long, content string")
    got = {(r.repo_id, r.path_str) for r in X.path_mentions(files, readmes).collect()}
    assert got == {(i, p) for i, t in enumerate(texts) for p in paths if t and p in t}
