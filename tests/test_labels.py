"""Label model, pairwise ranker identity, contexts."""

import random

import numpy as np
from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.operators import context as CX
from reposcope.operators import rank as RK
from reposcope.operators import weak as WK


def test_label_model_recovers_planted_accuracies(spark):
    rnd = random.Random(11)
    lfs = ["lf_a", "lf_b", "lf_c", "lf_d"]
    acc = {"lf_a": 0.9, "lf_b": 0.8, "lf_c": 0.7, "lf_d": 0.6}
    rows = []
    for i in range(6000):
        y = rnd.random() < 0.5
        vals = []
        for lf in lfs:
            if rnd.random() < 0.3:
                vals.append(-1)
            else:
                vals.append(int(y) if rnd.random() < acc[lf] else int(not y))
        rows.append((1, f"f{i}", *vals))
    df = spark.createDataFrame(rows, "repo_id long, path_str string, " + ", ".join(f"{c} int" for c in lfs))
    got, _, patterns = WK.fit_label_model(df, lfs=lfs, n_iter=200)
    for lf in lfs:
        assert abs(got[lf] - acc[lf]) < 0.05, (lf, got[lf])
    assert patterns.count() <= 3 ** len(lfs)


def test_pairwise_ranker_orders_within_repo(spark):
    rng = np.random.default_rng(0)
    rows = []
    for repo in range(40):
        shift = rng.normal() * 10          # per-repo offset must not matter
        for j in range(8):
            x = float(rng.normal())
            rows.append((repo, f"r{repo}/f{j}", j, x + shift, 2.0 * x + shift * 5))
    df = spark.createDataFrame(rows, "repo_id long, path_str string, ord int, feat double, target double")
    model = RK.fit_pairwise_ranker(df, ["feat"], "target")
    assert abs(model.coefficients[0] - 2.0) < 0.05
    scored = RK.score(model, df, ["feat"])
    best = {r.repo_id: r.path_str for r in RK.best_per_repo(scored).collect()}
    truth = {}
    for repo, path, _, feat, _ in rows:
        if repo not in truth or feat > truth[repo][1]:
            truth[repo] = (path, feat)
    assert best == {k: v[0] for k, v in truth.items()}


def test_context_budget(spark):
    rows = [(1, 0, ["a.py"], "a.py", "a.py", False, "one two three"),
            (1, 1, ["b.py"], "b.py", "b.py", False, "four five six"),
            (1, 2, ["c.bin"], "c.bin", "c.bin", True, None)]
    tree = spark.createDataFrame(rows, "repo_id long, ord int, path array<string>, path_str string, name string, excluded boolean, content string")
    repos = spark.createDataFrame([(1, "proj")], "repo_id long, name string")
    full = CX.ctx_all_data(tree, repos, 100, order="traversal").first().context
    assert full == "one two three" + P.FILE_SEPARATOR + "four five six"
    cut = CX.ctx_all_data(tree, repos, 5, order="traversal").first().context
    assert cut == "one two three" + P.FILE_SEPARATOR + "four"
    names = CX.ctx_file_names(tree, repos, 100, use_prompt=True, order="traversal").first().context
    assert names.startswith('Here is a a Python project called "proj" with following files:')
    assert "a.py b.py c.bin" in names


def test_ranker_save_load_and_report(spark):
    import json
    import os
    import tempfile
    from reposcope.operators import report as RP
    rows = [(r, f"{r}/f{j}", j, float(j), float(2 * j)) for r in range(3) for j in range(4)]
    df = spark.createDataFrame(rows, "repo_id long, path_str string, ord int, feat double, target double")
    model = RK.fit_pairwise_ranker(df, ["feat"], "target")
    base = tempfile.mkdtemp(prefix="rs-model-")
    RK.save_model(model, base + "/ranker")
    back = RK.load_model(base + "/ranker")
    a = [r.score for r in RK.score(model, df, ["feat"]).orderBy("path_str").collect()]
    b = [r.score for r in RK.score(back, df, ["feat"]).orderBy("path_str").collect()]
    assert a == b
    RP.write_report(RK.coefficients(back, spark), base + "/report")
    files = [f for f in os.listdir(base + "/report") if f.endswith(".json")]
    assert len(files) == 1
    with open(os.path.join(base, "report", files[0])) as fh:
        assert {json.loads(line)["feature"] for line in fh} == {"feat"}


def test_registered_group_adds_features_and_votes(spark):
    from pyspark.sql import functions as F

    from reposcope.operators import context as CX
    from reposcope.operators import features as FE
    from reposcope.plans import catalog as C

    sf = "/root/testdata/sf0.001"
    FE.register_feature_group("shout", lambda py: py.select("repo_id", "path_str", F.when(F.upper("name") == F.col("name"), 1).otherwise(-1).cast("int").alias("shouts")), ("shouts",))
    try:
        f = FE.assemble_features(C.pyfiles(spark, sf), C.repos(spark, sf), C.readmes(spark, sf), C.setups(spark, sf))
        v = FE.votes(f)
        assert FE.vote_names()[-1] == v.columns[-1] == "shouts"
        assert v.select("shouts").distinct().collect()[0].shouts == -1
        # groups read the narrow table; the text of the files is scanned for the registered group alone
        scans = [x for x in v._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan parquet" in x]
        assert scans and not any("signals-" in x and "content:" in x for x in scans)
        assert sum("/files" in x and "content:" in x for x in scans) == 0
    finally:
        FE.FEATURE_GROUPS.clear()
        FE.EXTRA_VOTES.clear()
    got = CX.create_context("file_names", C.tree(spark, sf), C.repos(spark, sf), CX.context_budget(800, 200))
    assert got.count() == C.repos(spark, sf).count()
    row = spark.range(1).select(CX.padded(F.array(F.lit(5), F.lit(6)), 4, 0).alias("a"), CX.padded(F.array(F.lit(5), F.lit(6)), 3, 0, -100).alias("b")).first()
    assert row.a == [5, 6, 0, 0] and row.b == [5, 6, -100]


def test_context_does_not_follow_the_readme(spark):
    """The scores of the files stay the same when README and setup.py say something else."""
    from pyspark.sql import functions as F

    from reposcope.operators import features as FE
    from reposcope.operators import weak as WK
    from reposcope.plans import catalog as C
    from reposcope.plans.q_context import FILE_VOTES

    sf = "/root/testdata/sf0.001"
    py, repos, readmes, setups = C.pyfiles(spark, sf), C.repos(spark, sf), C.readmes(spark, sf), C.setups(spark, sf)
    score = lambda r, s: sorted(map(tuple, FE.votes(FE.assemble_features(py, repos, r, s)).select(
        "repo_id", "path_str", F.round(WK.posterior({c: 0.7 for c in FILE_VOTES}, 0.5, FILE_VOTES), 6)).collect()))
    other = readmes.withColumn("content", F.lit("```python\nimport pkg.app\n```\npkg/app.py"))
    assert score(readmes, setups) == score(other, setups.withColumn("content", F.lit("setup()")))


def test_contexts_with_another_tokenizer(spark):
    """With single characters as tokens a budget of 9 is nine characters that are no white space."""
    from reposcope.functions import text as T
    letters = T.Tokenizer(r"[^ \t\n\x0B\f\r]")
    rows = [(1, 0, ["a.py"], "a.py", "a.py", False, "one two three"), (1, 1, ["b.py"], "b.py", "b.py", False, "four")]
    tree = spark.createDataFrame(rows, "repo_id long, ord int, path array<string>, path_str string, name string, excluded boolean, content string")
    repos = spark.createDataFrame([(1, "proj")], "repo_id long, name string")
    build = lambda kind: CX.create_context(kind, tree, repos, 9, order="traversal", tokenizer=letters).first().context
    assert build("all_data") == "one two thr" and build("random_file") == "one two thr"
    assert build("file_names") == "a.py b.py"[:10]
    assert spark.createDataFrame([("ab c",)], "t string").select(T.token_count("t", letters)).first()[0] == 3
