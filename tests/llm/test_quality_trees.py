import numpy as np

from reposcope.llm import quality_trees as q


def walk(t, row):
    total = t.prior
    for at in t.root:
        while t.feature[at] >= 0:
            at = t.child[at] + (row[t.feature[at]] > t.limit[at])
        total += t.value[at]
    return 1 / (1 + np.exp(-total))


def test_flat_traversal_matches_node_by_node():
    r = np.random.default_rng(1)
    x = r.normal(size=(800, len(q.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = q.fit(x, y)
    got = t.scores(x)
    assert np.allclose(got[:50], [walk(t, row) for row in x[:50]])
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.95


def test_one_class_or_none():
    x = np.zeros((3, len(q.FEATURES)))
    assert np.allclose(q.fit(x[:0], np.zeros(0)).scores(x), 0.5)
    assert (q.fit(x, np.ones(3)).scores(x) > 0.9).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = q.op10(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = rows.join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 40 and rows.count() == 1000
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.9


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "a b c", 9), (3, "w " * 50_000, 9), (3, "x", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (77, 0)], "doc_id long, quality int")
    x, y = q.sample(docs, labels)
    assert x.shape == (len(y), len(q.FEATURES)) and len(y) <= 1
    assert q.score(docs, q.fit(x, y)).count() == 5
    x, y = q.sample(docs.limit(0), labels.limit(0))
    assert len(y) == 0 and q.score(docs.limit(0), q.fit(x, y)).count() == 0
