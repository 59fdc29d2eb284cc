import numpy as np
import pytest

from reposcope.llm import toxicity as t

AT = {f: i for i, f in enumerate(t.FEATURES)}


def feature(text, name):
    return t.features(text)[0][AT[name]]


def test_features_of_a_worked_text():
    text = "You IDIOT!!! nobody likes a 1d10t or a stuuuupid m.o.r.o.n. The house is green."
    row, listed = t.features(text)
    assert listed["idiot"] == 2 and listed["stupid"] == 1 and listed["moron"] == 1 and listed["nobody"] == 1
    assert row[AT["hidden"]] == 3 and row[AT["insults_near_you"]] == 2 and row[AT["n_insults"]] == 2
    assert row[AT["shouted"]] > 0 and row[AT["punctuation_runs"]] > 0
    assert feature("a plain text about houses", "insults") == 0 and feature("a plain text", "first_insult") == 1


@pytest.mark.parametrize("token, word", [("1d10t", "idiot"), ("tr@sh", "trash"), ("m-o-r-o-n", "moron"), ("looooser", "loser"), ("x86", ""), ("3.14", ""), ("", "")])
def test_hidden_words(token, word):
    assert t.revealed(token) == word


def plain_isotonic(raw, y):
    """Max-min form of the isotonic fit, on distinct scores."""
    at = sorted(set(raw))
    cells = [[v for r, v in zip(raw, y) if r == a] for a in at]
    mean = lambda lo, hi: np.mean([v for c in cells[lo : hi + 1] for v in c])
    return at, [max(min(mean(lo, hi) for hi in range(i, len(at))) for lo in range(i + 1)) for i in range(len(at))]


def test_isotonic_matches_the_max_min_formula():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        raw, y = rng.integers(0, 12, n) / 12, rng.integers(0, 2, n).astype(float)
        at, want = plain_isotonic(raw.tolist(), y.tolist())
        knots, share = t.isotonic(raw, y)
        assert np.allclose(np.interp(at, knots, share), want)
        assert (np.diff(knots) > 0).all() and (np.diff(share) >= 0).all()


def test_word_weights_by_hand():
    listed = [t.Counter({"idiot": 3}), t.Counter({"idiot": 1, "clown": 1}), t.Counter({"clown": 2}), t.Counter()]
    w = t.word_weights(listed, np.array([1.0, 1.0, 0.0, 0.0]))
    pooled = (3 + t.DRAWN * 0.5) / (4 + t.DRAWN)
    assert w["idiot"] == pytest.approx((2 + t.DRAWN * pooled) / (2 + t.DRAWN))
    assert w["clown"] == pytest.approx((1 + t.DRAWN * pooled) / (2 + t.DRAWN))
    assert w["moron"] == pytest.approx(pooled) and w["kill"] == pytest.approx(0.5)


def test_held_out_rows_are_told_apart(spark):
    d = "/root/testdata/sf0.1"
    rows = t.op12(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    got = rows[rows.held_out]
    assert len(got) > 1000 and got.score.between(0, 1).all()
    told = got[got.predicted == 1]
    assert (told.toxic == 1).mean() > 0.95 and len(told) > 50
    assert ((got.predicted == 1) == (got.toxic == 1)).mean() > 0.93
    # calibrated: the mean score of the held-out rows is near their share of toxic ones
    assert abs(got.score.mean() - got.toxic.mean()) < 0.03


def test_held_out_labels_do_not_matter(spark):
    docs = spark.createDataFrame([(i, f"you idiot {i}" if i % 4 == 0 else f"a calm day {i}") for i in range(200)], "doc_id long, text string")
    held = t.crc_mod(t.F.col("doc_id"), 3) == 1
    labels = docs.select("doc_id", (t.F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", t.F.when(held, 1 - t.F.col("toxic")).otherwise(t.F.col("toxic")))
    a, b = (sorted(map(tuple, t.score(docs, t.train(*t.sample(docs, x))).collect())) for x in (labels, turned))
    assert a == b and {i for i, s in a if s >= t.TOXIC_AT} == set(range(0, 200, 4))


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "a b", 9), (3, "w! " * 50_000, 9), (3, "x", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (77, 0)], "doc_id long, toxic int")
    x, listed, y, fold = t.sample(docs, labels)
    assert x.shape == (len(y), len(t.FEATURES)) and len(listed) == len(fold) == len(y) <= 1
    rows = t.score(docs, t.train(x, listed, y, fold)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    x, listed, y, fold = t.sample(docs.limit(0), labels.limit(0))
    model = t.train(x, listed, y, fold)
    assert len(y) == 0 and t.score(docs.limit(0), model).count() == 0
    assert {r.score for r in t.score(docs, model).collect()} == {0.5}


def test_insults_of_no_list_are_learned(spark):
    """A root with ever new endings marks the toxic rows; clean rows hold it at most once, or not at all."""
    words = ["lantar", "moseno", "pirdel", "sukamo", "tenvir", "odrane"]
    ends = ["an", "eth", "ilo", "orn", "usk", "yma", "ede", "opt"]
    bad = lambda i: i % 4 == 0
    text = lambda i: " ".join(words[(i * k) % 6] for k in range(1, 30)) + (f" vromb{ends[i % 8]} x vromb{ends[i // 8 % 8]}" if bad(i) else "")
    docs = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")
    labels = docs.select("doc_id", (t.F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    got = {r.doc_id: r.score for r in t.score(docs, t.train(*t.sample(docs, labels))).collect()}
    assert {i for i, s in got.items() if s >= t.TOXIC_AT} == {i for i in range(600) if bad(i)}


def test_units_and_their_weights():
    assert t.units("abcdef") == ["=abcdef", "^abcd", "^abcde"] and t.units("abc") == ["=abc"]
    lexicon = t.Lexicon(frozenset({"^vrom", "=vromba"}))
    listed = t.features("Vromba vrombi x idiot", lexicon)[1]
    assert dict(listed) == {"^vrom": 2, "=vromba": 1, "idiot": 1}
    w = t.word_weights([listed, t.Counter()], np.array([1.0, 0.0]))
    assert w["^vrom"] == pytest.approx(np.log(1.5 / 2 * 2 / 0.5)) and w["idiot"] < 1
