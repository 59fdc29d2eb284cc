"""Learned sentence boundaries: hand-worked cases and plain counts."""

import math
import random
import re


from reposcope.operators import sentences as SE


def _split(spark, text, model):
    return spark.createDataFrame([(text,)], "t string").select(SE.sentences("t", model)).first()[0]


def test_rule_on_hand_worked_texts(spark):
    model = SE.Model(["dr", "e.g", "fig"], ["the", "then"])
    cases = {
        "Dr. Holm went home. It rained.": ["Dr. Holm went home.", "It rained."],
        "See fig. 3, e.g. the left one! Done?": ["See fig. 3, e.g. the left one!", "Done?"],
        "We saw Dr. The man left.": ["We saw Dr.", "The man left."],
        "J. Smith came... and left. Then (he said.) nothing.": ["J. Smith came... and left.", "Then (he said.) nothing."],
        "one line\nand  two.  three": ["one line", "and two. three"],
        "version 2.5 of it. Next": ["version 2.5 of it.", "Next"],
        "": [], " \n ": [], "no stop": ["no stop"],
    }
    assert {t: _split(spark, t, model) for t in cases} == cases
    assert _split(spark, None, model) is None
    assert _split(spark, "Dr. A. b", SE.Model([], [])) == ["Dr.", "A. b"]


def corpus(n=400):
    rnd = random.Random(9)
    names, verbs, ends = ["Holm", "Brandt", "Lind"], ["walked", "slept", "sang"], ["home", "there", "again", "today"]
    out = []
    for _ in range(n):
        s = []
        for _ in range(rnd.randint(1, 6)):
            title = rnd.choice(["dr. ", "prof. ", ""])
            s.append(f"{rnd.choice(['The', 'Then', 'The'])} {title}{rnd.choice(names)} {rnd.choice(verbs)} {rnd.choice(ends)} {rnd.choice(ends)}.")
        out.append(" ".join(s))
    return out


def test_learns_planted_abbreviations_and_starters(spark):
    docs = spark.createDataFrame([(t,) for t in corpus()], "text string")
    model = SE.learn(docs)
    assert set(model.abbreviations) == {"dr", "prof"}
    assert set(model.starters) == {"the", "then"}
    assert _split(spark, "The dr. Lind sang home there. Then he left.", model) == ["The dr. Lind sang home there.", "Then he left."]
    none = SE.learn(docs.limit(0))
    assert none == SE.Model([], [])


def test_counts_and_scores_match_plain_python(spark):
    texts = corpus(60) + ['He said "etc." (cf. p.5) to A.B. and x,y!', None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {}
    for t in texts:
        for w in (t or "").split():
            w = re.match(SE.BARE, w).group(1)
            base = re.sub(r"[.,;:!?]$", "", w).lower()
            if re.match(r"^[^\W\d_](?:[^\W\d_]|\.)*$", base):
                a, b = want.get(base, (0, 0))
                want[base] = (a + w.endswith("."), b + (not w.endswith(".")))
    got = {r.base: (r.n_with, r.n_without) for r in SE.word_counts(docs).collect()}
    assert got == want
    n, p = sum(a + b for a, b in want.values()), sum(a for a, _ in want.values())
    scores = {}
    for base, (a, b) in want.items():
        null = a * math.log(p / n) + b * math.log(1 - p / n)
        alt = a * math.log(SE.RATE) + b * math.log(1 - SE.RATE)
        letters = len(base.replace(".", ""))
        score = -2 * (null - alt) * math.exp(-letters) * (base.count(".") + 1) * letters ** -b
        if a and score >= SE.ABBREVIATION:
            scores[base] = round(score, 4)
    assert {r.base: round(r.score, 4) for r in SE.abbreviations(SE.word_counts(docs)).collect()} == scores


ODD = ["The dr. Lind sang home. Then prof. Holm (slept) again... The end", "Then prof. The dr. Then\nThe prof.\n\n dr. lind", "", " \n ", None]


def _all_sentences(docs, model):
    return sorted(((r.text, r.s) for r in SE.split(docs, "text", "s", model).collect()), key=repr)


def test_words_beyond_the_constants_are_joined(spark, monkeypatch):
    texts = corpus(200) + ODD + ODD  # texts may repeat
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = SE.learn(docs)
    assert len(whole.abbreviations) == len(whole.starters) == 2 and whole.more is None
    want = sorted(((t, s) for t, s in docs.select("text", SE.sentences("text", whole).alias("s")).collect()), key=repr)
    assert ("Then prof. The dr. Then\nThe prof.\n\n dr. lind", ["Then prof.", "The dr.", "Then", "The prof.", "dr. lind"]) in want
    for most in (1, 0):
        monkeypatch.setattr(SE, "MOST", most)
        model = SE.learn(docs)
        assert len(model.abbreviations) == len(model.starters) == most
        more = {(r.starts, r.word) for r in model.more.collect()}
        assert more | {(False, w) for w in model.abbreviations} | {(True, w) for w in model.starters} == {(False, "dr"), (False, "prof"), (True, "the"), (True, "then")}
        assert _all_sentences(docs, model) == want


def test_starters_are_counted_behind_all_abbreviations(spark):
    docs = spark.createDataFrame([(t,) for t in corpus(50) + ODD], "text string")
    want = sorted(SE.starter_counts(docs, ["dr", "prof"]).collect())
    more = spark.createDataFrame([("prof",), ("dr",), ("etc",)], "word string")
    assert sorted(SE.starter_counts(docs, [], more=more).collect()) == want
    assert sorted(SE.starter_counts(docs, ["dr"], more=more.where("word <> 'dr'")).collect()) == want


def test_summaries_by_words_beyond_the_constants(spark, monkeypatch):
    from reposcope.operators import metrics as M

    texts = corpus(120)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = [(k % 7, a, b) for k, (a, b) in enumerate(zip(texts[:20] + [None, ""], texts[20:40] + ["x.", None]))]
    pairs = spark.createDataFrame(rows, "pair_id int, prediction string, reference string")
    want = sorted(M.rouge_lsum(pairs, model=SE.learn(docs)).collect())
    monkeypatch.setattr(SE, "MOST", 1)
    assert sorted(M.rouge_lsum(pairs, model=SE.learn(docs)).collect()) == want


def test_a_thousand_abbreviations_and_more_are_known(spark):
    b = "bcdfghjklmnpqrstvwxz"
    shorts = [x + y + z for x in b for y in b for z in b][:SE.MOST + 50]
    texts = [" ".join(f"one day we saw {s}. and went on" for s in shorts[lo:lo + 10]) + " for a day." for lo in range(0, len(shorts), 10)]
    docs = spark.createDataFrame([(t,) for t in texts for _ in range(40)], "text string")
    model = SE.learn(docs)
    assert len(model.abbreviations) == SE.MOST
    assert {r.word for r in model.more.where("NOT starts").collect()} | set(model.abbreviations) == set(shorts)
    text = " ".join(f"{s}. Ab," for s in shorts)
    assert SE.split(spark.createDataFrame([(text,)], "t string"), "t", "s", model).first()["s"] == [text]
