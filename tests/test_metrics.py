"""Stems, subsequences, sentences, markdown and language id against hand-worked or plain versions."""

import random

from pyspark.sql import functions as F

from reposcope.functions.porter import stem
from reposcope.operators import metrics as M

STEMS = {
    "ties": "tie", "dying": "die", "enjoy": "enjoy", "skies": "sky", "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed",
    "agreed": "agre", "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size", "hopping": "hop", "falling": "fall",
    "filing": "file", "happy": "happi", "relational": "relat", "digitizer": "digit", "operator": "oper", "hopefulness": "hope",
    "triplicate": "triplic", "goodness": "good", "adjustable": "adjust", "replacement": "replac", "rate": "rate", "controlling": "control",
    "geology": "geolog", "cried": "cri", "died": "die", "news": "news", "proceed": "proceed",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def _table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def test_subsequences_match_the_full_table():
    r = random.Random(4)
    for _ in range(2000):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        assert M._lcs_indices(a, b) == _table(a, b)
        assert M._lcs_len(a, b) == len(_table(a, b))


def test_sentences_end_at_stops_and_lines(spark):
    df = spark.createDataFrame([("One two. Three!\nfour five\n\nsix? Seven",)], "t string")
    assert df.select(M.sentence_tokens("t")).first()[0] == [["one", "two"], ["three"], ["four", "five"], ["six"], ["seven"]]


MARKDOWN = [
    ("# Title\nparagraph right below", "paragraph right below"),
    ("before\n- item\nlazy\n\nafter", "before\nafter"),
    ("Title\n=====\n\ntext", "text"),
    ("two\nlines\n---\nrest", "rest"),
    ("~~~\ncode\n~~~\ntext", "text"),
    ("```\ncode\n```\ntext with `code` in it", "text with\nin it"),
    ("> quote\n\ntext\n> quote", "text"),
    ("| a | b |\n\n<b>html</b>\n\n    indented\n\nplain", "plain"),
    ("a **b** c", "a\nc"),
    ("", ""),
]


def test_markdown_keeps_paragraphs_only(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MARKDOWN)], "i int, t string")
    got = {r.i: [x.strip() for x in r.m.split("\n")] for r in df.select("i", M.markdown_text("t").alias("m")).collect()}
    assert got == {i: w.split("\n") for i, (_, w) in enumerate(MARKDOWN)}


def test_rouge_means(spark):
    df = spark.createDataFrame([("1", "the cats sat.\nthey run", "the cat sits.\nthey ran"), ("2", "", "x y")], "pair_id string, prediction string, reference string")
    (r,) = M.rouge(df).collect()
    # stemmed only above three letters: cats/cat meet, sat/sits and run/ran do not; 3 of 5 words on either side
    assert (r.rouge1, r.rougeL, r.rougeLsum) == (0.3, 0.3, 0.3)
    assert r.rouge2 == round((2 * 0.25 * 0.25 / 0.5) / 2, 6)


def test_language_of_text_without_grams_seen(spark):
    docs = spark.createDataFrame([("aaa aaa", "x"), ("bbb bbb", "y"), ("bbb", "y")], "text string, lang string")
    counts, lang = M.train_language_model(docs)
    texts = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "qqqq"), (4, None)], "id int, text string")
    got = {r.id: r.pred_lang for r in M.detect_language(texts, "id", "text", counts, lang).collect()}
    assert got[1] == "x" and got[2] == "y" and got[3] in ("x", "y") and got[4] == "none"
    assert counts.filter(F.col("log_num") <= 0).count() == 0


def test_generated_length_leaves_padding_out(spark):
    df = spark.createDataFrame([("a b _ _",), ("c _ _ _",)], "t string")
    assert M.gen_len(df, "t").first().gen_len == 4.0
    assert M.gen_len(df, "t", pad="_").first().gen_len == 1.5
