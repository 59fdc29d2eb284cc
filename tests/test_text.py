"""Text functions and metrics kernels."""

import random

from pyspark.sql import functions as F

from reposcope.functions import text as T
from reposcope.operators import metrics as M


def _one(spark, col, text):
    return spark.createDataFrame([(text,)], "x string").select(col).first()[0]


def test_strip_header(spark):
    src = "# Copyright 2020 X\n# Licensed under MIT\n\nimport os\nprint(1)\n"
    assert _one(spark, T.strip_header("x"), src) == "import os\nprint(1)\n"
    keep = "# just a comment\n\nprint(1)"
    assert _one(spark, T.strip_header("x"), keep) == keep


def test_cleanse_file(spark):
    src = "# License: MIT\n\n\n\nimport os\nfrom a import (b,\n c)\n\n\n\nx = 1\r\n"
    assert _one(spark, T.cleanse_file("x"), src) == "x = 1"


def test_truncate_tokens(spark):
    assert _one(spark, T.truncate_tokens("x", 3), "a b, c d") == "a b,"
    assert _one(spark, T.truncate_tokens("x", 10), "a b  ") == "a b  "


def test_truncate_words(spark):
    assert _one(spark, T.truncate_words("x", 2), "Hello world again") == "Hello world"
    assert _one(spark, T.truncate_words("x", 5), "Hi there") == "Hi there"


def test_lcs_matches_dynamic_programming():
    rnd = random.Random(3)
    for _ in range(300):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
        assert M._lcs_len(a, b) == dp[len(a)][len(b)]


def test_bleu_identity(spark):
    df = spark.createDataFrame([("p1", "the cat sat on the mat today", "the cat sat on the mat today")],
                               "pair_id string, prediction string, reference string")
    row = M.bleu(df).first()
    assert row.bleu == 1.0 and row.brevity_penalty == 1.0


def test_rouge_identity(spark):
    df = spark.createDataFrame([("p1", "a b c d", "a b c d")], "pair_id string, prediction string, reference string")
    row = M.rouge_n(df).first()
    assert row.rouge1 == 1.0 and row.rouge2 == 1.0


def test_bleu_tokens(spark):
    got = _one(spark, T.bleu_tokens("x"), "Hello, world. 3.5 dollars-worth 1-2")
    assert got == ["Hello", ",", "world", ".", "3.5", "dollars-worth", "1", "-", "2"]


def test_markdown_text(spark):
    md = "# Title\n\nFirst *bold* line\nsecond `code` line\n\n```python\nimport x\n```\n\n- item\n\nLast."
    assert _one(spark, M.markdown_text("x"), md) == "First \n line\nsecond \n line\nLast."


def test_summary_lcs_identity_and_disjoint():
    s = [["the", "cat", "sat"], ["on", "the", "mat"]]
    assert M.summary_lcs_f1(s, s) == 1.0
    assert M.summary_lcs_f1(s, [["dog", "ran"]]) == 0.0
