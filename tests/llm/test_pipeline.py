"""The pipeline against a plain version of each stage on the smallest table."""

import hashlib
import importlib
import struct
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from reposcope.llm import bpe, decontaminate, line_rules, pii
from test_decontaminate import brute as hits
from test_jaccard import brute as classes
from test_line_rules import WORD, brute_repeated

D = "/root/testdata/sf0.001"


def good(docs):
    """doc_ids that the quality rules keep."""
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    held = {}
    for r in docs:
        for x in r.text.split("\n"):
            if norm(x):
                held.setdefault((r.source, norm(x)), set()).add(r.doc_id)
    out = set()
    for r in docs:
        ws = WORD.findall(r.text)
        gone = 0
        for x in r.text.split("\n"):
            at = held.get((r.source, norm(x)), ())
            if len(at) > line_rules.LINE_DOCS and min(at) != r.doc_id:
                gone += len(norm(x))
        left = len(r.text) - gone
        if len(ws) >= 50 and 100 * brute_repeated(ws) <= 50 * len(ws) and (not gone or left >= line_rules.LEAST_LEFT * len(r.text)):
            out.add(r.doc_id)
    return out


def test_pipeline_matches_plain_version(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    kept = good(docs)
    docs = [r for r in docs if r.doc_id in kept]
    first = classes([(r.doc_id, r.text) for r in docs])
    docs = [r for r in docs if first[r.doc_id][0] == r.doc_id]
    docs = [r for r in docs if not decontaminate.find(decontaminate.words_of(r.text), decontaminate.build_tables(items))[0]]
    assert not any(hits(r.text, items[:4])[0] for r in docs)
    want = set()
    for r in docs:
        ids = library.encode(pii.redacted(r.text, pii.all_spans(r.text)[1]), add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
    got = cp.run(spark, D).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in got} == want and len(got) == len(want) > 50


def test_stages_keep_all_columns_and_take_any_rows(spark):
    rows = [(1, None, "en", None, 0, "a"), (None, "x y", "en", "s", 3, "b"), (2, " ".join(f"word{i}" for i in range(80)), None, "s", 1, "c"), (2, "", "en", "s", 0, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string")
    for docs in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, D)
            assert out.columns == docs.columns
            out.collect()
        cp.STAGES[-1][1](spark, docs, D).collect()


def test_stages_fit_the_contract():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "personal_data", "bpe"]
    assert cp.ORACLE_SQL is None
    entry = importlib.import_module("__spark_entry__")
    assert {"pipeline", "op9_bpe"} <= set(entry.queries())
    assert all(v for v in entry.oracle_sql().values())
    assert "corpus_pipeline" in sys.modules


def cut(docs):
    """doc_id -> the text without the lines that more documents of the host than the limit hold."""
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    held = {}
    for r in docs:
        for x in r.text.split("\n"):
            if norm(x):
                held.setdefault((r.source, norm(x)), set()).add(r.doc_id)
    gone = {k: min(at) for k, at in held.items() if len(at) > line_rules.LINE_DOCS}
    return {r.doc_id: "\n".join(x for x in r.text.split("\n") if gone.get((r.source, norm(x)), r.doc_id) == r.doc_id) for r in docs}


def test_first_stage_returns_texts_without_frequent_lines(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    line = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Terms of use | Contact\n"), "text")).otherwise(F.col("text"))
    docs = docs.withColumn("source", F.lit("one")).withColumn("text", line).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    rows = docs.collect()
    kept, texts = good(rows), cut(rows)
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.quality_rules(spark, docs, D).collect()}
    assert got == {d: (texts[d], len(texts[d])) for d in kept}
    assert sum(texts[r.doc_id] != r.text for r in rows if r.doc_id in kept) > 50
