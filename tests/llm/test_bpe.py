import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reposcope.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(bpe.default_path())


ODD = ["", " ", "a", "aaaaaaa", "  two  spaces \n\n x", "It's we'll I'M 12345 ½ Ⅳ", "é́ ñ ß 漢字 😀😀", "\x00\x1c\x1f\x85   x",
       "a<|endoftext|>b<|endoftext|><|endoftext|>", "<|endoftext|", "x" * 5000, "ab" * 3000 + " " * 50, "�​", "a\u088f1\U000323b0b \ua7cfx"]


def test_odd_texts_match_the_library(library, vocabulary):
    got = bpe.Encoder(vocabulary).encode(ODD)
    for text, ids in zip(ODD, got):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_texts_match_the_library(library, vocabulary, texts):
    got = bpe.Encoder(vocabulary).encode(texts)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(vocabulary)
    for text in ODD + ODD:
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_merging_one_by_one_gives_the_same(library, vocabulary):
    encoder = bpe.Encoder(vocabulary)
    assert encoder.index.ascending
    encoder.index.ascending = False
    for text, ids in zip(ODD, encoder.encode(ODD)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_a_lower_rank_may_come_up():
    """With a merge whose result joins a pair of lower rank the order is kept as well."""
    size = 4
    ranks = {0 * size + 1: (1, 2), 2 * size + 1: (0, 3)}
    assert not bpe.PairIndex(ranks, size).ascending
    assert bpe.PairIndex({0 * size + 1: (0, 2), 2 * size + 1: (1, 3)}, size).ascending


def test_latin_pattern_cuts_like_the_general_one():
    r = random.Random(3)
    general, latin = bpe.regex.compile(bpe.PRETOKEN).findall, bpe.re.compile(bpe.latin_pattern()).findall
    alphabet = [chr(c) for c in range(bpe.LATIN) if not 0x1C <= c <= 0x1F] + list("  's'll\n\t  ab") * 20
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(30)))
        assert latin(text) == general(text), repr(text)


def test_one_very_long_pretoken(library, vocabulary):
    text = "".join(random.Random(1).choices("abcdeé", k=300_000))
    (ids,) = bpe.Encoder(vocabulary).encode([text])
    assert bpe.Decoder(vocabulary.tokens).text(ids.astype("<u4").tobytes()) == text
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_matches_the_library(spark, library):
    rows = bpe.op9(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "hi", "y"), (1, "", "z"), (2, "hi", "y")], "doc_id long, text string, ids string")
    rows = bpe.digests(docs, bpe.default_path()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (1, 0), (1, 0), (2, 1)]
    assert bpe.digests(docs.limit(0), bpe.default_path()).count() == 0


def test_ids_and_texts_come_from_one_worker(spark):
    """A task that encodes and decodes holds one Python process, and the rows are those of the two operators."""
    docs = spark.createDataFrame([(1, "one two  two"), (2, None), (2, "é 漢 1\n2<|endoftext|>"), (None, "")], "doc_id long, text string")
    vocabulary = bpe.Vocabulary.load(bpe.default_path())
    plan = bpe.digests(docs, bpe.default_path())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    key = lambda r: (r.doc_id or 0, r.text)
    assert sorted(bpe.there_and_back(docs, vocabulary).collect(), key=key) == sorted(bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect(), key=key)


def test_a_slice_of_new_words_takes_little_memory(vocabulary):
    """The arrays of the merge have 32 bits: less than 50 bytes at the peak for each byte of a slice."""
    import tracemalloc

    r = random.Random(5)
    words = [" " + "".join(r.choices("etaoinshrdlu", k=9)) for _ in range(60_000)]
    encoder = bpe.Encoder(vocabulary)
    tracemalloc.start()
    encoder._apply(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * 600_000
