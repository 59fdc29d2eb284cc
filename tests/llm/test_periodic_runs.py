import hashlib
import random
import zlib

import numpy as np
import pytest

from reposcope.llm import periodic_runs as r

LONG = 10**18


def plain_runs(words):
    """Every period, every stretch; a stretch listed before has a smaller period."""
    n, found, stretches = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and (i, j + q) not in stretches:
                stretches.add((i, j + q))
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found)


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = sorted(runs, key=lambda x: (-x[1] * LONG // x[2], x[0], x[2]))[:1]
    return (
        doc_id, len(runs), *((*top[0], 1000 * top[0][1] // top[0][2]) if top else (None,) * 4),
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


@pytest.mark.parametrize("letters", [1, 2, 3, 7, 60])
def test_runs_match_every_period_tried(letters):
    rnd = random.Random(letters)
    for _ in range(150):
        n = rnd.randrange(0, 160)
        a = [rnd.randrange(letters) for _ in range(n)]
        for _ in range(rnd.randrange(4) if n > 3 else 0):
            s, q, m = rnd.randrange(n), rnd.randrange(1, 25), rnd.randrange(n)
            for i in range(s + q, min(n, s + q + m)):
                a[i] = a[i - q]
        assert r.runs_of(np.array(a, dtype=np.int64)) == plain_runs(a), a


def test_transforms_count_squared_differences():
    rng = np.random.default_rng(3)
    for b in (1, 2, 8, 64):
        blocks, windows = rng.integers(0, 5000, (3, b)), rng.integers(0, 5000, (3, 2 * b))
        plain = np.array([[((x - w[d : d + b]) ** 2).sum() for d in range(b)] for x, w in zip(blocks, windows)])
        for prime, generator in r.PRIMES:
            assert (r._differences(blocks, windows, prime, generator) == plain % prime).all()


def test_zero_mismatch_occurrences_with_large_numbers():
    a = np.concatenate([np.arange(64) * 40_000, np.arange(64) * 40_000, [1, 2]])
    at, by = r.occurrences(a, np.array([0, 32]), 32)
    assert sorted(zip(at.tolist(), by.tolist())) == []  # 64 apart: beyond 2 * 32 - 1
    at, by = r.occurrences(a, np.array([0]), 64)
    assert list(zip(at.tolist(), by.tolist())) == [(0, 64)]


def test_rows_match_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(plain_row(d.doc_id, d.text) for d in docs.filter("length(text) < 5000").collect())
    got = sorted(tuple(x) for x in r.detect(docs.filter("length(text) < 5000"), r.stand_in).collect())
    assert got == want and sum(x[1] for x in want) > 10


def test_whole_table_has_one_row_per_document(spark):
    rows = r.op13(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(x.runs_sha256 and x.collapsed_sha256 for x in rows)


def test_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, 5), (1, "", 6), (None, "a b " * 4, 7), (None, "a b " * 4, 7), (2, "x " * 40_000, 8), (3, " \t\n", 9)],
        "doc_id long, text string, period int",
    )
    got = sorted((tuple(x) for x in r.detect(docs).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert [x[1:] for x in got if x[0] in (1, 3)] == [(0, None, None, None, None, empty, empty)] * 3
    assert [x[1:6] for x in got if x[0] is None] == [(1, 0, 8, 2, 4000)] * 2
    assert [x[1:6] for x in got if x[0] == 2] == [(1, 0, 40_000, 1, 40_000_000)]
    assert r.detect(docs.limit(0)).count() == 0
    kept = {(x.doc_id, x.text, x.period) for x in r.collapse(docs).collect()}
    assert kept == {(1, None, 5), (1, "", 6), (None, "a b", 7), (2, "x", 8), (3, " \t\n", 9)}


def test_ties_go_to_the_smaller_start():
    assert r.best_run([(0, 8, 2), (20, 4 * 5, 5), (50, 8, 2)]) == (0, 8, 2)
    assert r.best_run([(0, 9, 2), (20, 23, 5)]) == (20, 23, 5)
