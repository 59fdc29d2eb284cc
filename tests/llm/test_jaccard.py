import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reposcope.llm import components as c
from reposcope.llm import jaccard as q
from reposcope.llm import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (class_id, n_links) over unique ids."""
    sets = {d: sets_of(t) for d, t in rows}
    links = {d: [e for e in sets if e != d and sets[d] and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e])] for d in sets}
    root = {}
    for d in sorted(sets):
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = d
                todo += links[x]
    return {d: (root[d], len(links[d])) for d in sets}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\xa0é", max_size=30), max_size=6))
def test_shingles(texts):
    values, counts = shingles.shingle_sets(texts, 5)
    assert counts.tolist() == [len(sets_of(t)) for t in texts]
    parts = np.split(values, np.cumsum(counts)[:-1]) if texts else []
    for a, x in zip(texts, parts):
        for b, y in zip(texts, parts):
            assert len(np.intersect1d(x, y)) == len(sets_of(a) & sets_of(b))


def corpus(seed=1, families=12, size=10):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows, n = [], 0
    for f in range(families):
        base = [r.choice(vocab) for _ in range(r.randint(30, 200))] + (passage if f % 2 else [])
        for _ in range(r.randint(1, size)):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((n, r.choice([" ", "  ", "\n"]).join(t)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "a  b"), (n + 4, "a b c d e"), (n + 5, " ")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,shingles_", [(1024, 1 << 20), (4, 700)])
def test_join_matches_brute_force(spark, monkeypatch, block, shingles_):
    monkeypatch.setattr(q, "BLOCK", block)
    monkeypatch.setattr(q, "BLOCK_SHINGLES", shingles_)
    rows = corpus()
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, class_id string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in q.join(docs).collect()}
    want = brute(rows)
    assert got == want
    kept = {r.doc_id for r in q.keep_one(docs).collect()}
    assert kept == {d for d, (k, _) in want.items() if k == d}
    assert q.keep_one(docs).columns == docs.columns


def test_large_group_of_near_copies(spark):
    r = random.Random(4)
    base = [f"v{r.randrange(300)}" for _ in range(150)]
    rows = []
    for i in range(400):
        t = list(base)
        t[r.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in q.join(docs).collect()} == brute(rows)


def test_repeats_nulls_and_empty(spark):
    t = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(3, t), (3, t), (None, t), (5, t + " x"), (5, None), (9, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in q.join(docs).collect()), key=str)
    assert got == sorted([(3, 3, 3), (3, 3, 3), (None, 3, 3), (5, 3, 3), (5, 5, 0), (9, 9, 0)], key=str)
    assert sorted((r.doc_id, r.text) for r in q.keep_one(docs).fillna("").collect()) == [(3, t), (3, t), (5, ""), (9, "")]
    assert q.join(docs.limit(0)).count() == 0 and q.keep_one(docs.limit(0)).count() == 0


def plain_rows(rows):
    """Per row (class_id, n_links), and the rows kept, where ids are negative, shared or null."""
    sets = [sets_of(t) for _, t in rows]
    key = [(q.NO_ID if d is None else d) for d, _ in rows]
    near = lambda a, b: bool(sets[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if near(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    out = []
    for a, (d, _) in enumerate(rows):
        out.append((d, min(key[b] for b in range(len(rows)) if root[b] == root[a]), sum(near(a, b) for b in range(len(rows)) if a != b)))
    classes = {}
    for a in range(len(rows)):
        classes.setdefault(root[a], []).append(a)
    return sorted(out, key=str), [[a for a in c if key[a] == min(key[b] for b in c)] for c in classes.values()]


@pytest.mark.parametrize("ids", [
    [-5, -4, -3, 0, 7, 8],  # negative ids
    [1, 1, 2, 3, 4, 5],  # an id with two texts, each with a near copy of its own
    [None, None, 2, None, 4, None],  # no ids
])
def test_odd_ids(spark, ids):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = list(zip(ids, [a, b, a + " z", b + " z", a + " y x", "alone here with five words"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, leads = plain_rows(rows)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in q.join(docs).collect()), key=str) == want
    kept = sorted((tuple(r) for r in q.keep_one(docs).collect()), key=str)
    assert len(kept) == len(leads)
    for lead in leads:  # exactly one of the rows that may lead each class
        assert sum(rows[x] in kept for x in lead) == 1


def test_pruning_table_and_forest():
    least = q.least_matches()
    assert least[16] <= 6 and 75 < least[128] < 95
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (5, q.VALUES), dtype=np.uint16)
    sig = np.concatenate([a, a, a[:2]])
    edges = q.forest(sig)
    assert len(edges) == 7
    assert q.survivors(sig[:5], sig[5:10]).tolist() == [0, 1, 2, 3, 4]


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(path + star + [(5000, 5000)], "u long, v long")
    got = {r.u: r.v for r in c.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 50)}
    assert c.components(edges.limit(0)).count() == 0
