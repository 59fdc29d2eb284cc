import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from reposcope.llm import ranked_search as r


def terms_of(text):
    out = []
    for run in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or ""):
        out.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run))
    return out


def plain(docs, items, k):
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs if terms_of(t)]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    queries = defaultdict(set)
    for item, text in items:
        queries[item].update(terms_of(text))
    out = []
    for item, terms in queries.items():
        rows = []
        for i, c, size in held:
            m = 100 - 50 + (50 * size * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                rows.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def random_tables(seed):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6)) % 60}" for _ in range(400)] + ["Ünder", "É9", "A-b", "x.y"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, text(rnd.randrange(0, 60))) for i in range(150)]
    docs += [(i % 7, docs[i % 5][1]) for i in range(30)] + [(None, docs[3][1]), (None, docs[3][1]), (900, None), (901, ""), (902, "-- ..")]
    rnd.shuffle(docs)
    items = [(i, text(rnd.randrange(1, 25))) for i in range(12)] + [(3, "w1 w2 w50"), (None, text(5)), (90, None), (91, "nowhere"), (92, "")]
    return docs, items


def test_matches_plain_scores(spark):
    for seed, k in ((1, 3), (2, 10), (3, 500)):
        docs, items = random_tables(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("score", r.F.lit(1)).withColumn("item_id", r.F.lit("x"))
        q = spark.createDataFrame(items, "item_id int, text string").withColumn("rank", r.F.lit("y"))
        got = r.top_documents(d, q, k, block_bytes=300, slice_bytes=1500)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, k), (seed, k)


def opened(docs, items):
    row = dict(zip((f.split()[0] for f in r.SEGMENT.split(", ")), (v if isinstance(v, bytes) else v.tobytes() for v in r.segment([d[0] for d in docs], [d[1] for d in docs]))))
    lengths = r._numbers(row["lengths"], "<i8")
    df = Counter(t for _, text in docs for t in set(r.words_of(text)))
    wanted = {t for _, text in items for t in r.words_of(text)}
    q = r.Queries(items, {t: c for t, c in df.items() if t in wanted}, len(lengths), int(lengths.sum()))
    fields = r.prepared(row, q)
    return q, r.Segment(dict(zip((f.split()[0] for f in r.PREPARED.split(", ")), (v if isinstance(v, bytes) else v.tobytes() for v in fields))))


def test_pair_lists_and_bounds():
    docs, items = random_tables(4)
    q, s = opened(docs, items)
    assert s.pair and len(s.pair) == len(s.joint)
    for (a, b), i in s.pair.items():
        both = np.intersect1d(s.places[a], s.places[b])
        assert (s.pair_places[i] == both).all()
        total = r._looked_up(both, s.places[a], s.scores[a], 0) + r._looked_up(both, s.places[b], s.scores[b], 0)
        assert (s.pair_scores[i] == total).all() and s.joint[i] == total.max() <= s.most[a] + s.most[b]
    tighter = 0
    for words in q.terms:
        terms = [s.term[w] for w in words if w in s.term]
        rest, _ = s.rests(terms)
        for i in range(len(terms) + 1):
            real = np.zeros(len(s.ids), dtype=np.int64)
            for t in terms[i:]:
                real[s.places[t]] += s.scores[t]
            single = sum(s.most[t] for t in terms[i:])
            assert real.max(initial=0) <= rest[i] <= single
            tighter += rest[i] < single
    assert tighter > 10


def test_known_score_only_removes_what_it_excludes():
    docs, items = random_tables(5)
    q, s = opened(docs, items)
    for words in q.terms:
        at, have = s.top(words, 5, 0)
        full = dict(zip(at.tolist(), have.tolist()))
        top = sorted(full.values(), reverse=True)[:5]
        if len(top) == 5:
            at, have = s.top(words, 5, top[-1])
            assert sorted(have.tolist(), reverse=True)[:5] == top


def test_oracle_sql_states_the_same_rows(spark):
    for seed in (7, 8):
        docs, items = random_tables(seed)
        con = duckdb.connect()
        con.execute("create table documents (doc_id bigint, text varchar); create table benchmark (item_id int, text varchar)")
        con.executemany("insert into documents values (?, ?)", docs)
        con.executemany("insert into benchmark values (?, ?)", items)
        assert sorted(con.sql(r.OP11_SQL).fetchall(), key=str) == plain(docs, items, r.TOP)


def test_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert r.top_documents(docs, items).count() == 0
    assert r.top_documents(docs.limit(0), items).count() == 0
    assert r.top_documents(docs, items.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a " * 300_000 + "b"), (2, "b")], "doc_id long, text string")
    assert sorted(map(tuple, r.top_documents(long, items).collect())) == plain([(1, "a " * 300_000 + "b"), (2, "b")], [(1, "a b")], 50)
