import hashlib
import random

import numpy as np
import pytest

from reposcope.llm import suffix_dedup as q

N = q.LENGTH


def brute(rows):
    """List of (id, n_bytes, spans, kept) by the definition."""
    first = {}
    ids = [q.NO_ID if d is None else d for d, _ in rows]
    raw = [(t or "").encode() for _, t in rows]
    for d, b in zip(ids, raw):
        for i in range(len(b) - N + 1):
            s = b[i : i + N]
            first[s] = min(first.get(s, d), d)
    out = []
    for (d, _), k, b in zip(rows, ids, raw):
        c = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - N + 1):
            if first[b[i : i + N]] < k:
                c[i + 1 : i + 1 + N] = True
        turn = np.flatnonzero(c[1:] != c[:-1])
        spans = list(zip(turn[::2].tolist(), turn[1::2].tolist()))
        out.append((d, len(b), spans, bytes(x for x, g in zip(b, c[1:]) if not g)))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = [f"{'é' if i % 5 == 0 else ''}w{i}" for i in range(300)]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = []
    for i in range(60):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 120)))
        k = r.randrange(9)
        if k == 0:
            t = t[:30] + passage + t[30:]
        elif k == 1 and rows:
            t = r.choice(rows)[1] or ""
        elif k == 2 and rows:
            o = r.choice(rows)[1] or ""
            at = r.randrange(len(o) + 1)
            t = o[:at] + "#" + o[at:]
        elif k == 3:
            t = "ab" * r.randint(0, 300)
        elif k == 4:
            t = "\0" * r.randint(0, 120) + "x" * r.randint(0, 90)
        rows.append((r.randrange(200) * 7, t))
    rows += [(None, passage), (3, None), (4, ""), (5, passage[:49]), (6, passage[:50]), (6, passage[:50]), (9, passage)]
    r.shuffle(rows)
    return rows


def collected(df):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,batch,heavy", [(1, 4000, 1 << 16), (2, 1500, 1 << 16), (3, 2500, 2), (4, 1 << 22, 1 << 16)])
def test_matches_the_definition(spark, monkeypatch, seed, batch, heavy):
    monkeypatch.setattr(q, "HEAVY", heavy)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, batch string")
    assert collected(q.dedup(docs, batch, 8000)) == sorted(brute(rows), key=repr)


def test_empty_table(spark):
    assert q.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_family_merges_by_rank():
    f, r = q.Family(), np.random.default_rng(3)
    seen = np.empty(0, "S4")
    for i in range(1, 21):
        new = np.unique(r.integers(0, 4000, 50).astype("S4"))
        assert (f.holds(new) == np.isin(new, seen)).all()
        f.add(new[~f.holds(new)])
        seen = np.union1d(seen, new)
        assert len(f.levels) == bin(i).count("1")
        assert [k for k, _ in f.levels] == sorted((k for k, _ in f.levels), reverse=True)
    assert len(seen) == sum(len(x) for _, x in f.levels)


def test_query_matches_the_definition(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in q.op1(spark, d).collect()}
    assert got == {i: (n, n - len(k), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(rows)}


def batches_of(rows, size):
    """Fragments of ``size`` rows at a time, sorted and distinct, as a batch sends them."""
    import pyarrow as pa

    rows = sorted(rows, key=lambda x: (q.NO_ID if x[0] is None else x[0], x[1] or ""))
    tables = [pa.table({"doc_id": pa.array([x[0] for x in rows[lo : lo + size]], pa.int64()), "text": pa.array([x[1] for x in rows[lo : lo + size]], pa.string())}) for lo in range(0, len(rows), size)]
    return [np.unique(b.stored(np.arange(len(b.start)))) for b in map(q.Batch, tables)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_group_of_batches_is_scanned_as_its_batches_are(seed):
    arrays = batches_of(corpus(seed), 3)
    one = q.Bucket()
    want = [one.scan([x])[0] for x in arrays]
    assert any(x.any() for x in want)
    for size in (2, 7, len(arrays)):
        b = q.Bucket()
        got = [x for lo in range(0, len(arrays), size) for x in b.scan(arrays[lo : lo + size])]
        for x, y, f in zip(got, want, arrays):
            many = np.char.str_len(f) - 9 - N + 1  # bits beyond a fragment's strings mean nothing
            low = ((np.uint64(1) << many.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
            assert ((x & low) == (y & low)).all()


def test_small_arrays_share_a_scan(monkeypatch):
    import pyarrow as pa

    arrays = batches_of(corpus(5), 1)[:40]
    rows = [(c, b, None, q._pack(x), q._pack(np.empty(0, f"S{q._STRING}"))) for b in (0, 1) for c, x in enumerate(arrays)]
    calls, scan = [], q.Bucket.scan
    monkeypatch.setattr(q.Bucket, "scan", lambda self, *a: calls.append(1) or scan(self, *a))
    out = pa.Table.from_batches(list(q._scanning(iter(q._table(rows, q._ARRAYS).to_batches()))))
    assert list(zip(out["bucket"].to_pylist(), out["batch"].to_pylist())) == [(b, c) for c, b, *_ in rows]
    assert len(calls) <= 4  # each array alone before: 80
    bits = out["bits"].to_pylist()
    assert [list(q._unpack(x, np.uint32)) for x in bits[:40]] == [list(q._unpack(x, np.uint32)) for x in bits[40:]]


def test_equal_prefixes_are_told_apart():
    f = q.Family()
    f.add(np.array([b"same-prefix-a", b"same-prefix-c", b"same-prefix-e"]))
    probe = np.array([b"other", b"same-prefix-a", b"same-prefix-b", b"same-prefix-c", b"same-prefix-d", b"same-prefix-e", b"same-prefix-f"])
    assert f.holds(probe).tolist() == [False, True, False, True, False, True, False]
    values, first, of = q._first_seen(np.array([b"same-prefix-b", b"same-prefix-a", b"same-prefix-b", b"same-prefix-a"]), np.array([2, 1, 0, 1]))
    assert values.tolist() == [b"same-prefix-a", b"same-prefix-b"] and first.tolist() == [1, 0] and of.tolist() == [1, 0, 1, 0]
