import math
import random
import re
import zlib

import numpy as np
import pytest

from reposcope.llm import ngram_lm as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(t) + [None]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0


def base(rows):
    count = {}
    for d, t in rows:
        if not held(d):
            for w in tokens(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    out = []
    for d, t in rows:
        ws = tokens(t)
        s = sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((d, held(d), len(ws), sum(w in count for w in ws), n, round(s, 6)))
    return out


def model(rows, order, weights):
    """The mixture by the definition, for given weights."""
    count, uni = {}, {}
    for d, t in rows:
        if held(d):
            continue
        ws = ["<s>", *tokens(t)]
        for i in range(len(ws)):
            for n in range(1, order + 1):
                if i >= n - 1:
                    g = tuple(ws[i - n + 1 : i + 1])
                    count[g] = count.get(g, 0) + 1
        for w in ws[1:]:
            uni[w] = uni.get(w, 0) + 1
    n_all, v = sum(uni.values()), len(uni)
    out = []
    for d, t in rows:
        ws, total = ["<s>", *tokens(t)], 0.0
        for i in range(1, len(ws)):
            p, left = 0.0, 1.0
            for n in range(order, 1, -1):
                c = count.get(tuple(ws[i - n + 1 : i]), 0) if i >= n - 1 else 0
                if c:
                    w = weights[n][int(q.bucket_of(np.array([c]))[0])]
                    p += left * w * count.get(tuple(ws[i - n + 1 : i + 1]), 0) / c
                    left *= 1 - w
            p += left * weights[1][0] * uni.get(ws[i], 0) / n_all + left * (1 - weights[1][0]) / (v + 1)
            total += math.log10(p)
        out.append((d, round(total, 6)))
    return out


def corpus(n=150):
    r = random.Random(8)
    words = [f"{'É' if i % 7 == 0 else 'W'}{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w, t = r.choice(words), []
        for _ in range(r.randint(0, 60)):
            t.append(w)
            w = words[(words.index(w) * 7 + r.choice([0, 0, 0, 1, 5])) % 60]
        rows.append((i, r.choice([" ", "\n", "\t \x0b"]).join(t)))
    return rows + [(None, "W1 w1"), (3, None), (4, ""), (4, ""), (500, "\xa0 x\x1cy")]


@pytest.mark.parametrize("order,batch", [(2, 1000), (3, 2500), (1, 1 << 22)])
def test_scores_match_the_definition(spark, order, batch):
    rows = corpus()
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, batch string")
    got = q.score(docs, order, batch, 3000).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.held, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key) == sorted(base(rows), key=key)
    weights = plain_em(rows, order)
    alike([(r.doc_id, r.score) for r in got], model(rows, order, weights))


def alike(got, want):
    """Equal ids, and scores that differ by no more than where EM stops."""
    got, want = (sorted(x, key=lambda r: (repr(r[0]), r[1])) for x in (got, want))
    assert [d for d, _ in got] == [d for d, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(got, want)) < 2e-3


def plain_em(rows, order):
    """Weights from the training tokens, one by one, each without itself; shares on the grid of powers of two."""
    count, seen = {}, []
    for d, t in rows:
        if not held(d):
            ws = ["<s>", *tokens(t)]
            for i in range(len(ws)):
                for n in range(1, order + 1):
                    if i >= n - 1:
                        g = tuple(ws[i - n + 1 : i + 1])
                        count[g] = count.get(g, 0) + 1
                if i:
                    seen.append((ws, i))
    uni = {g: c for g, c in count.items() if len(g) == 1 and g != ("<s>",)}
    n_all, kinds = sum(uni.values()), len(uni)
    grid = lambda x: 2.0 ** (round(math.log2(x) * q.GRID) / q.GRID)
    bucket = lambda c: math.floor(math.log2(c)) + 1 if c else 0
    facts = {}
    for ws, i in seen:
        fact = []
        for n in range(order, 1, -1):
            c = count[tuple(ws[i - n + 1 : i])] - 1 if i >= n - 1 else 0
            g = count[tuple(ws[i - n + 1 : i + 1])] - 1 if i >= n - 1 else 0
            fact.append((n, bucket(c), 1 / grid(c / g) if c > 0 and g > 0 else 0.0))
        u = uni[(ws[i],)] - 1
        fact.append((1, 0, grid(u) / n_all if u else 0.0))
        facts[tuple(fact)] = facts.get(tuple(fact), 0) + 1
    weight = {n: [0.9 if n == 1 else 0.5] * q.BUCKETS for n in range(order + 1)}
    before = -math.inf
    for _ in range(q.ROUNDS):
        up, down, total = {}, {}, 0.0
        for fact, times in facts.items():
            left, parts = 1.0, []
            for n, b, share in fact:
                w = weight[n][b] if n == 1 or b > 0 else 0.0
                parts.append((n, b, left * w * share))
                left *= 1 - w
            rest = left / (kinds + 1)
            p = max(sum(x for _, _, x in parts) + rest, 1e-300)
            total += times * math.log(p)
            below = rest
            for n, b, x in reversed(parts):
                below += x
                up[n, b] = up.get((n, b), 0.0) + times * x / p
                down[n, b] = down.get((n, b), 0.0) + times * below / p
        for (n, b), x in down.items():
            if x > 0:
                weight[n][b] = min(max(up[n, b] / x, 0.0), 1 - (1e-9 if n == 1 else 1e-6))
        if abs(total - before) <= q.STILL * abs(total):
            break
        before = total
    return weight


def test_held_out_rows_teach_nothing(spark):
    """Other texts in the held-out rows change neither counts nor weights of the rest."""
    rows = corpus()
    other = [(d, "W1 W1 W2 qq qq" if held(d) else t) for d, t in rows]
    one, two = ({r.doc_id: (r.score, r.base_score) for r in q.score(spark.createDataFrame(x, "doc_id long, text string"), 3, 1500, 3000).collect() if r.doc_id is not None and not r.held}
                for x in (rows, other))
    assert one.keys() == two.keys() and all(one[d] == pytest.approx(two[d], abs=1e-9) for d in one)


def test_only_shared_trigrams_are_sent():
    """Trigrams that other batches hold are among those sent; most of the rest are not."""
    r = random.Random(2)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join(r.choice(common) if r.random() < 0.5 else f"own{b}x{r.randrange(400)}" for _ in range(800)) for b in range(4)]
    batches = [q.Batch(q.pa.table({"text": [t], "held": [False]}), 3) for t in texts]
    for i, x in enumerate(batches):
        others = [y for j, y in enumerate(batches) if j != i]
        sent = x.shared(3, np.isin(x.grams[1], np.concatenate([y.grams[1] for y in others])))
        elsewhere = np.isin(x.grams[2], np.concatenate([y.grams[2] for y in others]))
        assert sent[elsewhere].all() and sent.mean() < 0.4


def test_packed_counts():
    for x in ([], [0, 1, 254, 255, 256, 1 << 40, 3], [7] * 1000):
        assert q._unpack(q._pack(np.array(x, dtype=np.int64))).tolist() == x


def test_model_beats_base_on_held_out(spark):
    rows = q.op2(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum() * 0.99
    assert set(rows.columns) == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}


def test_query_uses_trigrams(spark, tmp_path):
    rows = corpus(60)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    alike([(r.doc_id, r.score) for r in q.op2(spark, str(tmp_path)).collect()], model(rows, 3, plain_em(rows, 3)))


def test_learning_prefers_the_informative_order():
    # tokens whose bigram estimate is 1 and whose unigram is rare
    cells = np.array([((5 * 256 + 1) * 256) + 9], dtype=np.int64)
    w = q.learn(2, cells, np.array([100]), 10_000, 100)
    assert w[2][5] > 0.99


def test_probabilities_sum_to_one():
    w = q.first_weights(2)
    shares = [np.full(3, 1 / 3), np.array([0.5, 0.5, 0.0]), np.array([1.0, 0.0, 0.0])]
    p, _ = q.mixture(2, w, [None, None, np.array([4, 4, 4])], shares)
    assert abs(p.sum() - 1) < 1e-12


def test_empty_and_no_training(spark):
    docs = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    (r,) = q.score(docs).collect()
    assert r.held and (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == 0.0 and abs(r.base_score) < 1e-9
    assert q.score(docs.limit(0)).count() == 0
