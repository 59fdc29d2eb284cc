"""Language-model scores by deleted interpolation.

An n-gram model: the maximum-likelihood estimate of each order is mixed with the next lower one by
a weight that depends on how often the context was seen (buckets of its count, by powers of two),
down to the unigrams and an even share for each of V + 1 tokens. The weights are learned by
expectation-maximisation on the training tokens, each with itself deleted: its n-grams and their
contexts count one less. Rows that are held out take no part in it; they only ask for totals.

1. Documents are dealt into batches by a hash. Each batch counts its distinct unigrams and bigrams
   and sends each once, whatever its number, to buckets of their hash, so no n-gram is a hot key.
2. A bucket sums the counts and tells each batch the total of each n-gram that it sent,
   and whether other batches sent it too.
3. Of the longer n-grams a batch sends those alone that another batch may hold: both n-grams of one
   token less in it were sent by others. All others are complete as they are. So most trigrams,
   which occur in one batch, are never sent.
4. Batches sum up their training tokens in cells: the context's bucket and the estimates on a
   logarithmic grid (half powers of two, which makes the weights approximate). The cells, of
   bounded number at any size of the corpus, are what EM runs on.
5. Each batch scores its documents with the totals and the weights.

All steps are one plan in which the texts are shuffled once. Words are known by 64-bit hashes, longer
n-grams by 56 bits of theirs.

Cases: a null or empty text has the end token alone; without training documents every count and N
and V are 0 (the base is then log10 of 1 per token, the model's share 1 per token); a null id has
the remainder of the empty text (0: held out); repeated rows each count and are each scored. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import crc_mod, pack_sorted, table, unpack_sorted
from reposcope.llm.jaccard import by_group
from reposcope.llm.shingles import mix, word_hashes

ORDER = 3
HELD_OUT_MOD = 10
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
ADD = 0.1
ROUNDS, STILL = 200, 1e-7
GRID = 2  # steps of the estimates' grid per power of two
BUCKETS = 40  # of a context's count: 0, 1, 2-3, 4-7 ...

START, STOP = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
_PLACE = np.random.default_rng(5).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values, and the place of each value among them."""
    codes, kinds = pd.factorize(x)
    order = np.argsort(kinds)
    place = np.empty(len(kinds), dtype=np.int64)
    place[order] = np.arange(len(kinds))
    return kinds[order], place[codes]


class Batch:
    """Tokens of a batch end to end, and for the orders from ``least`` its distinct n-grams."""

    def __init__(self, rows: pa.Table, order: int, least: int = 1):
        texts = [(x or "").encode("utf-8", "surrogatepass").lower() for x in rows.column("text").to_pylist()]
        self.held = np.array(rows.column("held").to_pylist(), dtype=bool)
        parts, lo = [], 0
        while lo < len(texts):  # about a megabyte at a time
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 1 << 20):
                size += len(texts[hi])
                hi += 1
            parts.append(word_hashes(texts[lo:hi]))
            lo = hi
        words = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
        counts = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
        self.size = counts + 2  # with a start and an end
        self.begin = np.cumsum(self.size) - self.size
        self.tokens = np.full(int(self.size.sum()), STOP, dtype=np.uint64)
        self.tokens[self.begin] = START
        inner = np.ones(len(self.tokens), dtype=bool)
        inner[self.begin] = False
        inner[self.begin + self.size - 1] = False
        self.tokens[inner] = words
        self.owner = np.repeat(np.arange(len(texts)), self.size)
        self.place = np.arange(len(self.tokens)) - self.begin[self.owner]
        self.least, self.grams, self.index = least, [None] * order, [None] * order
        for n in range(least, order + 1):
            self.grams[n - 1], self.index[n - 1] = distinct(self._ending(n))

    def _at(self, n: int) -> np.ndarray:
        """Positions where an n-gram ends; those of order 1 include the starts, as contexts."""
        return np.flatnonzero(self.place >= n - 1)

    def _ending(self, n: int) -> np.ndarray:
        at = self._at(n)
        if n == 1:
            return self.tokens
        with np.errstate(over="ignore"):
            out = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                out += self.tokens[at - k] * _PLACE[k]
            return mix(out) >> np.uint64(8)

    def counts(self, n: int) -> np.ndarray:
        """Training count of each distinct n-gram of the batch."""
        training = ~self.held[self.owner[self._at(n)]]
        return np.bincount(self.index[n - 1][training], minlength=len(self.grams[n - 1]))

    def shared(self, n: int, elsewhere: np.ndarray | None) -> np.ndarray:
        """Which distinct n-grams may occur in other batches: those whose two n-grams of one token less do."""
        out = np.ones(len(self.grams[n - 1]), dtype=bool)
        if n > 2:
            open_ = np.zeros(len(self.tokens), dtype=bool)
            open_[self._at(n - 1)] = elsewhere[self.index[n - 2]]
            at = self._at(n)
            out[self.index[n - 1]] = open_[at] & open_[at - 1]
        return out

    def spread(self, n: int, totals: np.ndarray) -> np.ndarray:
        """Total of the n-gram that ends at each position; 0 where there is none."""
        out = np.zeros(len(self.tokens), dtype=np.int64)
        out[self._at(n)] = totals[self.index[n - 1]]
        return out


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    b = (keys & np.uint64(buckets - 1)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cuts[k] < cuts[k + 1]:
            yield k, order[cuts[k] : cuts[k + 1]]


def _pack(x: np.ndarray) -> bytes:
    """Counts, most of them small: a byte each, those from 255 on spelled out."""
    large = np.flatnonzero(x >= 255)
    small = zlib.compress(np.minimum(x, 255).astype(np.uint8).tobytes(), 6)
    return len(small).to_bytes(4, "little") + small + zlib.compress(x[large].astype("<i8").tobytes(), 6)


def _unpack(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:4], "little")
    x = np.frombuffer(zlib.decompress(blob[4 : 4 + size]), np.uint8).astype(np.int64)
    x[x == 255] = np.frombuffer(zlib.decompress(blob[4 + size :]), "<i8")
    return x


_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("batch", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
_TOTALS = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("totals", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())])
_CELLS = pa.schema([("cell", pa.int64()), ("n", pa.int64())])
_SCORES = "doc_id long, held boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _sent(batch: Batch, key: int, n: int, which: np.ndarray, buckets: int) -> list[tuple]:
    grams, counts = batch.grams[n - 1][which], batch.counts(n)[which]
    return [(b, n, key, pack_sorted(grams[at], _width(n)), _pack(counts[at])) for b, at in by_bucket(grams, buckets)]


def _width(n: int) -> int:
    """Bytes of an n-gram's hash."""
    return 8 if n == 1 else 7


def _counting(order: int, buckets: int):
    """Counts of the orders that every batch sends whole."""

    def run(key, rows):  # without type hints: Spark would read them
        batch = Batch(rows, order)
        return _table([x for n in range(1, order + 1) for x in _sent(batch, key[0].as_py(), n, batch.shared(n, None), buckets)], _COUNTS)

    return run


def _counting_longer(n: int, buckets: int):
    """Counts of the n-grams that other batches may hold too."""

    def run(key, rows, told):
        if not rows.num_rows:  # of batch -1, see _summing
            return _table([], _COUNTS)
        batch = Batch(rows, n, 2)
        _, elsewhere = _totals(batch, told, n - 1, buckets)
        return _table(_sent(batch, key[0].as_py(), n, batch.shared(n, elsewhere), buckets), _COUNTS)

    return run


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and n: totals for each batch, and for batch -1, which has no texts, once per group the tokens and kinds."""
    for t, starts in by_group(batches, 2):
        for s, e in zip(starts, np.append(starts[1:], t.num_rows)):
            part = t.slice(s, e - s)
            width = _width(part.column("n")[0].as_py())
            grams = [unpack_sorted(x, width) for x in part.column("grams").to_pylist()]
            counts = np.concatenate([_unpack(x) for x in part.column("counts").to_pylist()])
            kinds, back = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(back, counts, len(kinds)).astype(np.int64)
            # 0 for an n-gram of one batch, which knows its total; the lowest bit tells that others sent it too
            told = np.where(np.bincount(back, minlength=len(kinds)) > 1, 2 * total + 1, 0)
            bucket, n = part.column("bucket")[0].as_py(), part.column("n")[0].as_py()
            rows = [(b, bucket, n, _pack(x), 0, 0) for b, x in zip(part.column("batch").to_pylist(), np.split(told[back], np.cumsum([len(g) for g in grams])[:-1]))]
            if n == 1:
                token = total[kinds != START]
                rows.append((-1, bucket, n, None, int(token.sum()), int((token > 0).sum())))
            yield from _table(rows, _TOTALS).to_batches()


def _totals(batch: Batch, told: pa.Table, order: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order of the batch the total of each distinct n-gram, as told, or the batch's own count if it was
    not sent; and which of the last order other batches sent too."""
    got = {(b, n): x for b, n, x in zip(*(told.column(c).to_pylist() for c in ("bucket", "n", "totals")))}
    out: list[np.ndarray] = []
    elsewhere = np.empty(0, dtype=bool)
    for n in range(batch.least, order + 1):
        which = np.flatnonzero(batch.shared(n, elsewhere))
        totals, elsewhere = batch.counts(n).astype(np.int64), np.zeros(len(batch.grams[n - 1]), dtype=bool)
        for b, at in by_bucket(batch.grams[n - 1][which], buckets):
            x = _unpack(got[b, n])
            totals[which[at]], elsewhere[which[at]] = np.where(x & 1, x >> 1, totals[which[at]]), x & 1
        out.append(totals)
    return out, elsewhere


def _told(batch: Batch, told: pa.Table, order: int, buckets: int) -> list[np.ndarray]:
    """Per order the total at each position."""
    return [batch.spread(n + 1, t) for n, t in enumerate(_totals(batch, told, order, buckets)[0])]


def _contexts(batch: Batch, totals: list[np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
    """How often the context of the n-gram that ends at each position was seen; 0 if it has none."""
    return np.where(batch.place[at] >= n - 1, totals[n - 2][at - 1], 0)


def bucket_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _cells(order: int, buckets: int):
    """Training tokens by cell: a mixed-radix number of (bucket, estimate) per order and the unigram.

    A token is left out of the counts that it is judged by. The sums of batch -1 come as cells -1
    (tokens) and -2 (kinds).
    """

    def run(key, rows, told):
        if not rows.num_rows:
            sums = [sum(told.column(c).to_pylist()) for c in ("tokens", "kinds")]
            return pa.Table.from_arrays([pa.array([-1, -2], pa.int64()), pa.array(sums, pa.int64())], schema=_CELLS)
        batch = Batch(rows, order)
        totals = _told(batch, told, order, buckets)
        at = np.flatnonzero((batch.place > 0) & ~batch.held[batch.owner])
        cell = np.zeros(len(at), dtype=np.int64)
        for n in range(order, 1, -1):
            context, gram = (np.maximum(x - 1, 0) for x in (_contexts(batch, totals, at, n), totals[n - 1][at]))
            seen = (context > 0) & (gram > 0)
            share = np.where(seen, np.rint(GRID * np.log2(np.maximum(context, 1) / np.maximum(gram, 1))) + 1, 0).astype(np.int64)
            cell = (cell * BUCKETS + bucket_of(context)) * 256 + np.minimum(share, 255)
        one = totals[0][at] - 1
        cell = cell * 256 + np.where(one > 0, np.rint(GRID * np.log2(np.maximum(one, 1))) + 1, 0).astype(np.int64)
        cells, n_ = np.unique(cell, return_counts=True)
        return pa.Table.from_arrays([pa.array(cells), pa.array(n_.astype(np.int64))], schema=_CELLS)

    return run


def mixture(order: int, weights: np.ndarray, buckets: list[np.ndarray], shares: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Probability of each row, and the part of each order in it (0: the even share).

    ``weights[n]`` holds the weight of order n by bucket; a context that was never seen passes all on.
    ``shares[n]`` is the estimate of order n, ``shares[0]`` the even share.
    """
    parts, left = [None] * (order + 1), np.ones(len(shares[0]))
    for n in range(order, 0, -1):
        w = weights[n][buckets[n]] if n > 1 else np.full(len(left), weights[1][0])
        if n > 1:
            w = np.where(buckets[n] > 0, w, 0.0)
        parts[n] = left * w * shares[n]
        left = left * (1 - w)
    parts[0] = left * shares[0]
    return sum(parts), parts


def first_weights(order: int) -> np.ndarray:
    return np.full((order + 1, BUCKETS), 0.5)


def learn(order: int, cells: np.ndarray, n: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    """EM: the share of the tokens of a bucket that stop at an order, of those that reach it."""
    weights = first_weights(order)
    weights[1] = 0.9
    if not len(cells) or not tokens:
        return weights
    rest = cells.copy()
    one = rest % 256
    rest //= 256
    shares = [np.full(len(cells), 1 / (kinds + 1)), np.where(one > 0, 2.0 ** ((one - 1) / GRID) / tokens, 0.0)]
    buckets = [None, None]
    for _ in range(2, order + 1):
        s = rest % 256
        rest //= 256
        shares.append(np.where(s > 0, 2.0 ** (-(s - 1) / GRID), 0.0))
        buckets.append(rest % BUCKETS)
        rest //= BUCKETS
    before = -np.inf
    for _ in range(ROUNDS):
        p, parts = mixture(order, weights, buckets, shares)
        p = np.maximum(p, 1e-300)
        for k in range(1, order + 1):
            stop, reach = n * parts[k] / p, n * sum(parts[: k + 1]) / p
            where = buckets[k] if k > 1 else np.zeros(len(cells), np.int64)
            up, down = (np.bincount(where, x, BUCKETS) for x in (stop, reach))
            weights[k] = np.where(down > 0, up / np.maximum(down, 1e-300), weights[k])
        weights[1] = np.clip(weights[1], 0.0, 1 - 1e-9)  # a token that was never seen keeps a share
        for k in range(2, order + 1):
            weights[k] = np.clip(weights[k], 0.0, 1 - 1e-6)
        now = float((n * np.log(p)).sum())
        if abs(now - before) <= STILL * abs(now):
            break
        before = now
    return weights


def _learning(order: int):
    def run(rows):
        cell, n = rows.column("cell").to_numpy(), rows.column("n").to_numpy()
        tokens, kinds = int(n[cell == -1].sum()), int(n[cell == -2].sum())
        order_ = np.argsort(cell[cell >= 0])
        weights = learn(order, cell[cell >= 0][order_], n[cell >= 0][order_], tokens, kinds)
        return _table([(0, 0, -1, weights.astype("<f8").tobytes(), tokens, kinds)], _TOTALS)

    return run


def _scoring(order: int, buckets: int):
    def run(key, rows, told):
        if not rows.num_rows:
            return _scores([], [], [], [], [], [], [])
        batch = Batch(rows, order)
        of = told.column("n").to_numpy()
        (model,) = told.filter(pa.array(of == -1)).to_pylist()
        totals = _told(batch, told.filter(pa.array(of > 0)), order, buckets)
        weights = np.frombuffer(model["totals"], "<f8").reshape(order + 1, BUCKETS)
        tokens, kinds = model["tokens"], model["kinds"]
        at = np.flatnonzero(batch.place > 0)
        one = totals[0][at]
        shares = [np.full(len(at), 1 / (kinds + 1)), one / max(tokens, 1)]
        where = [None, None]
        for n in range(2, order + 1):
            context = _contexts(batch, totals, at, n)
            where.append(bucket_of(context))
            shares.append(np.where(context > 0, totals[n - 1][at] / np.maximum(context, 1), 0.0))
        p, _ = mixture(order, weights if tokens else np.zeros_like(weights), where, shares)
        begin = np.cumsum(batch.size - 1) - (batch.size - 1)
        base = np.log10((one + ADD) / (tokens + ADD * (kinds + 1)))
        add = lambda x: np.add.reduceat(x, begin)
        return _scores(rows.column("doc_id"), batch.held, batch.size - 1, add((one > 0).astype(np.int64)), np.full(len(begin), tokens), add(base), add(np.log10(p)))

    return run


def _scores(ids, held, n, known, tokens, base, score) -> pa.Table:
    columns = [pa.array(held, pa.bool_()), *(pa.array(x, pa.int64()) for x in (n, known, tokens)), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
    return pa.Table.from_arrays([ids if isinstance(ids, pa.ChunkedArray) else pa.array(ids, pa.int64()), *columns], ["doc_id", "held", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, order: int = ORDER, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: doc_id, held, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = text.agg(F.sum(size).alias("n")).first()["n"] or 0
    buckets = 1 << max(0, int(np.ceil(np.log2(max(1, total / bucket_bytes)))))
    batches = max(1, -(-total // batch_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # null ids and ids of many rows are told apart by their texts
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")
    rows = text.select(batch, "doc_id", (crc_mod(F.col("doc_id"), HELD_OUT_MOD) == 0).alias("held"), "text")
    by_batch = rows.groupBy("batch")

    def summed(counts: DataFrame, orders: list[int]) -> DataFrame:
        place = F.col("bucket") * len(orders) + F.col("n") - orders[0]  # a task for each bucket and order
        dealt = counts.repartitionById(max(parts, buckets * len(orders)), place).sortWithinPartitions("bucket", "n", "batch")
        return dealt.mapInArrow(_summing, _sql(_TOTALS))

    def by(df: DataFrame) -> DataFrame:
        """Dealt by batch once; a union of such tables needs no further exchange."""
        return df.repartition(parts, "batch")

    whole = min(order, 2)
    sums = summed(by_batch.applyInArrow(_counting(whole, buckets), _sql(_COUNTS)), list(range(1, whole + 1)))
    totals = by(sums)
    for n in range(3, order + 1):
        longer = by_batch.cogroup(totals.groupBy("batch")).applyInArrow(_counting_longer(n, buckets), _sql(_COUNTS))
        totals = totals.union(by(summed(longer, [n])))
    cells = by_batch.cogroup(totals.groupBy("batch")).applyInArrow(_cells(order, buckets), _sql(_CELLS))
    grid = cells.groupBy("cell").agg(F.sum("n").alias("n"))
    model = grid.groupBy(F.lit(0).alias("all")).applyInArrow(lambda rows: _learning(order)(rows.select(["cell", "n"])), _sql(_TOTALS))
    every = model.select(F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), "bucket", "n", "totals", "tokens", "kinds")
    return by_batch.cogroup(totals.union(by(every)).groupBy("batch")).applyInArrow(_scoring(order, buckets), _SCORES)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).withColumnRenamed("held", "held_out")
