"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text becomes its set of five-word shingles (64-bit hashes). Texts with equal sets are one
   class member from here on: the one with the smallest id stands for them.
2. MinHash values are banded; members that agree in a band are candidates. A task takes the members
   of a band bucket with their MinHash values, compares pairs sixteen values at a time, and drops a
   pair once the posterior probability (uniform prior) that it reaches the threshold is below
   ``TOLERANCE``. Of what is left, a spanning forest per bucket is enough to form clusters.
3. In each cluster all pairs are verified exactly on the shingle sets, in blocks of members: a task
   gets two blocks. It returns counts of links per member and a spanning forest of the links, so no
   row is ever made per pair.

With 32 bands of 4 values a pair at exactly 0.8 shares no band with probability 5e-8, the pruning
loses it with about 1e-6, and every pair within a cluster is compared, found in a bucket or not.

Cases: texts of one to four words have one shingle, texts without words have none and link to
nothing (each is a class of its own); a null text is empty; a null id counts as the largest id; ids
may be negative. Every row is a document of its own, whatever id it shares: it is judged by its own
text, and rows alike in id and text are judged alike (each counts as a link of the other). Of such
rows in the lead of a class ``keep_one`` keeps all. Other columns are ignored by ``classes`` and kept
by ``keep_one``. Members are nodes by 64 bits of their print: of n different texts any two share a
node, and so a class, with a probability of n^2/2^65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import SEPARATORS, shared_folder, table
from reposcope.llm.components import components
from reposcope.llm.shingles import mix, shingle_sets

WORDS = 5
SIMILARITY = Fraction(4, 5)
VALUES, ROWS, STEP = 128, 4, 16
TOLERANCE = 1e-6
#: members, and shingles, that a task holds of each of two blocks
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
NO_ID = (1 << 63) - 1

_SEED = np.random.default_rng(77).integers(0, 1 << 63, (2, VALUES), dtype=np.uint64)
_TIMES, _PLUS = _SEED[0] | np.uint64(1), _SEED[1]


# ---- MinHash and pruning -----------------------------------------------------------------
def minhash(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts with shingles) x VALUES, sixteen bits each; only rows with counts > 0."""
    counts = counts[counts > 0]
    out = np.empty((len(counts), VALUES), dtype=np.uint16)
    ends = np.cumsum(counts)
    # slices that stay in the processor's cache
    cut = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, 16_384), side="left")
    cut = np.unique(np.concatenate([cut, [len(counts)]]))
    first = 0
    for last in cut[cut > 0]:
        lo, hi = ends[first] - counts[first], ends[last - 1]
        x, starts = sets[lo:hi], ends[first:last] - counts[first:last] - lo
        with np.errstate(over="ignore"):
            for k in range(VALUES):
                low = np.minimum.reduceat((x * _TIMES[k] + _PLUS[k]) >> np.uint64(24), starts)
                out[first:last, k] = (low ^ (low >> np.uint64(16))) & np.uint64(0xFFFF)
        first = last
    return out


def least_matches(similarity: float = float(SIMILARITY), tolerance: float = TOLERANCE) -> list[int]:
    """By number of values compared: the fewest matches that leave a pair in.

    With a uniform prior, the posterior probability of at least ``similarity`` after m matches of n
    is the probability of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(VALUES + 1):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


_LEAST = least_matches()


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the row pairs that no step of the comparison drops."""
    left = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int16)
    for n in range(0, VALUES, STEP):
        matches += (a[left, n : n + STEP] == b[left, n : n + STEP]).sum(axis=1, dtype=np.int16)
        stay = matches >= _LEAST[n + STEP]
        left, matches = left[stay], matches[stay]
    return left


def forest(sig: np.ndarray, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the surviving pairs; with ``left`` only pairs across its two values."""
    n, out = len(sig), []
    open_ = np.arange(n)
    while len(open_):
        frontier, open_ = [int(open_[0])], open_[1:]
        while frontier and len(open_):
            i = frontier.pop()
            near = open_ if left is None else open_[left[open_] != left[i]]
            if not len(near):
                continue
            hit = near[survivors(np.broadcast_to(sig[i], (len(near), VALUES)), sig[near])]
            if len(hit):
                out += [(i, int(j)) for j in hit]
                frontier += hit.tolist()
                open_ = np.setdiff1d(open_, hit, assume_unique=True)
    return out


# ---- groups within sorted partitions -----------------------------------------------------
def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows with equal first ``keys`` columns, sorted) and their starts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        now = pa.Table.from_batches(held).combine_chunks() if len(held) > 1 else pa.Table.from_batches(held)
        starts = _starts(now, keys)
        if len(starts) > 1:
            yield now.slice(0, int(starts[-1])), starts[:-1]
            held = now.slice(int(starts[-1])).to_batches()
        else:
            held = now.to_batches()
    if held:
        now = pa.Table.from_batches(held)
        yield now, _starts(now, keys)


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for k in range(keys):
        c = t.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _blob_matrix(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


# ---- steps -------------------------------------------------------------------------------
def _profiling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            sets, counts = shingle_sets(b.column(1).to_pylist(), WORDS)
            has = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[has]
            with np.errstate(over="ignore"):
                prints = [np.add.reduceat(mix(sets + np.uint64(s)), starts).view(np.int64) if len(has) else np.empty(0, np.int64) for s in (1, 2)]
            sig = minhash(sets, counts)
            key = [b.column(k).take(pa.array(has)) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays(
                [*key, pa.array(prints[0]), pa.array(prints[1]), pa.array(counts[has]), pa.array([x.tobytes() for x in sig], pa.binary())],
                ["doc_id", "t", "p", "q", "n", "sig"],
            )


def _row_key() -> list[Column]:
    """What tells rows apart: the id and a hash of the text."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")]


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, t, p, q, n, sig): hash of the text, print of its shingle set, the set's size, MinHash
    values; no row without words."""
    doc_id, t = _row_key()
    return docs.select(doc_id, "text", t).mapInArrow(_profiling, "doc_id long, t long, p long, q long, n long, sig binary")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, blk, id, sig) sorted by key, i, j: edges (u, v) of a forest per group."""
    for t, starts in by_group(batches, 3):
        ids = t.column("id").to_numpy()
        sig = _blob_matrix(t.column("sig"), np.uint16, VALUES)
        i, blk, j = (t.column(c).to_numpy() for c in ("i", "blk", "j"))
        sizes = np.diff(np.append(starts, len(ids)))
        u, v = [], []
        small = (sizes <= 8) & (i[starts] == j[starts])
        for n in np.unique(sizes[small]):
            if n < 2:
                continue
            a, b = np.triu_indices(n, 1)
            s = starts[small & (sizes == n)]
            a, b = (s[:, None] + a).ravel(), (s[:, None] + b).ravel()
            for lo in range(0, len(a), 8192):
                k = survivors(sig[a[lo : lo + 8192]], sig[b[lo : lo + 8192]]) + lo
                u.append(ids[a[k]])
                v.append(ids[b[k]])
        for s, n in zip(starts[~small], sizes[~small]):
            across = None if i[s] == j[s] else blk[s : s + n]
            edges = np.array(forest(sig[s : s + n], across), dtype=np.int64).reshape(-1, 2) + s
            u.append(ids[edges[:, 0]])
            v.append(ids[edges[:, 1]])
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (u, v))
        if len(u):
            pair = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["u", "v"])


def _in_pairs_of_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Each row once per pair (i, j) of blocks that its block ``blk`` of ``nb`` is in."""
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    return rows.withColumn("o", other).withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o")).drop("o", "nb")


def _dealt(rows: DataFrame, key: str, *last: str) -> DataFrame:
    """Groups (key, i, j) whole and sorted within partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key, "i", "j").sortWithinPartitions(key, "i", "j", "id").select(key, "i", "j", "blk", "id", *last)


def _block_of(nb: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(5)), nb).cast("int")


def candidate_edges(members: DataFrame) -> DataFrame:
    """Edges of the clusters: forests of the pairs that share a band and survive the comparison."""
    # the sixteen-bit values of a band in one long, and the band's number in the hash
    width = ROWS * 2
    bands = F.transform(F.sequence(F.lit(0), F.lit(VALUES // ROWS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * width + 1, F.lit(width))))
    keyed = members.select("id", F.explode(bands).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    shared = shared.select(F.col("key").alias("k"), F.ceil(F.col("c") / BLOCK).cast("int").alias("nb")).hint("rebalance")
    rows = keyed.join(shared, F.col("key") == F.col("k")).select("key", "nb", "id")
    found = rows.join(members.select(F.col("id").alias("m"), "sig"), F.col("id") == F.col("m")).select("key", "id", "sig", "nb", _block_of(F.col("nb")).alias("blk"))
    return _dealt(_in_pairs_of_blocks(found, "key"), "key", "sig").mapInArrow(_candidates, "u long, v long")


def links_between(a: list[np.ndarray], b: list[np.ndarray], similarity: Fraction = SIMILARITY) -> np.ndarray:
    """Which of a's sets reach the similarity with which of b's, from exact intersections."""
    na, nb = len(a), len(b)
    every = [*a, *b]
    sizes = np.array([len(x) for x in every], dtype=np.int64)
    owner = np.repeat(np.arange(na + nb), sizes)
    values, column, seen = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    common = seen[column] > 1
    owner, column = owner[common], column[common]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    # columns in strips: a strip of the incidence matrix has at most four million cells
    strip = max(64, (4 << 20) // (na + nb))
    both = np.zeros((na, nb), dtype=np.float32)
    if len(column):
        dense = np.cumsum(np.diff(column, prepend=column[0]) != 0)
        cuts = np.searchsorted(dense, np.arange(0, dense[-1] + strip + 1, strip))
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                m = np.zeros((na + nb, int(dense[hi - 1] - dense[lo]) + 1), dtype=np.float32)
                m[owner[lo:hi], dense[lo:hi] - dense[lo]] = 1
                both += m[:na] @ m[na:].T
    p, q = similarity.numerator, similarity.denominator
    return (p + q) * both.astype(np.int64) >= p * (sizes[:na, None] + sizes[None, na:])


def _verifying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, i, j, blk, id, copies, set): the links of each member here, and a forest of them."""
    for t, starts in by_group(batches, 3):
        ids, copies, i, j, blk = (t.column(c).to_numpy() for c in ("id", "copies", "i", "j", "blk"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        u, v, links, edge = [], [], [], []

        def told(a: np.ndarray, b: np.ndarray, n: np.ndarray, is_edge: bool) -> None:
            u.append(a), v.append(b), links.append(n), edge.append(np.full(len(a), is_edge))

        for s, e in zip(starts, np.append(starts[1:], len(ids))):
            rows = np.arange(s, e)
            rows = rows[np.diff(ids[s:e], prepend=ids[s]).astype(bool) | (rows == s)]  # rows alike in id and text bring a member twice
            one, two = (rows, rows) if i[s] == j[s] else (rows[blk[rows] == i[s]], rows[blk[rows] == j[s]])
            if len(rows) < 2 or not len(one) or not len(two):
                continue
            hit = links_between([sets[k] for k in one], [sets[k] for k in two])
            if one is two:
                np.fill_diagonal(hit, False)
            sides = [(one, two, hit)] if one is two else [(one, two, hit), (two, one, hit.T)]
            for x, y, h in sides:
                some = h.any(axis=1)
                told(ids[x[some]], ids[x[some]], h[some] @ copies[y], False)
            pairs = np.array(_spanning(hit, one is two), dtype=np.int64).reshape(-1, 2)
            told(ids[one[pairs[:, 0]]], ids[two[pairs[:, 1]]], np.zeros(len(pairs), np.int64), True)
        if u:
            columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (u, v, links)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(edge))], ["u", "v", "links", "edge"])


def _spanning(hit: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Pairs (row, column) that connect what ``hit`` connects, fewer than rows and columns."""
    na, nb = hit.shape
    out, open_a, open_b = [], np.ones(na, bool), np.ones(nb, bool)
    for root in range(na):
        if not open_a[root]:
            continue
        open_a[root] = False
        if same:
            open_b[root] = False
        todo = [(root, True)]
        while todo:
            x, row = todo.pop()
            near = np.flatnonzero(hit[x] & open_b) if row else np.flatnonzero(hit[:, x] & open_a)
            for y in near.tolist():
                out.append((x, y) if row else (y, x))
                todo.append((y, same or not row))
            (open_b if row else open_a)[near] = False
            if same:
                open_a[near] = False
    return out


def _setting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets, counts = shingle_sets(b.column(1).to_pylist(), WORDS)
        parts = np.split(sets, np.cumsum(counts)[:-1]) if len(counts) else []
        yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array([x.tobytes() for x in parts], pa.binary())], [b.schema.names[0], *b.schema.names[2:], "set"])


def verified(docs: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """(u, v, links, edge): the links of member u in a pair of blocks (v is u), or an edge of the forest."""
    inside = clusters.union(clusters.select("v", "v").distinct()).select(F.col("u").alias("m"), F.col("v").alias("cluster"))
    known = inside.join(members.select("id", "n", "copies", "row"), F.col("m") == F.col("id")).drop("m")
    size = known.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("w") / BLOCK_SHINGLES)).cast("int")
    placed = known.join(size.select(F.col("cluster").alias("k"), blocks.alias("nb")).hint("rebalance"), F.col("cluster") == F.col("k")).drop("k")
    doc_id, t = _row_key()
    texts = docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("_id"), t.alias("_t"), "text")
    rows = placed.join(texts, (F.col("row.id") == F.col("_id")) & (F.col("row.t") == F.col("_t"))).select("id", "text", "cluster", "copies", "nb", "n")
    sets = rows.mapInArrow(_setting, "id long, cluster long, copies long, nb int, n long, set binary")
    sets = sets.select("id", "cluster", "copies", "nb", "set", _block_of(F.col("nb")).alias("blk"))
    return _dealt(_in_pairs_of_blocks(sets, "cluster"), "cluster", "copies", "set").mapInArrow(_verifying, "u long, v long, links long, edge boolean")


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, t, class_id, lead, n_links, n_copies) per row that has words; t is a hash of the text.

    class_id is the smallest id that links lead to (a null id is ``NO_ID``), and lead the smallest t of
    that id in the class; n_links counts the other documents at the similarity or more, of which
    n_copies have the same shingle set.
    """
    rows = _stored(profiles(docs), "profiles")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("t").alias("t")))
    members = rows.groupBy("p", "q").agg(first.alias("row"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    members = _stored(members.withColumn("id", F.col("p")), "members")
    clusters = components(candidate_edges(members))
    found = _stored(verified(docs, members, clusters), "links")
    roots = components(found.filter("edge").select("u", "v"))
    links = found.filter("not edge").groupBy("u").agg(F.sum("links").alias("links")).select(F.col("u").alias("l"), "links")
    # only members with a link or a copy have more to say than that they stand alone
    linked = members.select("id", "p", "q", "copies", "row").join(links, F.col("id") == F.col("l"), "left").filter("links > 0 or copies > 1")
    linked = linked.join(roots.select(F.col("u").alias("r"), F.col("v").alias("root")), F.col("id") == F.col("r"), "left")
    linked = linked.select("p", "q", "row", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "p").alias("root"))
    least = linked.groupBy("root").agg(F.min("row").alias("lead")).select(F.col("root").alias("k"), "lead").hint("rebalance")
    told = linked.join(least, F.col("root") == F.col("k")).select(F.col("p").alias("mp"), F.col("q").alias("mq"), "lead", "links", "copies")
    # dealt evenly for the join: one class may have very many rows
    out = rows.select("doc_id", "t", "p", "q").join(told.hint("rebalance"), (F.col("p") == F.col("mp")) & (F.col("q") == F.col("mq")), "left")
    copies = F.coalesce("copies", F.lit(1)) - 1
    own = F.coalesce("doc_id", F.lit(NO_ID))
    class_id, lead = F.coalesce("lead.id", own).alias("class_id"), F.coalesce("lead.t", "t").alias("lead")
    return out.select("doc_id", "t", class_id, lead, (F.coalesce("links", F.lit(0)) + copies).alias("n_links"), copies.alias("n_copies"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each class, that of the smallest id, with all their columns.

    Of several with that id (or none) the one with the smallest hash of the text stays, with the rows
    that are alike in both.
    """
    own = F.coalesce("doc_id", F.lit(NO_ID))
    surplus = classes(docs).filter((F.col("class_id") != own) | (F.col("lead") != F.col("t"))).select(own.alias("_i"), F.col("t").alias("_h")).distinct()
    doc_id, t = _row_key()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(doc_id, F.lit(NO_ID)).alias("_id"), t.alias("_t"))
    return whole.join(surplus, (F.col("_id") == F.col("_i")) & (F.col("_t") == F.col("_h")), "left_anti").select("_row.*")


def join(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, class_id, n_links, n_copies (documents without words stand alone)."""
    kind = docs.schema["doc_id"].dataType
    silent = F.btrim(F.coalesce("text", F.lit("")), F.lit(SEPARATORS)) == ""
    none = F.lit(0).cast("long")
    alone = docs.filter(silent).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("class_id"), none.alias("n_links"), none.alias("n_copies"))
    told = classes(docs).select("doc_id", "class_id", "n_links", "n_copies").union(alone)
    return told.withColumn("doc_id", F.col("doc_id").cast(kind))


_P, _Q = SIMILARITY.numerator, SIMILARITY.denominator
OP5_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
     s as (select distinct doc_id, sh from (select doc_id, unnest(
             case when len(ws) >= {WORDS} then list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' '))
                  when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w)),
     n as (select doc_id, count(*) as n from s group by 1),
     c as (select x.doc_id as a, y.doc_id as b, count(*) as shared_n from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2),
     l as (select a, b, shared_n = na.n and shared_n = nb.n as same from c join n na on na.doc_id = a join n nb on nb.doc_id = b
           where {_P + _Q} * shared_n >= {_P} * (na.n + nb.n)),
     r(doc_id, root) as (select doc_id, doc_id from documents union select l.b, r.root from r join l on l.a = r.doc_id),
     k as (select doc_id, min(root) as class_id from r group by 1),
     m as (select a as doc_id, count(*) as n_links, count(*) filter (where same) as n_copies from l group by 1)
select doc_id, class_id, coalesce(n_links, 0) as n_links, coalesce(n_copies, 0) as n_copies from k left join m using (doc_id)
"""


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
