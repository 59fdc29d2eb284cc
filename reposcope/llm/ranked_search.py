"""Ranked lexical search: MaxScore tightened by bounds of term pairs.

Three tables follow one another, each written to the shared folder:

* ``index``: segments of about ``SLICE_BYTES`` of text, each with the documents' ids and lengths,
  all its terms and, per term, the documents that hold it and how often. It covers all rows and
  serves any queries.
* ``prepare``: for a block of the stated queries, each segment cut to their terms, occurrences
  turned into impacts, and an intersection list for each pair of terms that stand side by side in a
  query (ordered by weight): the documents that hold both, their joint scores, and the largest.
* ``search``: per segment and query, terms are taken in the order of weight. What the rest can add
  is bounded by the best combination of single maxima and pair bounds (the larger of the joint
  maximum and either single maximum: a document holds both, one or none). Once that bound is below
  the k-th best score known, no new document can enter; those at hand are bounded once more with the
  intersection lists (the joint score of a document that is listed, one single maximum else), and
  only the survivors are scored to the end. Known scores are those of the segment, of the task's
  segments before it, and the k-th joint scores of the pair lists.

Documents whose bound equals the k-th score stay, so ties are settled by id, and results are exact.
Each segment gives at most k rows per query; they are merged in two levels, by a hash of the
document first. Queries go to the tasks in blocks of bounded bytes (``BLOCK_BYTES`` of item text);
of their terms only the counts of documents come back to the driver.

Cases: null and empty texts have no term and are never found; they count in no statistic. Rows that
share a doc_id are documents of their own; items that share an item_id (null too) are one item with
the terms of all. Equal scores go by ascending id, null ids last. Items or documents without terms,
or empty tables, give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reposcope.llm.common import shared_folder, table, text_slices
from reposcope.llm.decontaminate import item_blocks, words_of

TOP = 50
#: bytes of text in a segment, and of item text that one search holds
SLICE_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20
#: parts in which an item's candidates are ranked before they are ranked together
PARTS = 64

SEGMENT = "doc_ids binary, null_ids binary, lengths binary, terms binary, ends binary, places binary, counts binary"
PREPARED = (
    "doc_ids binary, null_ids binary, terms binary, ends binary, places binary, scores binary, "
    "pairs binary, pair_ends binary, pair_places binary, pair_scores binary"
)


def _numbers(blob: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(blob, kind)


def _row(values: list, schema: str) -> pa.RecordBatch:
    blobs = [v if isinstance(v, bytes) else np.ascontiguousarray(v).tobytes() for v in values]
    return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], [f.split()[0] for f in schema.split(", ")])


def segment(ids: list[int | None], texts: list[str | None]) -> list:
    """The fields of ``SEGMENT`` for some documents; those without a term are left out."""
    seen: dict[bytes, int] = {}
    numbers, kept = [], []
    for doc_id, text in zip(ids, texts):
        words = words_of(text)
        if words:
            numbers.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
            kept.append(doc_id)
    n = max(len(kept), 1)
    lengths = np.array([len(x) for x in numbers], dtype="<i8")
    place = np.repeat(np.arange(len(kept)), lengths)
    cells, counts = np.unique((np.concatenate(numbers) if numbers else np.empty(0, np.int64)) * n + place, return_counts=True)
    ends = np.cumsum(np.bincount(cells // n, minlength=len(seen)))
    return [
        np.array([i or 0 for i in kept], dtype="<i8"), np.array([i is None for i in kept], dtype=bool), lengths,
        b"\n".join(seen), ends.astype("<i4"), (cells % n).astype("<i4"), counts.astype("<i4"),
    ]


def index(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Segments of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1, slice_bytes):
            yield _row(segment(b.column(0).to_pylist(), b.column(1).to_pylist()), SEGMENT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SEGMENT)


def corpus_size(segments: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = [_numbers(x, "<i8") for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in lengths]), pa.array([int(x.sum()) for x in lengths])], ["n", "l"])

    row = segments.select("lengths").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def document_counts(segments: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the terms occurs."""
    terms = segments.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for names, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sizes = np.diff(_numbers(ends), prepend=0)
                total.update({t: int(sizes[i]) for i, t in enumerate(names.split(b"\n")) if t in terms.value})
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["term", "df"])

    rows = segments.select("terms", "ends").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in rows.collect()}


class Queries:
    """A block of items: their terms by descending weight, and the pairs of neighbours."""

    def __init__(self, items: list[tuple[object, str | None]], df: dict[bytes, int], n: int, length: int):
        self.n, self.length = n, length
        self.weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
        terms: dict[object, set[bytes]] = {}
        for item, text in items:
            terms.setdefault(item, set()).update(t for t in words_of(text) if t in df)
        self.items = list(terms)
        self.terms = [sorted(terms[i], key=lambda t: (-self.weight[t], t)) for i in self.items]
        self.pairs = sorted({p for ts in self.terms for p in zip(ts, ts[1:])})


def impacts(counts: np.ndarray, lengths: np.ndarray, q: Queries) -> np.ndarray:
    """Scores of occurrences before the weight; all divisions round down."""
    m = 50 + 50 * lengths * q.n // q.length
    return 1_000_000_000 * counts // (1000 * counts + 20 * m)


def prepared(row: dict, q: Queries) -> list:
    """The fields of ``PREPARED`` for one segment."""
    lengths, ends = _numbers(row["lengths"], "<i8"), _numbers(row["ends"])
    places, counts = _numbers(row["places"]), _numbers(row["counts"])
    postings: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
    for i, t in enumerate(row["terms"].split(b"\n") if len(ends) else ()):
        if t in q.weight:
            cut = slice(ends[i - 1] if i else 0, ends[i])
            at = places[cut]
            postings[t] = at, q.weight[t] * impacts(counts[cut].astype(np.int64), lengths[at], q)
    number = {t: i for i, t in enumerate(postings)}
    pairs, pair_places, pair_scores = [], [], []
    first, own = None, np.full(len(lengths), -1, dtype=np.int64)
    for a, b in q.pairs:
        if a not in number or b not in number:
            continue
        if a != first:
            own[:] = -1
            own[postings[a][0]] = postings[a][1]
            first = a
        at, score = postings[b]
        both = own[at] >= 0
        if both.any():
            pairs += number[a], number[b]
            pair_places.append(at[both])
            pair_scores.append(own[at[both]] + score[both])
    joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    sizes = lambda parts: np.cumsum([len(p) for p in parts]).astype("<i4")
    at, scores = ([p[k] for p in postings.values()] for k in (0, 1))
    return [
        row["doc_ids"], row["null_ids"], b"\n".join(postings), sizes(at), joined(at, "<i4"), joined(scores, "<i8"),
        np.array(pairs, dtype="<i4"), sizes(pair_places), joined(pair_places, "<i4"), joined(pair_scores, "<i8"),
    ]


def prepare(segments: DataFrame, queries: Queries) -> DataFrame:
    held = segments.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield _row(prepared(row, held.value), PREPARED)

    return segments.mapInArrow(run, PREPARED)


class Segment:
    """A prepared segment, opened."""

    def __init__(self, row: dict):
        self.ids, self.null = _numbers(row["doc_ids"], "<i8"), _numbers(row["null_ids"], bool)
        self.places, self.scores = _parts(row["ends"], row["places"], row["scores"])
        self.term = {t: i for i, t in enumerate(row["terms"].split(b"\n"))} if len(self.places) else {}
        self.most = [int(s.max()) for s in self.scores]
        pairs = _numbers(row["pairs"]).reshape(-1, 2)
        self.pair = {(a, b): i for i, (a, b) in enumerate(pairs.tolist())}
        self.pair_places, self.pair_scores = _parts(row["pair_ends"], row["pair_places"], row["pair_scores"])
        self.joint = [int(s.max()) for s in self.pair_scores]
        self.sorted: dict[tuple[int, int], int] = {}

    def joint_rank(self, pair: int, k: int) -> int:
        """The k-th largest joint score of a pair, 0 if fewer documents hold it."""
        scores = self.pair_scores[pair]
        if len(scores) < k:
            return 0
        if (pair, k) not in self.sorted:
            self.sorted[pair, k] = int(np.partition(scores, len(scores) - k)[len(scores) - k])
        return self.sorted[pair, k]

    def rests(self, terms: list[int]) -> tuple[list[int], list[int | None]]:
        """What the terms from each one on can add at most, and the pair that opens that combination."""
        n = len(terms)
        rest, step = [0] * (n + 1), [None] * n
        for i in range(n - 1, -1, -1):
            rest[i] = self.most[terms[i]] + rest[i + 1]
            if i + 1 < n:
                a, b = self.most[terms[i]], self.most[terms[i + 1]]
                pair = self.pair.get((terms[i], terms[i + 1]))
                bound = max(a, b, self.joint[pair] if pair is not None else 0) + rest[i + 2]
                if bound < rest[i]:
                    rest[i], step[i] = bound, -1 if pair is None else pair
        return rest, step

    def top(self, words: list[bytes], k: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents that may be among the k best; ``known`` is a score that k reach."""
        terms = [self.term[w] for w in words if w in self.term]
        rest, step = self.rests(terms)
        least = max([known, *(self.joint_rank(p, k) for pair in zip(terms, terms[1:]) if (p := self.pair.get(pair)) is not None)])
        score = np.zeros(len(self.ids), dtype=np.int64)
        done = 0
        while done < len(terms) and rest[done] >= max(least, 1):
            score[self.places[terms[done]]] += self.scores[terms[done]]
            done += 1
            least = max(least, _kth(score, k))
        at = np.flatnonzero((score > 0) & (score + rest[done] >= least))
        have = score[at]
        if done < len(terms) and len(at):
            bound, i = have.copy(), done
            while i < len(terms):
                if step[i] is None:
                    bound += self.most[terms[i]]
                    i += 1
                else:
                    single = max(self.most[terms[i]], self.most[terms[i + 1]])
                    bound += single if step[i] < 0 else _looked_up(at, self.pair_places[step[i]], self.pair_scores[step[i]], single)
                    i += 2
            keep = bound >= least
            at, have = at[keep], have[keep]
        for i in range(done, len(terms)):
            have = have + _looked_up(at, self.places[terms[i]], self.scores[terms[i]], 0)
            least = max(least, _kth(have, k))
            keep = have + rest[i + 1] >= least
            at, have = at[keep], have[keep]
        keep = (have >= least) & (have > 0)
        return at[keep], have[keep]


def _parts(ends: bytes, places: bytes, scores: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    cuts = _numbers(ends)[:-1]
    if not len(ends):
        return [], []
    return np.split(_numbers(places), cuts), np.split(_numbers(scores, "<i8"), cuts)


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _looked_up(at: np.ndarray, places: np.ndarray, scores: np.ndarray, missing: int) -> np.ndarray:
    """The score of each place in a list that ascends by place."""
    i = np.minimum(np.searchsorted(places, at), len(places) - 1)
    return np.where(places[i] == at, scores[i], missing)


def best(places: np.ndarray, scores: np.ndarray, segment: Segment, k: int) -> np.ndarray:
    """Which k come first: by score, then id, null ids last."""
    return np.lexsort((segment.ids[places], segment.null[places], -scores))[:k]


def search(tables: DataFrame, queries: Queries, item_type, k: int = TOP) -> DataFrame:
    """(item_id, doc_id, score): at most k rows per segment and item, the k best of all among them."""
    held = tables.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, kind = held.value, to_arrow_type(item_type)
        reached = [np.empty(0, dtype=np.int64)] * len(q.items)
        for b in batches:
            for row in b.to_pylist():
                s = Segment(row)
                items, ids, scores = [], [], []
                for i, words in enumerate(q.terms):
                    at, have = s.top(words, k, _kth(reached[i], k))
                    chosen = best(at, have, s, k)
                    at, have = at[chosen], have[chosen]
                    reached[i] = np.sort(np.concatenate([reached[i], have]))[-k:]
                    items += [q.items[i]] * len(at)
                    ids += [None if null else x for x, null in zip(s.ids[at].tolist(), s.null[at].tolist())]
                    scores += have.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(items, kind), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    return tables.mapInArrow(run, f"item_id {item_type.simpleString()}, doc_id long, score long")


def ranked(found: DataFrame, k: int = TOP) -> DataFrame:
    """The k best rows of each item with their rank; parts by document first, so that no item is one big group."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    few = found.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order)))
    few = few.filter(F.col("_r") <= k).drop("_r", "_part")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        folder = shared_folder(spark, name)
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    segments = stored(index(docs, slice_bytes), "index")
    n, length = corpus_size(segments)
    item_type = items.schema["item_id"].dataType
    found = spark.createDataFrame([], f"item_id {item_type.simpleString()}, doc_id long, score long")
    for block in item_blocks(items, block_bytes):
        counts = document_counts(segments, {t for _, text in block for t in words_of(text)})
        queries = Queries(block, counts, n, length)
        found = found.unionAll(search(stored(prepare(segments, queries), "prepared"), queries, item_type, k))
    return ranked(found, k).select("item_id", "rank", "doc_id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
with d as (select r, doc_id, ws, len(ws) as n from (select row_number() over () as r, doc_id, {_TERMS} as ws from documents) where len(ws) > 0),
     s as (select count(*) as nn, cast(sum(n) as bigint) as ll from d),
     q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
     t as (select r, term, count(*) as tf from (select r, unnest(ws) as term from d) where term in (select term from q) group by 1, 2),
     w as (select term, cast(floor(1000 * ln(cast(2 * any_value(nn) + 2 as double) / (2 * count(*) + 1))) as bigint) as w from t, s group by 1),
     m as (select r, doc_id, 50 + (50 * n * nn) // ll as m from d, s),
     x as (select item_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
           from q join t using (term) join w using (term) join m using (r) group by 1, 2),
     o as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
           from x join d using (r) where score > 0)
select item_id, rank, doc_id, score from o where rank <= {TOP}
"""
