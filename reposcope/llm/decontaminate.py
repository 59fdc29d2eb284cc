"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A test string is a window of ten consecutive item words (a shorter item is one window). Per window
length there is one table: blocks of two words say how far the search may shift without missing a
window, blocks that end a window open a bucket of windows by their first block, and a direct
comparison of all words confirms an occurrence.

Items are sent to the tasks in blocks of bounded size; documents pass through one search per block,
so a benchmark of any size works and no document row is shuffled.

Cases: null or empty texts have no words; items without words have no window; repeated items and
documents are each treated as they come; an empty benchmark hits nothing; a null item_id counts as
the empty text. Other columns are passed over by ``scan`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import table

WINDOW = 10
#: bytes of item text that one search holds
BLOCK_BYTES = 16 << 20
#: letters are lower-cased, digits and all bytes of non-ASCII characters stay, the rest separates
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class WindowTable:
    """Shift table, suffix buckets and windows of one length."""

    def __init__(self, size: int):
        self.size, self.block = size, min(2, size)
        self.default = size - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}

    def key(self, words: list[bytes], end: int):
        return words[end] if self.block == 1 else (words[end - 1], words[end])

    def add(self, window: list[bytes], item: str) -> None:
        last = self.size - 1
        for end in range(self.block - 1, self.size):
            k = self.key(window, end)
            self.shift[k] = min(self.shift.get(k, self.default), last - end)
        bucket = self.buckets.setdefault(self.key(window, last), {})
        same_start = bucket.setdefault(self.key(window, self.block - 1), {})
        same_start.setdefault(tuple(window), set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(first word, items) of each occurrence."""
        size, default, shift, pair, n = self.size, self.default, self.shift.get, self.block == 2, len(words)
        end = size - 1
        while end < n:
            skip = shift((words[end - 1], words[end]) if pair else words[end], default)
            if skip:
                end += skip
                continue
            start = end - size + 1
            windows = self.buckets[self.key(words, end)].get(self.key(words, start + self.block - 1))
            if windows and (items := windows.get(tuple(words[start : end + 1]))):
                yield start, items
            end += 1


def build_tables(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> list[WindowTable]:
    tables: dict[int, WindowTable] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for start in range(len(words) - size + 1 if size else 0):
            tables.setdefault(size, WindowTable(size)).add(words[start : start + size], "" if item is None else str(item))
    return list(tables.values())


def find(words: list[bytes], tables: list[WindowTable]) -> tuple[set[int], set[str]]:
    """Positions of hit words, and items with an occurring window."""
    hit: set[int] = set()
    found: set[str] = set()
    for t in tables:
        for start, items in t.search(words):
            hit.update(range(start, start + t.size))
            found |= items
    return hit, found


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in parts of about ``block_bytes``, one part on the driver at a time."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    for k in range(n):
        yield [(r[0], r[1]) for r in items.filter(part == k).collect()]


SCHEMA = "text string, n_words long, hits array<int>, items array<string>"


def _searching(items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = build_tables(items.value)
        for batch in batches:
            counts, hits, found = [], [], []
            for text, h, f in zip(*(c.to_pylist() for c in batch.columns[1:2] + batch.columns[3:5])):
                words = words_of(text)
                hit, its = find(words, tables)
                counts.append(len(words))
                hits.append(sorted(hit.union(h)) if hit or h else [])
                found.append(sorted(its.union(f)) if its or f else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
                ["doc_id", "text", "n_words", "hits", "items"],
            )

    return run


def scan(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, hits (positions of hit words), items (ids, sorted as strings)."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    for block in item_blocks(benchmark, block_bytes):
        out = out.mapInArrow(_searching(sc.broadcast(block)), f"doc_id {kind}, {SCHEMA}")
    return out.drop("text")


def _cleaning(items, text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = build_tables(items.value)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            yield batch.filter(pa.array([not find(words_of(t), tables)[0] for t in texts], pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    sc, at = docs.sparkSession.sparkContext, docs.columns.index("text")
    out = docs
    for block in item_blocks(benchmark, block_bytes):
        out = out.mapInArrow(_cleaning(sc.broadcast(block), at), docs.schema)
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
with d as (select doc_id, {_WORDS} as ws from documents),
     b as (select item_id, {_WORDS} as ws from benchmark),
     m as (select item_id, ws, least({WINDOW}, len(ws)) as size from b where len(ws) > 0),
     bw as (select distinct item_id, size, ws[i:i + size - 1] as win
            from (select item_id, size, ws, unnest(range(1, len(ws) - size + 2)) as i from m)),
     dw as (select doc_id, size, i, ws[i:i + size - 1] as win
            from (select doc_id, size, ws, unnest(range(1, len(ws) - size + 2)) as i
                  from d, (select distinct size from bw) s where len(ws) >= size)),
     h as (select doc_id, dw.size, i, item_id from dw join bw on dw.win = bw.win),
     p as (select doc_id, count(distinct j) as n_hit
           from (select doc_id, unnest(range(i, i + size)) as j from (select distinct doc_id, size, i from h)) group by 1),
     t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
           from (select distinct doc_id, cast(item_id as varchar) as item from h) group by 1)
select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (doc_id) left join t using (doc_id)
"""
