"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q and at least max(6, 4q) words that no
neighbouring word extends. At scale B (a power of two) a text is cut into blocks of B words, and
each block is looked for at distances B..2B-1, in the window that follows it: the sum of squared
differences of word numbers at each distance, by exact number-theoretic transforms modulo one or
two primes, is zero where the block occurs again. A run of period q in [B, 2B) holds two whole
blocks that recur at distance q, so each run has a seed (block, distance) at its own scale; a seed
is extended to both sides by comparing the words q apart, which also confirms it.

Two exact rules leave out transforms that cannot bring a new run: a block with a word that does not
recur within less than 2B words occurs nowhere in its window; and a block whose window lies inside
a run of a period of at most B recurs there at multiples of that period only, which is that run.

Texts are split among tasks by Spark and handled in slices of bounded bytes; transforms run over
``CELLS`` numbers at a time. One text is one group, its time n log^2 n in its words whatever they are.

Cases: null and empty texts have no words, hence no run, null run fields and digests of the empty
text; repeated rows count each; a null id counts as the empty text in the stand-in rule of ``op13``.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import table, text_slices

SLICE_BYTES = 4 << 20
#: numbers in one round of transforms
CELLS = 1 << 20
LEAST, POWER = 6, 4
#: primes k * 2^m + 1 with a generator: transforms of up to 2^26 words
PRIMES = ((2013265921, 31), (469762049, 3))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, in order of first appearance."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _roots(size: int, prime: int, generator: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the primitive root for each half length, from 1 to size/2."""
    out, half = [], 1
    while half < size:
        root = pow(generator, (prime - 1) // (2 * half), prime)
        step = np.array([1], dtype=np.uint64)
        base = pow(root, -1, prime) if inverse else root
        while len(step) < half:  # doubling: the powers k.. are the first ones times base^k
            step = np.concatenate([step, step * np.uint64(pow(base, len(step), prime)) % np.uint64(prime)])
        out.append(step)
        half *= 2
    return out


def _forward(x: np.ndarray, roots: list[np.ndarray], p: np.uint64) -> np.ndarray:
    """Transform of each row, in bit-reversed order."""
    rows, size = x.shape
    for r in reversed(roots):
        v = x.reshape(rows, size // (2 * len(r)), 2, len(r))
        a, b = v[:, :, 0], v[:, :, 1]
        total, rest = (a + b) % p, (a + (p - b)) * r % p if len(r) == 1 else (a + (p - b)) % p * r % p
        v[:, :, 0], v[:, :, 1] = total, rest
    return x


def _backward(x: np.ndarray, roots: list[np.ndarray], p: np.uint64) -> np.ndarray:
    """Inverse of ``_forward`` with inverse roots, times the length."""
    rows, size = x.shape
    for r in roots:
        v = x.reshape(rows, size // (2 * len(r)), 2, len(r))
        a, b = v[:, :, 0].copy(), v[:, :, 1] * r % p
        v[:, :, 0], v[:, :, 1] = (a + b) % p, (a + (p - b)) % p
    return x


def _differences(blocks: np.ndarray, windows: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Per row and distance the sum of squared differences of block and window part, modulo the prime."""
    rows, size = windows.shape
    b, p = size // 2, np.uint64(prime)
    forward, backward = (_roots(size, prime, generator, inverse) for inverse in (False, True))
    w = windows.astype(np.uint64) % p
    own = blocks.astype(np.uint64) % p
    squares = np.cumsum(np.concatenate([np.zeros((rows, 1), np.uint64), w * w % p], axis=1), axis=1)
    sliding = (squares[:, b : 2 * b] - squares[:, :b]) % p
    turned = np.zeros((rows, size), np.uint64)  # the block backwards: a product is then a correlation
    turned[:, 0], turned[:, size - b + 1 :] = own[:, 0], own[:, :0:-1]
    product = _forward(turned, forward, p) * _forward(w, forward, p) % p
    cross = _backward(product, backward, p)[:, :b] * np.uint64(pow(size, -1, prime)) % p
    return ((own * own % p).sum(axis=1, keepdims=True) + sliding + np.uint64(2) * (p - cross)) % p


def occurrences(a: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of the zero-mismatch occurrences of blocks at distances block..2*block-1.

    One prime is enough where the sums stay below it; else two, whose product they stay below for
    texts of up to a few million different words; beyond that a false zero is possible, and harmless,
    as seeds are compared word by word.
    """
    padded = np.concatenate([a, np.full(3 * block, a.max() + 1 if len(a) else 0)])
    primes = PRIMES[: 1 if float(padded.max()) ** 2 * block < PRIMES[0][0] else 2]
    found_at, found_by = [], []
    per = max(1, CELLS // (2 * block))
    for lo in range(0, len(starts), per):
        part = starts[lo : lo + per]
        blocks = padded[part[:, None] + np.arange(block)]
        windows = padded[part[:, None] + np.arange(block, 3 * block)]
        live = np.arange(len(part))
        zero = np.ones((len(part), block), dtype=bool)
        for prime, generator in primes:
            zero[live] &= _differences(blocks[live], windows[live], prime, generator) == 0
            live = np.flatnonzero(zero.any(axis=1))
            if not len(live):
                break
        row, distance = np.nonzero(zero)
        found_at.append(part[row])
        found_by.append(distance + block)
    return (np.concatenate(found_at), np.concatenate(found_by)) if found_at else (starts, starts)


class _Cover:
    """For each place the run that reaches furthest among those that start at or before it."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        runs = sorted(runs)
        self.start = np.array([r[0] for r in runs], dtype=np.int64)
        ends = np.array([r[1] for r in runs], dtype=np.int64)
        self.end = np.maximum.accumulate(ends) if len(runs) else ends
        best = np.maximum.accumulate(np.where(ends == self.end, np.arange(len(runs)), 0)) if len(runs) else ends
        self.period = np.array([r[2] for r in runs], dtype=np.int64)[best]

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The period of the run that holds [lo, hi), 0 without one."""
        if not len(self.start):
            return np.zeros(len(lo), dtype=np.int64)
        i = np.searchsorted(self.start, lo, "right") - 1
        return np.where((i >= 0) & (self.end[i] >= hi), self.period[i], 0)


def runs_of(a: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of a sequence of numbers as (start, length, period), by start, then period."""
    n = len(a)
    if n < LEAST:
        return []
    order = np.argsort(a, kind="stable")
    following = np.full(n, n, dtype=np.int64)  # how far the same word comes next, n for nowhere
    same = a[order[1:]] == a[order[:-1]]
    following[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs: dict[tuple[int, int], int] = {}
    block = 1
    while POWER * block <= n:
        whole = n // block
        starts = np.arange(whole) * block
        furthest = following[: whole * block].reshape(whole, block).max(axis=1) if block > 1 else following[:whole]
        starts = starts[furthest < 2 * block]
        if len(starts):
            cover = _Cover([(s, e, q) for (s, e), q in runs.items()])
            inside = cover.of(starts, np.minimum(starts + 3 * block, n))
            starts = starts[inside == 0]
        if len(starts):
            at, by = occurrences(a, starts, block)
            period = cover.of(at, at + by + block)
            new = (period == 0) | (by % np.maximum(period, 1) != 0)
            for start, end, q in _extended(a, at[new], by[new], block):
                if (start, end) not in runs:  # a smaller period of the same stretch was found before
                    runs[start, end] = q
        block *= 2
    return sorted((s, e - s, q) for (s, e), q in runs.items())


def _extended(a: np.ndarray, at: np.ndarray, by: np.ndarray, block: int) -> Iterator[tuple[int, int, int]]:
    """The longest stretches of at least max(6, 4q) words that hold a seed, smaller periods first."""
    n = len(a)
    order = np.lexsort((at, by))
    at, by = at[order], by[order]
    seen: dict[tuple[int, int], int] = {}
    known = 0
    cover = _Cover([])
    for lo, hi in zip(*_groups(by)):
        q = int(by[lo])
        if len(seen) > known:
            known, cover = len(seen), _Cover([(s, e, p) for (s, e), p in seen.items()])
        places = at[lo:hi]
        inside = cover.of(places, places + q + block)
        places = places[(inside == 0) | (q % np.maximum(inside, 1) != 0)]
        reach = -1
        for x in places.tolist():
            if x < reach:  # lies in the stretch just found
                continue
            left, right = _stretch(a, x, q)
            reach = max(right, x + 1)
            start, end = left, right + q
            if right - x >= block and end - start >= max(LEAST, POWER * q) and end <= n:
                if (start, end) not in seen:
                    seen[start, end] = q
                    yield start, end, q


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.diff(x, prepend=-1))
    return starts, np.append(starts[1:], len(x)) if len(x) else starts


def _stretch(a: np.ndarray, x: int, q: int) -> tuple[int, int]:
    """The longest [left, right) around x in which a word equals the one q further on."""
    right, step, n = x, 64, len(a) - q
    while right < n:
        part = a[right : min(right + step, n)] != a[right + q : min(right + step, n) + q]
        if part.any():
            right += int(part.argmax())
            break
        right += len(part)
        step *= 2
    left, step = x, 64
    while left > 0:
        lo = max(left - step, 0)
        part = (a[lo:left] != a[lo + q : left + q])[::-1]
        if part.any():
            left -= int(part.argmax())
            break
        left, step = lo, step * 2
    return left, right


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length/period, compared exactly; ties go to the smaller start, then period."""
    best = None
    for start, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (start, length, q)
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those in no run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def stand_in(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a repeated tail, for a tenth of the ids: the input that the query is stated on."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def summary(words: list[bytes]) -> tuple:
    """The values of ``SCHEMA`` for one text."""
    runs = runs_of(numbered(words))
    best = best_run(runs)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = kept_words(len(words), runs) if runs else None
    rest = words if kept is None else [words[i] for i in np.flatnonzero(kept)]
    fields = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *fields, _sha(listed.encode()), _sha(b" ".join(rest))


def detect(docs: DataFrame, prepare=None) -> DataFrame:
    """Per document row: doc_id and ``SCHEMA``; ``prepare(words, doc_id)`` may replace the words first."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))]
        types = [pa.int64()] * 5 + [pa.string()] * 2
        for b in text_slices(batches, 1, SLICE_BYTES):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                rows.append(summary(prepare(words, doc_id) if prepare else words))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def collapse(docs: DataFrame) -> DataFrame:
    """The documents with each run cut to its first period; words are then joined by one space.

    Texts without a run stay as they are, null texts too; all columns are kept.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, at, SLICE_BYTES):
            out = []
            for text in b.column(at).to_pylist():
                words = words_of(text)
                runs = runs_of(numbered(words))
                kept = np.flatnonzero(kept_words(len(words), runs)) if runs else ()
                out.append(b" ".join(words[i] for i in kept).decode("utf-8", "surrogatepass") if runs else text)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), stand_in)
