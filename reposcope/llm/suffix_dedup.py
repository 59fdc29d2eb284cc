"""Exact removal of repeated byte strings by a logarithmic family of suffix arrays.

Documents are cut into batches: contiguous ranges of their id of about ``BATCH_BYTES`` of text. A
byte is removed if a string of ``LENGTH`` bytes over it also starts in a document with a smaller id.

Suffixes are sampled so that no match is lost: every string of LENGTH bytes is filed under its
smallest hash of ``GRAM`` consecutive bytes (its anchor), so equal strings have the same anchor, and
consecutive strings with one anchor form a fragment. The space of anchors is dealt into buckets.

1. Each batch sends the anchors it holds; a bucket tells it which of them other batches hold too.
2. For those anchors the batch sends its suffix array, the sorted distinct fragments. A bucket takes
   the batches in order, a group of small arrays at a time. It scans a group against its levels, and
   each array against those before it in the group, then adds the group as a level of rank 0; two
   levels of equal rank merge into one of the next, so there are logarithmically many.
   Fragments that no level holds as a whole are looked up string by string in a second family,
   which holds the strings of the anchors that have several fragments. Bytes are compared, always.
3. The batch gets a bit per string (does it start in an earlier batch?), adds what repeats within
   the batch, and cuts its texts.

An anchor with more than ``HEAVY`` fragments would not fit one bucket: its strings are dealt one by
one by their own hash, and each batch sends each only once, so no key is hot.

Cases: a null text is empty; texts shorter than LENGTH lose nothing; a null id counts as the
largest; rows that share an id never remove from each other, and each loses what smaller ids hold;
cuts may fall within a character, so kept text is binary. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import pack_sorted, shard_bounds, shard_of, table, unpack_sorted
from reposcope.llm.jaccard import NO_ID, by_group
from reposcope.llm.shingles import _BASE, _BYTE, _INVERSE, mix, powers

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1  # grams in a string
MOST = 31  # strings in a fragment, one bit each
BATCH_BYTES = 4 << 20
#: text per bucket of anchors; a sixteenth of its bytes become anchors of eight bytes
BUCKET_BYTES = 32 << 20
HEAVY = 1 << 16
#: bytes of fragments that a bucket scans at a time, or one batch's
GROUP_BYTES = 4 << 20
END = 0xFF  # closes a stored string; no UTF-8 text holds this byte

_FRAGMENT = 8 + LENGTH + MOST - 1 + 1  # anchor, bytes, END
_STRING = 8 + LENGTH + 1  # hash, bytes, END
_BLOCK = 1 << 15  # places hashed at a time, within the processor's cache
_CODEC = pa.Codec("zstd", 1)
#: powers of the hash base and of its inverse; those of further places are products with a power per block
_FORTH, _BACK = powers(_BLOCK + SPAN), powers(_BLOCK + SPAN, _INVERSE)


class Batch:
    """Documents of a batch in the order of their ids, and their fragments."""

    def __init__(self, rows: pa.Table):
        ids = [NO_ID if x is None else x for x in rows.column("doc_id").to_pylist()]
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in rows.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i]))
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.raw = [raw[i] for i in order]
        self.sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.data = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self._fragments()

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        """64-bit hashes of the ``size`` bytes from each place on."""
        with np.errstate(over="ignore"):
            back = _BACK[at & (_BLOCK - 1)] * self.back[at // _BLOCK]
            return mix((self.total[at + size] - self.total[at]) * back)

    def _lowest(self, n: int) -> np.ndarray:
        """The smallest hash of the grams of the string at each of the first ``n`` places."""
        out = np.empty(n, dtype=np.uint64)
        for lo in range(0, n, _BLOCK):
            hi = min(lo + _BLOCK, n) + SPAN - 1
            back = _BACK[: hi - lo] * self.back[lo // _BLOCK]
            low = mix((self.total[lo + GRAM : hi + GRAM] - self.total[lo:hi]) * back)
            reach = 1
            while reach < SPAN:  # smallest of ``reach`` grams, doubled until it spans a string
                step = min(reach, SPAN - reach)
                low = np.minimum(low[:-step], low[step:])
                reach += step
            out[lo : lo + _BLOCK] = low
        return out

    def _fragments(self) -> None:
        """start, strings (how many), anchor, owner (document) of each fragment."""
        n = len(self.data)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n + 1, dtype=np.uint64)
            forth, self.back = (powers(n // _BLOCK + 1, np.uint64(pow(int(x), _BLOCK, 1 << 64))) for x in (_BASE, _INVERSE))
            for lo in range(0, n, _BLOCK):
                part = _BYTE[self.data[lo : lo + _BLOCK]] * (_FORTH[: min(_BLOCK, n - lo)] * forth[lo // _BLOCK])
                part[0] += self.total[lo]
                np.cumsum(part, dtype=np.uint64, out=self.total[lo + 1 : lo + 1 + len(part)])
        many = np.maximum(self.sizes - LENGTH + 1, 0)
        if not many.any():
            self.start = self.strings = self.owner = self.of_anchor = np.empty(0, np.int64)
            self.anchor = self.anchors = np.empty(0, np.uint64)
            return
        with np.errstate(over="ignore"):
            low = self._lowest(n - LENGTH + 1)
        valid = np.repeat(np.tile([True, False], len(many)), np.stack([many, self.sizes - many], axis=1).reshape(-1))[: len(low)]
        new = np.ones(len(low), dtype=bool)
        new[1:] = low[1:] != low[:-1]
        new[self.begin[many > 0]] = True
        new &= valid
        start = np.flatnonzero(new)
        owner = np.searchsorted(self.begin, start, side="right") - 1
        while (same := self.sizes[owner] == 0).any():  # empty documents begin where the next does
            owner[same] -= 1
        end = np.minimum(np.append(start[1:], len(low)), (self.begin + many)[owner])
        strings = end - start
        if len(strings) and strings.max() > MOST:  # periodic text: cut to pieces of MOST strings
            pieces = -(-strings // MOST)
            k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, owner, strings = np.repeat(start, pieces) + k * MOST, np.repeat(owner, pieces), np.repeat(strings, pieces)
            strings = np.minimum(strings - k * MOST, MOST)
        self.start, self.strings, self.owner, self.anchor = start, strings, owner, low[start]
        # the distinct anchors, which of them each fragment has, and the fragments by anchor
        self.by_anchor = np.argsort(self.anchor)
        self.anchors, self.heads, of = _heads(self.anchor[self.by_anchor])
        self.of_anchor = np.empty(len(of), dtype=np.int64)
        self.of_anchor[self.by_anchor] = of

    def stored(self, which: np.ndarray) -> np.ndarray:
        """Fragments as fixed-width strings: anchor, bytes, END."""
        out = np.zeros((len(which), _FRAGMENT), dtype=np.uint8)
        out[:, :8] = self.anchor[which].astype(">u8").view(np.uint8).reshape(-1, 8)
        size = self.strings[which] + LENGTH - 1
        cell = np.arange(_FRAGMENT - 9)
        if len(which):
            wide = np.concatenate([self.data, np.zeros(len(cell), dtype=np.uint8)])
            np.multiply(np.lib.stride_tricks.sliding_window_view(wide, len(cell))[self.start[which]], cell < size[:, None], out=out[:, 8:-1])
        out[np.arange(len(which)), 8 + size] = END
        return out.reshape(-1).view(f"S{_FRAGMENT}")

    def single(self, places: np.ndarray) -> np.ndarray:
        """The strings that begin at the places, with hash and END."""
        return _filed(np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)[places] if len(places) else np.empty((0, LENGTH), np.uint8))

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin of every string of the fragments, and the fragment's position in ``which``."""
        n = self.strings[which]
        k = np.repeat(np.arange(len(which)), n)
        return self.start[which][k] + np.arange(len(k)) - (np.cumsum(n) - n)[k], k


# ---- levels ------------------------------------------------------------------------------
def _heads(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, where each begins, and which of them each element is."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return x[at], at, np.cumsum(new) - 1


def _filed(cells: np.ndarray) -> np.ndarray:
    """Strings of LENGTH bytes, one per row, behind a hash of theirs that makes their order cheap."""
    out = np.full((len(cells), _STRING), END, dtype=np.uint8)
    out[:, 8:-1] = cells
    whole = LENGTH // 8 * 8
    h = np.zeros(len(cells), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for word in (*np.ascontiguousarray(cells[:, :whole]).view(np.uint64).T, *cells[:, whole:].T.astype(np.uint64)):
            h = mix(h ^ word) * _BYTE[0]
    out[:, :8] = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.reshape(-1).view(f"S{_STRING}")


def _prefix(strings: np.ndarray) -> np.ndarray:
    """The first eight bytes, in the order of the strings: an anchor, or a string's hash."""
    cells = strings.view(np.uint8).reshape(len(strings), strings.dtype.itemsize)[:, :8]
    out = np.zeros((len(strings), 8), dtype=np.uint8)
    out[:, : cells.shape[1]] = cells
    return out.view(">u8").reshape(-1).astype(np.uint64)


class Family:
    """Sorted arrays of strings; two of equal rank merge into one of the next rank."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []
        self.prefixes: list[np.ndarray] = []  # of the levels

    def add(self, batch: np.ndarray) -> None:
        """``batch`` is sorted and holds nothing that a level holds."""
        if not len(batch):
            return
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, old = self.levels.pop()
            self.prefixes.pop()
            batch = np.sort(np.concatenate([old, batch]), kind="stable")  # merges two runs
            rank += 1
        self.levels.append((rank, batch))
        self.prefixes.append(_prefix(batch))

    def holds(self, batch: np.ndarray) -> np.ndarray:
        """Which of the sorted strings a level holds."""
        found = np.zeros(len(batch), dtype=bool)
        prefix = _prefix(batch)
        for (_, level), there in zip(self.levels, self.prefixes):
            at = np.minimum(np.searchsorted(there, prefix), len(level) - 1)
            same = np.flatnonzero(there[at] == prefix)
            hit = level[at[same]] == batch[same]
            found[same[hit]] = True
            # strings that share a prefix with others are searched as a whole
            same, at = same[~hit], at[same[~hit]]
            same = same[(at + 1 < len(level)) & (there[np.minimum(at + 1, len(level) - 1)] == prefix[same])]
            if len(same):
                at = np.minimum(np.searchsorted(level, batch[same]), len(level) - 1)
                found[same] |= level[at] == batch[same]
        return found


def _strings(fragments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every string of the stored fragments, which fragment it is of, and its number there."""
    cells = fragments.view(np.uint8).reshape(-1, _FRAGMENT)
    n = np.char.str_len(fragments) - 9 - LENGTH + 1 if len(fragments) else np.empty(0, np.int64)
    k = np.repeat(np.arange(len(fragments)), n)
    number = np.arange(len(k)) - (np.cumsum(n) - n)[k]
    if not len(k):
        return _filed(np.empty((0, LENGTH), np.uint8)), k, number
    return _filed(np.lib.stride_tricks.sliding_window_view(cells, LENGTH, axis=1)[k, 8 + number]), k, number


def _first_seen(strings: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct strings, the smallest batch of each, and which of them each string is."""
    prefix = _prefix(strings)
    order = np.lexsort((batch, prefix))
    same = prefix[order[1:]] == prefix[order[:-1]]
    if (strings[order[1:][same]] != strings[order[:-1][same]]).any():  # a prefix of several strings
        order = np.lexsort((batch, strings))
    values, at, of = _heads(strings[order])
    back = np.empty(len(order), dtype=np.int64)
    back[order] = of
    return values, batch[order[at]], back


class Bucket:
    """What a bucket of anchors knows of the batches so far."""

    def __init__(self) -> None:
        self.fragments, self.strings, self.dealt = Family(), Family(), Family()
        self.several = np.empty(0, np.uint64)  # anchors whose strings are in ``strings``

    def scan(self, batches: list[np.ndarray]) -> list[np.ndarray]:
        """Per fragment of the batches, which come in order, a bit per string: does an earlier batch hold it? Then adds them."""
        number = np.repeat(np.arange(len(batches)), [len(x) for x in batches])
        distinct, first, of = _first_seen(np.concatenate(batches), number)
        bits = np.zeros(len(distinct), dtype=np.uint32)  # of the first batch with a fragment; others hold it whole
        whole = self.fragments.holds(distinct)
        bits[whole] = np.uint32((1 << MOST) - 1)
        rest = np.flatnonzero(~whole)
        anchor = _prefix(distinct[rest])
        met = np.zeros(len(rest), dtype=bool)
        met[1:] |= anchor[1:] == anchor[:-1]
        met[:-1] |= anchor[1:] == anchor[:-1]
        fresh = np.setdiff1d(anchor, self.several)
        known = []
        for (_, level), there in zip(self.fragments.levels, self.fragments.prefixes):
            at = np.searchsorted(there, anchor)
            met |= there[np.minimum(at, len(there) - 1)] == anchor
            lo, hi = np.searchsorted(there, fresh), np.searchsorted(there, fresh, side="right")
            n = hi - lo
            known.append(level[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        if met.any():
            # an anchor gets its second fragment: from now on its strings are filed one by one
            self.several = np.union1d(self.several, anchor[met])
            old = np.concatenate(known) if known else distinct[:0]
            if len(old):
                text = np.unique(_strings(old)[0])
                self.strings.add(text[~self.strings.holds(text)])
            some = rest[met]
            text, k, place = _strings(distinct[some])
            text, earliest, back = _first_seen(text, first[some[k]])
            held = self.strings.holds(text)
            hit = held[back] | (earliest[back] < first[some[k]])
            np.bitwise_or.at(bits, some[k[hit]], np.uint32(1) << place[hit].astype(np.uint32))
            self.strings.add(text[~held])
        self.fragments.add(distinct[rest])
        out = np.where(number == first[of], bits[of], np.uint32((1 << MOST) - 1))
        return np.split(out, np.cumsum([len(x) for x in batches])[:-1])

    def scan_strings(self, batches: list[np.ndarray]) -> list[np.ndarray]:
        number = np.repeat(np.arange(len(batches)), [len(x) for x in batches])
        distinct, first, of = _first_seen(np.concatenate(batches), number)
        held = self.dealt.holds(distinct)
        self.dealt.add(distinct[~held])
        return np.split(held[of] | (first[of] < number), np.cumsum([len(x) for x in batches])[:-1])


# ---- tasks -------------------------------------------------------------------------------
def _pack(x: np.ndarray) -> bytes:
    return x.nbytes.to_bytes(8, "little") + (_CODEC.compress(x.tobytes(), asbytes=True) if len(x) else b"")


def _unpack(x: bytes, kind) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    return np.frombuffer(_CODEC.decompress(x[8:], size) if size else b"", kind)


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of the keys by their lower bits, positions in ascending order."""
    b = (keys & np.uint64(buckets - 1)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cuts[k] < cuts[k + 1]:
            yield k, order[cuts[k] : cuts[k + 1]]


def _holding(buckets: int):
    def run(key, rows):  # without type hints: Spark would read them
        batch = Batch(rows)
        anchors, n = batch.anchors, np.bincount(batch.of_anchor, minlength=len(batch.anchors))
        out = [(key[0].as_py(), b, pack_sorted(anchors[at]), _pack(np.minimum(n[at], 0xFFFF).astype(np.uint16))) for b, at in _by_bucket(anchors, buckets)]
        return _table(out, _HELD)

    return run


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and bucket a byte per anchor: 1 if another batch holds it, 2 if it is heavy."""
    for t, starts in by_group(batches, 1):
        for s, e in zip(starts, np.append(starts[1:], t.num_rows)):
            part = t.slice(s, e - s)
            anchors = [unpack_sorted(x) for x in part.column("anchors").to_pylist()]
            n = np.concatenate([_unpack(x, np.uint16) for x in part.column("n").to_pylist()]).astype(np.int64)
            _, back, seen = np.unique(np.concatenate(anchors), return_inverse=True, return_counts=True)
            total = np.bincount(back, n)
            flag = np.where(seen > 1, np.where(total > HEAVY, 2, 1), 0).astype(np.uint8)[back]
            flags = np.split(flag, np.cumsum([len(a) for a in anchors])[:-1])
            rows = [(c, b, _pack(f)) for c, b, f in zip(part.column("batch").to_pylist(), part.column("bucket").to_pylist(), flags)]
            yield from _table(rows, _FLAGS).to_batches()


class _Shared:
    """A batch with what the buckets said of its anchors."""

    def __init__(self, rows: pa.Table, flags: pa.Table, buckets: int):
        self.batch, self.buckets = Batch(rows), buckets
        anchors = self.batch.anchors
        flag = np.zeros(len(anchors), dtype=np.uint8)
        told = {b: _unpack(f, np.uint8) for b, f in zip(flags.column("bucket").to_pylist(), flags.column("flags").to_pylist())}
        for b, at in _by_bucket(anchors, buckets):
            flag[at] = told[b]
        of = flag[self.batch.of_anchor]
        self.shared = np.flatnonzero(of == 1)
        self.fragments, self.of_fragment = np.unique(self.batch.stored(self.shared), return_inverse=True)
        self.places, _ = self.batch.places(np.flatnonzero(of == 2))
        self.strings, first, self.of_string = np.unique(self.batch.single(self.places), return_index=True, return_inverse=True)
        self.string_hash = self.batch.hashes(self.places[first], LENGTH)

    def parts(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """bucket -> positions of its fragments, and of its strings."""
        out = {b: (at, np.empty(0, np.int64)) for b, at in _by_bucket(_prefix(self.fragments), self.buckets)}
        for b, at in _by_bucket(self.string_hash, self.buckets):
            out[b] = (out.get(b, (np.empty(0, np.int64),))[0], at)
        return out


def _sending(buckets: int):
    def run(key, rows, flags):
        s = _Shared(rows, flags, buckets)
        parts, told = s.parts(), dict(zip(flags.column("bucket").to_pylist(), flags.column("flags").to_pylist()))
        none = np.empty(0, np.int64)
        out = []
        for b in sorted({*parts, *told}):
            f, w = parts.get(b, (none, none))
            out.append((key[0].as_py(), b, told.get(b), _pack(s.fragments[f]), _pack(s.strings[w])))
        return _table(out, _ARRAYS)

    return run


def _scanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and batch; the state is that of one bucket at a time."""
    at, bucket = None, Bucket()
    for t in batches:
        for lo in range(0, t.num_rows, 64):
            out, group, size = [], [], 0

            def scanned() -> None:
                """What the bucket says of the group, which it then holds."""
                if group:
                    bits = bucket.scan([_unpack(x[3], f"S{_FRAGMENT}") for x in group])
                    held = bucket.scan_strings([_unpack(x[4], f"S{_STRING}") for x in group])
                    out.extend((*x[:3], _pack(f), _pack(w)) for x, f, w in zip(group, bits, held))
                    group.clear()

            for row in zip(*(x.to_pylist() for x in t.slice(lo, 64).columns)):
                new = sum(int.from_bytes(x[:8], "little") for x in row[3:])
                if row[1] != at or size + new > GROUP_BYTES:
                    scanned()
                    size = 0
                if row[1] != at:
                    at, bucket = row[1], Bucket()
                group.append(row)
                size += new
            scanned()
            yield from _table(out, _BITS).to_batches()


def _cutting(buckets: int):
    def run(key, rows, told):
        s = _Shared(rows, told.filter(pa.compute.is_valid(told.column("flags"))), buckets)
        bits, held = np.zeros(len(s.fragments), np.uint32), np.zeros(len(s.strings), bool)
        back = {b: (_unpack(x, np.uint32), _unpack(y, bool)) for b, x, y in zip(*(told.column(c).to_pylist() for c in ("bucket", "bits", "held")))}
        for b, (f, w) in s.parts().items():
            bits[f], held[w] = back[b]
        batch = s.batch
        gone = [s.places[held[s.of_string]]]
        some = np.flatnonzero(bits[s.of_fragment])
        place, k = batch.places(s.shared[some])
        number = place - batch.start[s.shared[some]][k]
        gone.append(place[(bits[s.of_fragment[some]][k] >> number.astype(np.uint32)) & 1 == 1])
        gone.append(_repeated_within(batch))
        batch.total = None
        return _cut(rows, batch, np.concatenate(gone))

    return run


def _repeated_within(batch: Batch) -> np.ndarray:
    """Begins of the strings that also start in a document of the batch with a smaller id."""
    none = np.empty(0, np.int64)
    if not len(batch.anchor):
        return none
    ids = batch.ids[batch.owner[batch.by_anchor]]
    low, high = np.minimum.reduceat(ids, batch.heads), np.maximum.reduceat(ids, batch.heads)
    which = np.flatnonzero((low < high)[batch.of_anchor])
    place, k = batch.places(which)
    if not len(place):
        return none
    ids = batch.ids[batch.owner[which][k]]
    h = batch.hashes(place, LENGTH)
    order = np.lexsort((ids, h))
    h, place, ids = h[order], place[order], ids[order]
    head = np.ones(len(h), dtype=bool)
    head[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = np.flatnonzero(ids > ids[first])
    view = np.lib.stride_tricks.sliding_window_view(batch.data, LENGTH)
    out = []
    for lo in range(0, len(later), 1 << 16):
        at = later[lo : lo + (1 << 16)]
        out.append(place[at[(view[place[at]] == view[place[first[at]]]).all(axis=1)]])
    return np.concatenate(out) if out else none


def _cut(rows: pa.Table, batch: Batch, gone: np.ndarray) -> pa.Table:
    marked = np.zeros(len(batch.data), dtype=bool)
    marked[gone] = True
    gone = np.flatnonzero(marked)
    edge = np.zeros(len(batch.data) + 1, dtype=np.int8)  # LENGTH strings hold a byte at most
    edge[gone] = 1
    edge[gone + LENGTH] -= 1
    covered = np.cumsum(edge[:-1], dtype=np.int8) > 0
    # a span begins and ends within its document
    some = batch.sizes > 0
    begins, ends = covered.copy(), covered.copy()
    begins[1:] &= ~covered[:-1]
    ends[:-1] &= ~covered[1:]
    at = batch.begin[some]
    begins[at] = covered[at]
    at = at + batch.sizes[some] - 1
    ends[at] = covered[at]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(batch.begin, start, side="right") - 1  # the last of those that begin there is not empty
    offsets = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
    places = [pa.array(x - batch.begin[owner], pa.int32()) for x in (start, end)]
    spans = pa.ListArray.from_arrays(offsets(np.bincount(owner, minlength=len(batch.ids))), pa.StructArray.from_arrays(places, ["start", "end"]))
    left = offsets(batch.sizes - np.bincount(owner, end - start, minlength=len(batch.ids)).astype(np.int64))
    kept = pa.Array.from_buffers(pa.binary(), len(batch.ids), [None, left.buffers()[1], pa.py_buffer(batch.data[~covered])])
    ids = [None if x == NO_ID else int(x) for x in batch.ids]
    return pa.Table.from_arrays([pa.array(ids, rows.schema.field("doc_id").type), pa.array(batch.sizes), spans, kept], ["doc_id", "n_bytes", "spans", "kept"])


_HELD = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("anchors", pa.binary()), ("n", pa.binary())])
_FLAGS = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary())])
_ARRAYS = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary()), ("fragments", pa.binary()), ("strings", pa.binary())])
_BITS = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary()), ("bits", pa.binary()), ("held", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def dedup(docs: DataFrame, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (removed bytes, start and end) and kept (the other bytes)."""
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = text.agg(F.sum(size).alias("n")).first()["n"] or 0
    buckets = 1 << max(0, int(np.ceil(np.log2(max(1, total / bucket_bytes)))))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    bounds = shard_bounds(text, "doc_id", size, batch_bytes)
    rows = text.select(shard_of("doc_id", bounds).cast("int").alias("batch"), "doc_id", "text")
    by_batch = rows.groupBy("batch")

    def at_buckets(df: DataFrame) -> DataFrame:
        return df.repartitionById(max(n, buckets), F.col("bucket")).sortWithinPartitions("bucket", "batch")

    held = by_batch.applyInArrow(_holding(buckets), _sql(_HELD))
    flags = at_buckets(held.select("bucket", "batch", "anchors", "n")).mapInArrow(_sharing, _sql(_FLAGS))
    arrays = by_batch.cogroup(flags.groupBy("batch")).applyInArrow(_sending(buckets), _sql(_ARRAYS))
    bits = at_buckets(arrays).mapInArrow(_scanning, _sql(_BITS))
    out = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
    return by_batch.cogroup(bits.groupBy("batch")).applyInArrow(_cutting(buckets), out)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
