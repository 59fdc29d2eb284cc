"""Byte-level BPE by a pair occurrence index.

Per slice of bounded bytes the distinct pre-tokens that the task has not met before are laid end to
end. An index maps the rank of every mergeable pair to all its positions there; the active ranks are
applied in ascending order from a heap, and each merge updates the lists of the two pairs that it
makes. All positions of a rank are merged at once with numpy; a vocabulary in which a merge can make
a pair of lower rank takes them one by one. Texts are then gathered from the encoded pre-tokens, and
decoded bytes from one flat table of the tokens, with numpy.

Cases: a null text counts as empty and gives no tokens; the vocabulary's added tokens are found
in the text first and become their own ids; rows are independent, so repeated rows and ids, empty
tables and columns of any other name change nothing. Other columns are not returned.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import text_slices

#: fixed value: the pre-token pattern of byte-level vocabularies
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: pre-tokens that a task remembers before it starts afresh
REMEMBERED = 400_000
SLICE_BYTES = 2 << 20
#: below this code point all characters are in every edition of Unicode; they have a pattern of their own
LATIN = 0x250


def latin_pattern() -> str:
    """``PRETOKEN`` for texts of characters below ``LATIN``, with its classes spelled out."""
    kinds = {c: unicodedata.category(chr(c))[0] for c in range(LATIN)}
    of = lambda wanted: "".join(re.escape(chr(c)) for c in range(LATIN) if wanted(c))
    letters, numbers = of(lambda c: kinds[c] == "L"), of(lambda c: kinds[c] == "N")
    spaces = of(lambda c: c in (*range(9, 14), 32, 0x85, 0xA0))
    return (f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


def newer_letters() -> str:
    """Ranges, for a character class, of letters and numbers that came after Python's own tables.

    Pattern engines know different editions of Unicode; on these characters alone they may differ.
    """
    known = regex.compile(r"[\p{L}\p{N}\s]").match
    out, begin = [], None
    for c in range(sys.maxunicode + 2):
        new = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn" and known(chr(c)) is not None
        if new and begin is None:
            begin = c
        elif not new and begin is not None:
            out.append(f"{chr(begin)}-{chr(c - 1)}")
            begin = None
    return "".join(out)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class Vocabulary:
    """What a vocabulary file says, in a form that is cheap to send to tasks (a few MB)."""

    tokens: list[bytes]
    ranks: dict[int, tuple[int, int]]  # left * size + right -> (rank, merged id)
    first: np.ndarray  # id of each single byte
    added: list[tuple[str, int]]
    newer: str = ""

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a tokenizer JSON file with a byte-level BPE model, on the driver."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("add_prefix_space"):
            raise ValueError("only plain byte-level vocabularies are read")
        byte_of = {c: i for i, c in enumerate(letters)}
        ids = model["vocab"]
        added = [(t["content"], t["id"]) for t in spec.get("added_tokens", [])]
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take in their surroundings are not read")
        size = max([*ids.values(), *(i for _, i in added)]) + 1
        tokens = [b""] * size
        for text, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in text)
        for text, i in added:
            tokens[i] = text.encode()
        ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(ids[left] * size + ids[right], (rank, ids[left + right]))
        first = np.array([ids[c] for c in letters], dtype=np.int64)
        return cls(tokens, ranks, first, sorted(added, key=lambda x: -len(x[0])), newer_letters())


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """One per task: the pre-tokens met so far and their ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.findall = regex.compile(PRETOKEN).findall
        self.latin = re.compile(latin_pattern()).findall
        self.beyond = re.compile(f"[{chr(LATIN)}-\U0010ffff]").search
        self.newer = re.compile(f"[{vocabulary.newer}]").search if vocabulary.newer else lambda _: None
        self.size = len(vocabulary.tokens)
        self.index = PairIndex(vocabulary.ranks, self.size)
        self.by_rank = self.index.by_rank
        none = len(vocabulary.ranks)
        self.pairs = np.full((256, 256), none, dtype=np.int32)
        byte = {int(t): b for b, t in enumerate(vocabulary.first)}
        for rank, (a, b, _) in self.by_rank.items():
            if a in byte and b in byte:
                self.pairs[byte[a], byte[b]] = rank
        self.none = none
        special = "|".join(regex.escape(t) for t, _ in vocabulary.added)
        self.special = regex.compile(f"({special})").split if special else None
        self.special_id = dict(vocabulary.added)
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.length = np.empty(0, np.uint32), np.empty(0, np.int64)

    def split(self, text: str) -> list[str]:
        """Pre-tokens; where the pattern engines may differ, as the library's own engine cuts them."""
        if text.isascii() or self.beyond(text) is None:
            return self.latin(text)
        if self.newer(text) is None:
            return self.findall(text)
        from tokenizers.pre_tokenizers import ByteLevel

        cuts = ByteLevel(add_prefix_space=False).pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in cuts]

    def pieces(self, text: str) -> list:
        """Pre-tokens; an added token comes as a tuple, which no pre-token equals."""
        if self.special is None:
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.special(text)):
            out.extend(self.split(part) if i % 2 == 0 else [(part,)])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > REMEMBERED:
            self._forget()
        known = len(self.numbers)
        numbered = [np.fromiter(map(self.numbers.__getitem__, self.pieces(t)), np.int64) for t in texts]
        if len(self.numbers) > known:
            fresh = list(self.numbers)[known:]
            flat, length = self._apply(fresh)
            self.flat, self.length = np.concatenate([self.flat, flat]), np.concatenate([self.length, length])
        start = np.cumsum(self.length) - self.length
        return [gather(self.flat, start[n], self.length[n]) for n in numbered]

    def _apply(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each has."""
        raw = [b"" if isinstance(p, tuple) else p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        # a piece takes its bytes and one closing slot of value -1
        data = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
        closing = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(data), dtype=bool)
        inside[closing] = False
        symbols = self.v.first.astype(np.int32)[data]
        symbols[closing] = -1
        for i, p in enumerate(pieces):
            if isinstance(p, tuple):
                symbols[closing[i]] = -2 - self.special_id[p[0]]
        rank = self.pairs[data[:-1], data[1:]]
        rank[~(inside[:-1] & inside[1:])] = self.none
        at = np.flatnonzero(rank < self.none).astype(np.int32)
        at = at[np.argsort(rank[at], kind="stable")]
        ranks, begin = np.unique(rank[at], return_index=True)
        del rank
        where = dict(zip(ranks.tolist(), np.split(at, begin[1:]))) if len(at) else {}
        if self.index.ascending:
            out = self.index.merge(symbols, where)
        else:
            lists = {k: x.tolist() for k, x in where.items()}
            out = np.array(_merge(symbols.tolist(), lists, self.by_rank, self.v.ranks, self.size), dtype=np.int64)
        special = out <= -2
        special &= ~inside  # a dead slot inside a piece also holds a negative value
        ids = np.where(special, -2 - out, out)
        keep = (inside & (out >= 0)) | special
        counts = np.add.reduceat(keep, np.concatenate([[0], closing[:-1] + 1])) if len(pieces) else np.empty(0, np.int64)
        return ids[keep].astype(np.uint32), counts.astype(np.int64)


class PairIndex:
    """Ranks of pairs, looked up for many pairs at a time."""

    def __init__(self, ranks: dict[int, tuple[int, int]], size: int):
        self.size = size
        self.keys = np.array(sorted(ranks), dtype=np.int64)
        self.rank = np.array([ranks[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.by_rank = {r: (k // size, k % size, new) for k, (r, new) in ranks.items()}
        made = np.full(size, -1, dtype=np.int64)  # the first merge that makes a token
        for r, (_, _, new) in sorted(self.by_rank.items(), reverse=True):
            made[new] = r
        left, right = (self.keys // size, self.keys % size) if len(self.keys) else (self.keys, self.keys)
        #: no merge makes a pair of its own or a lower rank, so ranks come up in ascending order
        self.ascending = bool((self.rank > np.maximum(made[left], made[right])).all()) and len(self.by_rank) == len({n for _, _, n in self.by_rank.values()})

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 for none, or where a symbol is no token."""
        if not len(self.keys):
            return np.full(len(left), -1, dtype=np.int64)
        key = left.astype(np.int64) * self.size + right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (left >= 0) & (right >= 0), self.rank[i], -1)

    def merge(self, sym: np.ndarray, where: dict[int, np.ndarray]) -> np.ndarray:
        """Applies the ranks of the index in ascending order; slots that are merged away get -1."""
        n = len(sym)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        lists = {r: [x] for r, x in where.items()}
        heap = list(lists)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            left, right, new = self.by_rank[rank]
            parts = lists.pop(rank)
            i = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            i = i[sym[i] == left]
            j = after[i]
            # the last slot closes a piece, so every token has a slot after it
            fits = sym[j] == right
            i, j = i[fits], j[fits]
            if left == right and len(i) > 1:  # in a row of equal tokens every other pair is taken
                chained = np.concatenate([[False], i[1:] == j[:-1]])
                run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(i))))
                take = (np.arange(len(i)) - run) % 2 == 0
                i, j = i[take], j[take]
            if not len(i):
                continue
            q = after[j]
            sym[i], sym[j] = new, -1
            after[i] = q
            before[q] = i
            p = before[i]
            inner = np.flatnonzero(p >= 0)
            at = np.concatenate([i, p[inner]])
            found = self.ranks_of(sym[at], np.concatenate([sym[q], sym[i[inner]]]))
            at, found = at[found >= 0], found[found >= 0]
            if len(at):
                order = np.argsort(found, kind="stable")
                at, found = at[order], found[order]
                cuts = np.flatnonzero(np.diff(found)) + 1
                for r, x in zip(found[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                    if r in lists:
                        lists[r].append(x)
                    else:
                        lists[r] = [x]
                        heapq.heappush(heap, r)
        return sym


def _merge(sym: list[int], where: dict[int, list[int]], by_rank: dict, ranks: dict, size: int) -> list[int]:
    """Applies the ranks of the index in ascending order to the symbols; merged-away slots get -1."""
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = list(where)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        left, right, new = by_rank[rank]
        spots = where.pop(rank)
        spots.sort()
        for k, i in enumerate(spots):
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue
            sym[i], sym[j] = new, -1
            after[i] = q = after[j]
            lower = False
            if q < n:
                before[q] = i
                got = ranks.get(new * size + sym[q]) if sym[q] >= 0 else None
                if got:
                    lower |= got[0] < rank
                    _note(where, heap, got[0], i)
            p = before[i]
            if p >= 0 and sym[p] >= 0:
                got = ranks.get(sym[p] * size + new)
                if got:
                    lower |= got[0] < rank
                    _note(where, heap, got[0], p)
            if lower and k + 1 < len(spots):  # a lower rank came up: it goes first
                for x in spots[k + 1 :]:
                    _note(where, heap, rank, x)
                break
    return sym


def _note(where: dict[int, list[int]], heap: list[int], rank: int, at: int) -> None:
    spots = where.get(rank)
    if spots is None:
        where[rank] = [at]
        heapq.heappush(heap, rank)
    else:
        spots.append(at)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length] end to end."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(length)
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encoding(vocabulary: Vocabulary, slice_bytes: int = SLICE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in text_slices(batches, 1, slice_bytes):
            ids = encoder.encode(_texts(batch.column(1)))
            blobs = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs], ["doc_id", "ids"])

    return run


class Decoder:
    """The bytes of all tokens end to end."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def text(self, ids: bytes) -> str:
        n = np.frombuffer(ids, "<u4")
        return gather(self.flat, self.start[n], self.length[n]).tobytes().decode("utf-8", "replace")


def decoding(tokens: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokens)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [decoder.text(x or b"") for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids): ids are little-endian unsigned 32-bit integers end to end."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encoding(vocabulary), f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, text): bytes of the tokens end to end; bytes that are no UTF-8 become U+FFFD."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decoding(vocabulary.tokens), f"doc_id {kind}, ids binary, text string")


def there_and_back(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, text): ``encode`` and ``decode`` in the same Python worker, one per task instead of two."""
    to_ids, to_text = encoding(vocabulary), decoding(vocabulary.tokens)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: to_text(to_ids(batches)), f"doc_id {kind}, ids binary, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of tokens, digest of the ids, digest of the decoded text."""
    return there_and_back(docs, Vocabulary.load(path)).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"),
    )


def default_path() -> str:
    """The vocabulary file of the production query; any byte-level tokenizer JSON will do."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
