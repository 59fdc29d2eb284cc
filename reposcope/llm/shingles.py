"""Hashes of words and of word windows for a batch of texts, with numpy over the bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: one random value per byte, and the odd base of the running hash
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: the bytes that separate words
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words end to end, and how many words each text has."""
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)  # each text ends with a gap
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    gap = _GAP[data]
    edge = np.diff(gap.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(end) > len(start):  # the first gap of data that begins with one is no end
        end = end[len(end) - len(start) :]
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * powers(len(data)), dtype=np.uint64)])
        shift = powers(len(data), _INVERSE)
        hashes = mix((total[end] - total[start]) * shift[start] + (end - start).astype(np.uint64))
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    counts = np.diff(np.searchsorted(start, bounds))
    return hashes, counts


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words per text; a shorter text with words has one window."""
    with np.errstate(over="ignore"):
        n = len(hashes)
        begin = np.cumsum(counts) - counts
        full = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
        for j in range(size if n >= size else 0):
            full += hashes[j : n - size + 1 + j] * _PLACE[j]
        out = np.maximum(counts - size + 1, np.minimum(counts, 1))
        where = np.repeat(begin - (np.cumsum(out) - out), out) + np.arange(int(out.sum()))
        values = np.zeros(len(where), dtype=np.uint64)
        short = np.repeat(counts < size, out)
        values[~short] = full[where[~short]]
        for t in np.flatnonzero((counts > 0) & (counts < size)):
            at = int(np.cumsum(out)[t] - 1) if t < 0 else int(out[: t + 1].sum() - 1)
            k = int(counts[t])
            values[at] = (hashes[begin[t] : begin[t] + k] * _PLACE[:k]).sum(dtype=np.uint64) + np.uint64(k)
        return mix(values), out


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[new], np.bincount(o[new], minlength=len(counts)).astype(np.int64)


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    return distinct(*windows(hashes, counts, size))
