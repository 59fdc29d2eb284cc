"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of whole texts are computed in tasks, in slices of bounded bytes. The trees are
fitted on the driver from a sample of at most ``SAMPLE`` labelled rows (picked by a hash of the id,
so always the same ones); their flattened arrays, a few hundred kB, go with the scoring tasks,
which walk all rows and trees of a batch level by level in numpy.

Cases: null or empty texts have the statistics of an empty text and get a score; labels without a
document, without a quality or with a null id are not learned from; repeated labels count as often
as they occur; with no label, or labels of one class only, every score is the share of class 1
(0.5 without labels). Each document row gets one score, repeated or not. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import crc_mod, table, text_slices

#: labelled rows that the trees are fitted on at most
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 4, 64, 0.2, 20.0, 1.0
HELD_OUT_MOD = 5
SLICE_BYTES = 4 << 20
KEEP_AT = 0.3

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "top_five_words", "repeated_pairs", "repeated_threes",
    "symbols", "marks", "exclaims", "bars", "digits", "capitals", "non_ascii", "spaces", "line_length", "repeated_lines",
    "sentence_length", "long_words", "short_words", "capital_words", "mark_words", "longest_word", "distinct_chars", "word_entropy",
)

_ASCII = "".join(map(chr, range(128)))
_DELETE = {
    "symbols": b"#*$%&|<>", "marks": b".,;:?!'\"()-", "exclaims": b"!", "bars": b"|", "digits": b"0123456789",
    "capitals": bytes(range(65, 91)), "spaces": b" \t\n\r\x0b\x0c", "non_ascii": bytes(range(128, 256)),
}
_SENTENCE = re.compile(r"[.!?]+\s")


def statistics(text: str) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(len(raw), 1)
    share = {k: (len(raw) - len(raw.translate(None, v))) / size for k, v in _DELETE.items()}
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int32, n) if n else np.zeros(1, np.int32)
    counts = Counter(words)
    most = [c for _, c in counts.most_common(5)] or [0]
    freq = np.fromiter(counts.values(), np.float64, len(counts)) / max(n, 1)
    pairs = len(set(zip(words, words[1:])))
    threes = len(set(zip(words, words[1:], words[2:])))
    lines = text.split("\n")
    capital_words = sum(map(str.isupper, words))
    ends = sum(1 for w in words if not w[-1].isalnum())
    m = max(n, 1)
    value = {
        "log_chars": np.log1p(len(text)), "log_words": np.log1p(n), "word_length": float(lengths.mean()), "distinct_words": len(counts) / m,
        "top_word": most[0] / m, "top_five_words": sum(most) / m,
        "repeated_pairs": 1 - pairs / max(n - 1, 1) if n > 1 else 0.0, "repeated_threes": 1 - threes / max(n - 2, 1) if n > 2 else 0.0,
        "line_length": len(text) / len(lines), "repeated_lines": 1 - len(set(lines)) / len(lines),
        "sentence_length": n / (1 + len(_SENTENCE.findall(text))), "long_words": float((lengths > 12).mean()), "short_words": float((lengths < 3).mean()),
        "capital_words": capital_words / m, "mark_words": ends / m, "longest_word": np.log1p(float(lengths.max())),
        "distinct_chars": np.log1p(len(set(text))), "word_entropy": float(-(freq * np.log(np.maximum(freq, 1e-12))).sum()),
    } | share
    return [float(value[f]) for f in FEATURES]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """All trees end to end: a node is a leaf where ``feature`` is -1; children lie side by side."""

    prior: float
    root: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 per row; every pass moves each row one level down in all trees."""
        if not len(self.root):
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        at = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        rows = np.arange(len(x))[:, None]
        while (inner := self.feature[at] >= 0).any():
            right = x[rows, np.maximum(self.feature[at], 0)] > self.limit[at]
            at = np.where(inner, self.child[at] + right, at)
        return 1 / (1 + np.exp(-(self.prior + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, ridge: float = RIDGE) -> Trees:
    """Second-order boosting of the logistic loss; each level's split search is one histogram pass."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    prior = float(np.log(share / (1 - share)))
    none = np.empty(0)
    if len(y) < 2 or y.min() == y.max():
        return Trees(prior, none.astype(int), none.astype(int), none, none.astype(int), none)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    n, k = binned.shape
    margin = np.full(n, prior)
    root, feature, limit, child, value = [], [], [], [], []

    def node(g: float, h: float) -> int:
        feature.append(-1), limit.append(0.0), child.append(0), value.append(-RATE * g / (h + ridge))
        return len(feature) - 1

    offset = np.arange(k) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        root.append(node(g.sum(), h.sum()))
        where, open_ = np.zeros(n, dtype=np.int64), [root[-1]]
        at = np.full(n, root[-1])
        for _ in range(depth):
            m = len(open_)
            slot = where[:, None] * (k * BINS) + offset + binned
            live = where >= 0
            cells = slot[live].ravel()
            hg, hh = (np.bincount(cells, np.repeat(v[live], k), m * k * BINS).reshape(m, k, BINS).cumsum(axis=2) for v in (g, h))
            tg, th = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg**2 / (hh + ridge) + (tg - hg) ** 2 / (th - hh + ridge) - tg**2 / (th + ridge)
            gain[(hh < LEAST / 4) | (th - hh < LEAST / 4)] = -1
            for f in range(k):
                gain[:, f, len(edges[f]) :] = -1
            following, moved = [], np.full(n, -1)
            for i, parent in enumerate(open_):
                f, b = divmod(int(gain[i].argmax()), BINS)
                if gain[i, f, b] <= 1e-6:
                    continue
                lg, lh = hg[i, f, b], hh[i, f, b]
                feature[parent], limit[parent], child[parent] = f, float(edges[f][b]), len(feature)
                node(lg, lh), node(tg[i, 0, 0] - lg, th[i, 0, 0] - lh)
                here = where == i
                right = binned[:, f] > b
                at[here] = child[parent] + right[here]
                moved[here] = len(following) + right[here]
                following += [child[parent], child[parent] + 1]
            where, open_ = moved, following
            if not open_:
                break
        margin += np.array(value)[at]
    return Trees(prior, np.array(root), np.array(feature), np.array(limit), np.array(child), np.array(value))


def sample(docs: DataFrame, labels: DataFrame, at_most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``at_most`` labelled rows outside the held-out part."""
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (crc_mod(F.col("_id"), HELD_OUT_MOD) != 0))
        .orderBy(F.xxhash64("_id", F.lit(11)), "_id", "_y")
        .limit(at_most)
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1, SLICE_BYTES):
            x = matrix(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    rows = joined.mapInArrow(run, "id long, y double, x array<double>").toPandas().sort_values(["id", "y"], kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["y"].to_numpy(), rows["id"].to_numpy()))
    return x[order], (rows["y"].to_numpy()[order] > 0.5).astype(np.float64)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) per document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.scores(matrix(b.column(1).to_pylist())))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = fit(*sample(docs, table(spark, sf_dir, "labels")))
    return score(docs, trees).select(
        "doc_id", (crc_mod(F.col("doc_id"), HELD_OUT_MOD) == 0).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted")
    )
