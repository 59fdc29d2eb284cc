"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are the densities of two word lists (insults, threats), also in its worst
stretch of ``STRETCH`` words, how many of those words stand near a second-person word, how many
were hidden (digits or signs for letters, dots between letters, letters held down), and its shares
of capitals, shouted words, exclamation marks, runs of punctuation and mixed words. They are
computed in tasks from whole texts, in slices of bounded bytes. Two more weigh each listed word by
the share of toxic rows among the training rows that hold it (drawn towards the share of its list),
so that a listed word that is harmless in this corpus counts little.

Insults that no list has are learned: words and starts of words, in any language, that the toxic
training rows hold much oftener than the others (``learned``). They are counted in Spark, and the
``LEXICON`` that tell most go with the tasks. Their weights are log ratios of those rates.

Trees are fitted on the driver from at most ``SAMPLE`` labelled rows, picked by a hash of the id.
The calibration maps the trees' scores to the share of toxic rows: it is fitted on the scores that
each row gets from trees grown without its fold. Both go with the scoring tasks, a few hundred kB.

Cases: null or empty texts have the features of an empty text and get a score; labels without a
document, without a toxic mark or with a null id are not learned from; repeated labels count as
often as they occur; with labels of one class only every score is near that class, without labels
0.5. Each document row gets one score, repeated or not. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import crc_mod, table, text_slices
from reposcope.llm.quality_trees import Trees, fit

#: labelled rows that the trees are fitted on at most
SAMPLE = 20_000
#: learned words and starts at most; toxic rows that hold one, and how much oftener, at least
LEXICON, LEAST_ROWS, LEAST_RATIO = 2_000, 4, 2.0
#: lengths of the starts of words
STARTS = range(4, 9)
#: words that a task remembers, and counts that it keeps, before it starts afresh
REMEMBERED = 300_000
#: rows whose remainder modulo the first number is the second are held out
HELD_OUT = (3, 1)
TOXIC_AT = 0.7
FOLDS = 5
#: few and shallow trees: the signal is in few features, and some labels are wrong
SHAPE = {"trees": 30, "depth": 3, "ridge": 10.0}
#: words to either side in which a second-person word counts as near; length of a stretch
NEAR, STRETCH = 6, 40
SLICE_BYTES = 4 << 20

# Common insults, threats and second-person words of four languages.
INSULTS = frozenset(
    "airhead arsehole asshole bastard bigot bimbo bitch bonehead brainless brat buffoon bum chump clown coward "
    "creep cretin crook degenerate deplorable dimwit dipshit disgrace disgusting dork douche dumb dumbass dunce "
    "failure fatso fool freak garbage gross halfwit hideous hypocrite idiot idiotic idiots ignorant imbecile "
    "incompetent jackass jerk lame liar loser losers lowlife lunatic maggot moron moronic morons nitwit nobody "
    "nutcase oaf parasite pathetic phony pig psycho punk rat repulsive retard revolting ridiculous rotten "
    "scum scumbag shameful sicko simpleton sleazy slob slut snake sucker swine thug trash trashy twat twit ugly "
    "useless vermin vile weirdo whore wimp worthless "
    "arschloch blödmann depp dummkopf idioten schwein trottel versager widerlich wichser "
    "abruti connard crétin débile idiote imbécile ordure salaud salope stupide "
    "basura cabrón estúpido estúpida gilipollas idiota imbécil inútil patético payaso stupid".split()
)
THREATS = frozenset(
    "beat burn choke crush destroy die dead drown hang hate hurt kill murder punch punish rape shoot slap smash "
    "stab strangle suffer suicide töten umbringen sterben tuer crève mourir matar morir muérete".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur youre ya du dich dir dein deine euch ihr sie tu te toi ton vous votre "
    "tú ti tus usted vosotros".split()
)
#: letters that digits and signs stand for
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
_FILLERS = str.maketrans("", "", "*._-+~^'`\"")

FEATURES = (
    "insults", "n_insults", "threats", "worst_stretch", "insult_kinds", "insults_near_you", "threats_near_you", "second_person", "hidden", "hidden_share",
    "mixed_words", "capitals", "shouted", "exclaims", "questions", "punctuation", "punctuation_runs", "log_words", "first_insult",
)
#: features that need the weights of the listed words
WEIGHED = ("weight_density", "surest_word", "learned_sum", "learned_density", "learned_surest", "learned_kinds")
#: rows that the list's share counts as in the weight of a word
DRAWN = 2.0

_WORD = re.compile(r"[^\W\d_]+")
#: a word with a sign or digit between or before its letters, letters set apart, or one held down
_MIXED = re.compile(r"(?<!\S)[(\"']*(?=\S*[a-zA-Z])(?:[A-Za-z]*[@$!|*0134578€][@$!|*0134578€A-Za-z]*[A-Za-z]|(?:[A-Za-z][._*\-+~^]){2,}[A-Za-z]+)")
_HELD = re.compile(r"([^\W\d_])\1\1")
#: classes of bytes: other, capital, small letter (and all of non-ASCII ones), strong mark, mark
_UPPER, _LOWER, _STRONG, _MARK = 1, 2, 3, 4
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:] = _UPPER, _LOWER, _LOWER
_CLASS[list(b"!?")], _CLASS[list(b".,;:#*$%&-()\"'")] = _STRONG, _MARK
_LISTED = INSULTS | THREATS


def revealed(token: str) -> str:
    """The listed word that a token hides, or nothing."""
    plain = token.lower().translate(DISGUISE).translate(_FILLERS)
    once = re.sub(r"(.)\1+", r"\1", plain)
    twice = re.sub(r"(.)\1\1+", r"\1\1", plain)
    return next((w for w in (plain, twice, once) if w in _LISTED), "")


def units(word: str) -> list[str]:
    """A word and its starts, marked so that neither is a listed word."""
    return [f"={word}", *(f"^{word[:n]}" for n in STARTS if n < len(word))]


class Lexicon(dict):
    """The learned units of each word, found when a word is first met."""

    def __init__(self, learned: frozenset[str] = frozenset()):
        self.learned = learned

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = tuple(u for u in units(word) if u in self.learned)
        return found


def features(text: str, lexicon: Lexicon | None = None) -> tuple[list[float], Counter]:
    """The features of one text, in the order of ``FEATURES``, and its listed words and learned units."""
    words = _WORD.findall(text.lower())
    n, size = max(len(words), 1), max(len(text), 1)
    bad = [i for i, w in enumerate(words) if w in INSULTS]
    threats = [i for i, w in enumerate(words) if w in THREATS]
    you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON], dtype=np.int64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    cells = _CLASS[raw]
    starts = np.flatnonzero(np.diff(cells, prepend=255))
    kind, length = cells[starts], np.diff(starts, append=len(cells))
    apart = np.concatenate([[True], kind[:-1] != _LOWER])[: len(kind)] & np.concatenate([kind[1:] != _LOWER, [True]])[: len(kind)]
    of = np.bincount(cells, minlength=5)
    mixed = _MIXED.findall(text)
    thrice = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (cells[2:] > 0) & (cells[2:] <= _LOWER)
    held = [w for w in text.split() if _HELD.search(w.lower())] if thrice.any() else []
    hidden = [w for w in map(revealed, {*mixed, *held}) if w]
    at = np.array(bad, dtype=np.int64)
    worst = int((np.searchsorted(at, at + STRETCH) - np.arange(len(at))).max()) if len(at) else 0

    def near(places: list[int]) -> int:
        x = np.array(places, dtype=np.int64)
        return int((np.searchsorted(you, x + NEAR, "right") > np.searchsorted(you, x - NEAR, "left")).sum()) if len(you) and len(x) else 0

    value = {
        "insults": len(bad) / n, "n_insults": float(len(bad)), "threats": len(threats) / n, "worst_stretch": float(worst), "insult_kinds": float(len({words[i] for i in bad})),
        "insults_near_you": float(near(bad)), "threats_near_you": float(near(threats)), "second_person": len(you) / n,
        "hidden": float(len(hidden)), "hidden_share": len(hidden) / n, "mixed_words": len(mixed) / n,
        "capitals": of[_UPPER] / size, "shouted": int(((kind == _UPPER) & (length > 2) & apart).sum()) / n,
        "exclaims": text.count("!") / n, "questions": text.count("?") / n, "punctuation": (of[_STRONG] + of[_MARK]) / size,
        "punctuation_runs": int((((kind == _STRONG) & (length > 1)) | ((kind == _MARK) & (length > 2))).sum()) / n,
        "log_words": float(np.log1p(len(words))),
        "first_insult": bad[0] / n if bad else 1.0,
    }
    listed = Counter([words[i] for i in (*bad, *threats)] + hidden)
    if lexicon is not None and lexicon.learned:
        for w, c in Counter(words).items():
            for u in lexicon[w]:
                listed[u] += c
    return [float(value[f]) for f in FEATURES], listed


def matrix(texts: list[str | None], lexicon: Lexicon | None = None) -> tuple[np.ndarray, list[Counter]]:
    rows = [features(t or "", lexicon) for t in texts]
    return np.array([r[0] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES)), [r[1] for r in rows]


def word_weights(listed: list[Counter], y: np.ndarray) -> dict[str, float]:
    """Share of toxic rows among those that hold a word, for every listed word.

    For learned units it is how much oftener toxic rows hold them, as a logarithm, 0 at least.
    """
    share = float(y.mean()) if len(y) else 0.5
    seen, toxic = Counter(), Counter()
    for words, label in zip(listed, y):
        seen.update(words.keys())
        toxic.update(words.keys() if label > 0.5 else ())
    out = {}
    for group in (INSULTS, THREATS):
        pooled = (sum(toxic[w] for w in group) + DRAWN * share) / (sum(seen[w] for w in group) + DRAWN)
        out |= {w: (toxic[w] + DRAWN * pooled) / (seen[w] + DRAWN) for w in group}
    bad, good = float((y > 0.5).sum()) + 1, float((y <= 0.5).sum()) + 1
    of = lambda u: math.log((toxic[u] + 0.5) / bad * good / (seen[u] - toxic[u] + 0.5))
    return out | {u: max(of(u), 0.0) for u in seen if u not in out}


def weighed(x: np.ndarray, listed: list[Counter], weights: dict[str, float]) -> np.ndarray:
    """The features with those of ``WEIGHED`` beside them."""
    more = np.zeros((len(x), len(WEIGHED)))
    for i, words in enumerate(listed):
        if known := [(c, weights[w]) for w, c in words.items() if w in _LISTED]:
            more[i, :2] = sum(c * v for c, v in known), max(v for _, v in known)
        if found := sorted((weights.get(u, 0.0), c) for u, c in words.items() if u not in _LISTED):
            total = sum(c * v for v, c in found)
            more[i, 2:] = total, total, found[-1][0], sum(v > 1 for v, _ in found)
    more[:, [0, 3]] /= np.maximum(np.expm1(x[:, [FEATURES.index("log_words")]]), 1)
    return np.hstack([x, more])


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of ``y`` on ``raw``: equal raw scores share a value."""
    at, where = np.unique(raw, return_inverse=True)
    total, weight = np.bincount(where, y, len(at)), np.bincount(where, minlength=len(at)).astype(float)
    blocks: list[list[float]] = []  # sum, weight, first knot, last knot
    for x, s, w in zip(at, total, weight):
        blocks.append([s, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + w2, blocks[-1][2], hi]
    knots = [(x, s / w) for s, w, lo, hi in blocks for x in ((lo, hi) if hi > lo else (lo,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class Model:
    weights: dict[str, float]
    trees: Trees
    raw: np.ndarray
    share: np.ndarray

    def scores(self, x: np.ndarray, listed: list[Counter]) -> np.ndarray:
        raw = self.trees.scores(weighed(x, listed, self.weights))
        return np.clip(np.interp(raw, self.raw, self.share), 0, 1) if len(self.raw) else raw


def train(x: np.ndarray, listed: list[Counter], y: np.ndarray, fold: np.ndarray) -> Model:
    """Trees from all rows; the calibration from scores of trees that have not seen the row's fold.

    The rows that trees learn from carry word weights learned without their own fold.
    """
    none, folds = np.empty(0), np.unique(fold)
    own = np.zeros((len(x), x.shape[1] + len(WEIGHED)))
    for k in folds:
        out = fold == k
        rest = np.flatnonzero(~out)
        own[out] = weighed(x[out], [listed[i] for i in np.flatnonzero(out)], word_weights([listed[i] for i in rest], y[rest]))
    weights, trees = word_weights(listed, y), fit(own, y, **SHAPE)
    if len(y) < 2 or y.min() == y.max():
        return Model(weights, trees, none, none)
    raw = np.empty(len(y))
    for k in folds:
        out = fold == k
        raw[out] = fit(own[~out], y[~out], **SHAPE).scores(own[out])
    return Model(weights, trees, *isotonic(raw, y))


def learned(joined: DataFrame, toxic: float, clean: float, at_most: int = LEXICON) -> frozenset[str]:
    """The units that tell toxic rows best, by the rows of either label that hold them.

    joined: (text, _y). Tasks send one row per unit and ``REMEMBERED`` counts, never one per word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = Counter(), Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([bad[u] for u in seen], pa.int64())], ["unit", "n", "bad"])

        for b in text_slices(batches, 0, SLICE_BYTES):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held = {u for w in set(_WORD.findall((text or "").lower())) for u in units(w)}
                seen.update(held)
                if y > 0.5:
                    bad.update(held)
                if len(seen) > REMEMBERED:
                    yield told()
                    seen, bad = Counter(), Counter()
        yield told()

    counted = joined.select("text", "_y").mapInArrow(run, "unit string, n long, bad long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ratio = (F.col("bad") + 0.5) / F.lit(toxic + 1) * F.lit(clean + 1) / (F.col("n") - F.col("bad") + 0.5)
    kept = counted.filter(F.col("bad") >= LEAST_ROWS).select("unit", "bad", ratio.alias("ratio")).filter(F.col("ratio") >= LEAST_RATIO)
    best = kept.orderBy((F.col("bad") * F.log("ratio")).desc(), "unit").limit(at_most)
    return frozenset(r.unit for r in best.collect())


def sample(docs: DataFrame, labels: DataFrame, at_most: int = SAMPLE) -> tuple[np.ndarray, list[Counter], np.ndarray, np.ndarray]:
    """Features, listed words and learned units, labels and folds of at most ``at_most`` labelled rows outside the held-out part."""
    mod, out = HELD_OUT
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("double").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (crc_mod(F.col("_id"), mod) != out))
        .withColumn("_h", F.xxhash64("_id", F.lit(12)))
        .orderBy("_h", "_id", "_y")
        .limit(at_most)
        .withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(FOLDS)).cast("int"))
    )
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "_id", "_y", "_fold")

    told = picked.agg(F.count(F.when(F.col("_y") > 0.5, 1)).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    found = learned(joined, told.bad, told.n - told.bad)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(found)
        for b in text_slices(batches, 0, SLICE_BYTES):
            x, listed = matrix(b.column(0).to_pylist(), lexicon)
            words = pa.array([sorted(c.items()) for c in listed], pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(list(x), pa.list_(pa.float64())), words], ["id", "y", "fold", "x", "listed"])

    kind = labels.schema["doc_id"].dataType.simpleString()
    rows = joined.mapInArrow(run, f"id {kind}, y double, fold int, x array<double>, listed map<string,bigint>").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["y"].to_numpy(), rows["id"].to_numpy()))
    listed = [Counter(dict(rows["listed"].iloc[i])) for i in order]
    return x[order], listed, (rows["y"].to_numpy()[order] > 0.5).astype(np.float64), rows["fold"].to_numpy()[order]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) per document row."""

    found = frozenset(model.weights) - _LISTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(found)
        for b in text_slices(batches, 1, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(*matrix(b.column(1).to_pylist(), lexicon)), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(*sample(docs, table(spark, sf_dir, "labels")))
    mod, out = HELD_OUT
    return score(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id"), mod) == out).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted")
    )
