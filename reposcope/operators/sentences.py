"""Sentence boundaries learned from the corpus.

A period ends a sentence unless its word is an abbreviation. Which words are
is learned without labels: a word that stands before a period much more often
than words do by chance has a high log-likelihood ratio, weighed down by its
length and by each time it stands without a period (Kiss and Strunk 2006).
Words that follow a boundary much more often than chance are sentence
starters: before them an abbreviation ends a sentence, too.

Both are counts of words over the corpus, summed in partial aggregates. The
``MOST`` strongest of each kind become constants of a column rule; all others
stay in a table, and texts are joined with it by the words that ask for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions import text as T
from reposcope.session import exploded, merged, stored

#: least score of an abbreviation, its rate of periods, and least log-likelihood of a starter
ABBREVIATION, RATE, STARTER = 0.3, 0.99, 30.0
#: abbreviations, and starters, that the rule has as constants at most; others are joined
MOST = 1000

BARE = r"""^["'(\[]*(.*?)["')\]]*$"""
ABBREVIATED = r"^\p{L}[\p{L}.]*$"
_INITIAL = r"^\p{L}$"


@dataclass
class Model:
    abbreviations: list[str]
    starters: list[str]
    #: (starts, word): starters and abbreviations beyond those lists
    more: DataFrame | None = None


def _words(c) -> Column:
    return F.filter(F.split(T.strip_ws(c), T.WS + "+"), lambda w: w != "")


def _bare(w: Column) -> Column:
    """The word without quotes and brackets around it."""
    return F.regexp_extract(w, BARE, 1)


def _base(bare: Column) -> Column:
    return F.lower(F.regexp_replace(bare, r"[.,;:!?]$", ""))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(base, n_with, n_without): words of letters, and how often each stands before a period and not."""
    # the rules look at each distinct word once
    w = exploded(docs, _words(text_col), "w").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    bare = w.select(_bare(F.col("w")).alias("w"), "n")
    rows = bare.select(_base(F.col("w")).alias("base"), F.col("w").endswith(".").alias("p"), "n").where(F.col("base").rlike(ABBREVIATED))
    zero = F.lit(0).cast("long")
    return rows.groupBy("base").agg(F.sum(F.when(F.col("p"), F.col("n")).otherwise(zero)).alias("n_with"),
                                    F.sum(F.when(F.col("p"), zero).otherwise(F.col("n"))).alias("n_without"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """(base, score): words that are abbreviations, by score."""
    counts = stored(counts, "word_counts")
    total = counts.agg(F.sum(F.col("n_with") + F.col("n_without")).cast("double").alias("n"), F.sum("n_with").cast("double").alias("p")).first()
    if not total["p"]:
        return counts.select("base", F.lit(0.0).alias("score")).limit(0)
    rate = min(max(total["p"] / total["n"], 1e-9), 1 - 1e-9)
    a, b = F.col("n_with"), F.col("n_without")
    ratio = 2 * (a * F.log(F.lit(RATE / rate)) + b * F.log(F.lit((1 - RATE) / (1 - rate))))
    inner = F.length("base") - F.length(F.replace("base", F.lit("."), F.lit("")))
    letters = F.length("base") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -b)
    return counts.where("n_with > 0").select("base", F.round(score, 6).alias("score")).where(F.col("score") >= ABBREVIATION)


def _may_end(w: Column) -> Column:
    """Does a word hold a mark that ends sentences? Few do; the rules are for those."""
    return w.contains(".") | w.contains("!") | w.contains("?")


def _ends(bare: Column, known: list[str]) -> Column:
    """Does a word end a sentence as far as it alone can tell?"""
    base = _base(bare)
    short = base.rlike(_INITIAL) | base.isin(known)
    return F.when(bare.endswith("!") | bare.endswith("?"), True).when(bare.endswith("."), ~short & ~bare.endswith("..")).otherwise(False)


def starter_counts(docs: DataFrame, known: list[str], text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """(word, n, n_after): words of letters, and how often each follows a boundary.
    ``more`` (word) are abbreviations beyond the known ones."""
    words = docs.select(_words(text_col).alias("w"))

    def after(i: Column) -> Column:
        before = F.get("w", i - 1)
        return F.coalesce(_may_end(before) & _ends(_bare(before), known), F.lit(False))

    def item(x: Column, i: Column) -> Column:
        if more is None:
            return F.struct(x.alias("w"), after(i).alias("after"))
        bare = _bare(F.get("w", i - 1))
        return F.struct(x.alias("w"), after(i).alias("after"), F.when(after(i) & bare.endswith("."), _base(bare)).alias("word"))

    rows = exploded(words, F.transform("w", item), "s")
    # the rules look at each distinct word once
    counted = (F.count(F.lit(1)).alias("n"), F.count_if("s.after").alias("n_after"))
    if more is None:
        seen = rows.groupBy("s.w").agg(*counted)
    else:
        seen = stored(rows.groupBy("s.w", "s.word").agg(*counted), "boundaries")
        # what follows one of the others follows no boundary
        wrong = seen.where(F.col("word").isNotNull()).join(merged(more), "word", "left_semi")
        seen = seen.drop("word").unionByName(wrong.select("w", F.lit(0).cast("long").alias("n"), (-F.col("n_after")).alias("n_after")))
    return (seen.select(_base(_bare(F.col("w"))).alias("word"), "n", "n_after").where(F.col("word").rlike(ABBREVIATED))
            .groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_after").alias("n_after")))


def starters(counts: DataFrame) -> DataFrame:
    """(word, score): words that start sentences, by log-likelihood ratio of standing after a boundary."""
    counts = stored(counts, "starter_counts")
    total = counts.agg(F.sum("n").cast("double").alias("n"), F.sum("n_after").cast("double").alias("b")).first()
    n, breaks = total["n"] or 0.0, total["b"] or 0.0
    if not 0 < breaks < n:
        return counts.select("word", F.lit(0.0).alias("score")).limit(0)

    def likelihood(hits: Column, trials, rate: Column) -> Column:
        r = F.greatest(F.least(rate, F.lit(1 - 1e-12)), F.lit(1e-12))
        return hits * F.log(r) + (trials - hits) * F.log(1 - r)

    a, w = F.col("n_after").cast("double"), F.col("n").cast("double")
    outside = F.lit(n) - F.lit(breaks)
    rest = w - a
    even = w / n
    ratio = 2 * (likelihood(a, F.lit(breaks), a / breaks) + likelihood(rest, outside, rest / outside)
                 - likelihood(a, F.lit(breaks), even) - likelihood(rest, outside, even))
    return (counts.where((F.col("n_after") > 0) & (a / breaks > even)).select("word", F.round(ratio, 6).alias("score"))
            .where(F.col("score") >= STARTER))


def learn(docs: DataFrame, text_col: str = "text") -> Model:
    """The abbreviations and starters of a corpus: the ``MOST`` strongest of each
    on the driver, the others in a stored table."""
    def strongest(df: DataFrame, name: str) -> tuple[list[str], DataFrame | None]:
        top = df.orderBy(F.desc("score"), name).limit(MOST + 1).collect()
        if len(top) <= MOST:
            return [r[name] for r in top], None
        last, at = top[MOST], F.col("score")
        others = df.where((at < last["score"]) | ((at == last["score"]) & (F.col(name) >= last[name])))
        return [r[name] for r in top[:MOST]], stored(others.select(F.col(name).alias("word")), f"more-{name}")

    known, more = strongest(abbreviations(word_counts(docs, text_col)), "base")
    first, later = strongest(starters(starter_counts(docs, known, text_col, more)), "word")
    tables = [t.select(F.lit(kind).alias("starts"), "word") for kind, t in ((False, more), (True, later)) if t is not None]
    return Model(known, first, tables[0].unionByName(tables[-1]) if len(tables) == 2 else next(iter(tables), None))


def _rule(words: Column, w: Column, i: Column, model: Model) -> tuple[Column, Column, Column, Column]:
    """The bare word and the one that follows in its line, does it end a sentence, and does a known starter make it do so."""
    bare, following = _bare(w), _bare(F.get(words, i + 1))
    capital = following.rlike(r"^\p{Lu}")
    # an abbreviation or dots end a sentence before a capital word that is known to start one
    late = bare.endswith(".") & capital & _base(following).isin(model.starters)
    ends = _ends(bare, model.abbreviations) & ~(bare.endswith(".") & following.rlike(r"^\p{Ll}"))
    return bare, following, ends, late


def sentences(c, model: Model) -> Column:
    """The sentences of a text, lines apart, words joined by one blank. A
    model with a table of more words takes ``split``."""
    if model.more is not None:
        raise ValueError("a model with more words than its lists hold is joined: use split")

    def marked(line: Column) -> Column:
        def one(words: Column) -> Column:
            def mark(w: Column, i: Column) -> Column:
                _, _, ends, late = _rule(words, w, i, model)
                return F.concat(w, F.when(_may_end(w) & (ends | late), "\n").otherwise(" "))

            return F.array_join(F.transform(words, mark), "")

        return F.get(F.transform(F.array(_words(line)), one), F.lit(0))

    out = F.flatten(F.transform(F.split(T.col(c), "\n"), lambda line: F.split(marked(line), "\n")))
    return F.filter(F.transform(out, lambda s: F.trim(s)), lambda s: s != "")


def _lines(c) -> Column:
    """The words of all lines end to end, each line closed by a line end."""
    return F.flatten(F.transform(F.split(T.col(c), "\n"), lambda line: F.concat(_words(line), F.array(F.lit("\n")))))


def _bound(x: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` has it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _asked(words: Column, model: Model) -> Column:
    """(i, starts, word): where another abbreviation would not end a sentence, or another starter would make it end."""
    def ask(w: Column, i: Column) -> Column:
        bare, following, ends, late = _rule(words, w, i, model)
        is_open = _may_end(w) & bare.endswith(".") & (F.get(words, i + 1) != "\n") & ~late
        asks = F.array(F.when(ends, F.struct(i.alias("i"), F.lit(False).alias("starts"), _base(bare).alias("word"))),
                       F.when(following.rlike(r"^\p{Lu}"), F.struct(i.alias("i"), F.lit(True).alias("starts"), _base(following).alias("word"))))
        return F.when(is_open, asks)

    return F.filter(F.flatten(F.filter(F.transform(words, ask), lambda a: a.isNotNull())), lambda a: a.isNotNull())


def _cut(words: Column, model: Model, off: Column, on: Column) -> Column:
    """The sentences, cut after the words where the lists say so but those at ``off``, and after those at ``on``."""
    def ends_at(w: Column, i: Column) -> Column:
        _, _, ends, late = _rule(words, w, i, model)
        return F.when((w == "\n") | (_may_end(w) & (ends | late)), i)

    none = F.array().cast("array<int>")
    own = F.filter(F.transform(words, ends_at), lambda i: i.isNotNull())
    cuts = F.array_sort(F.array_union(F.array_except(own, F.coalesce(off, none)), F.coalesce(on, none)))

    def between(cuts: Column) -> Column:
        def sentence(end: Column, j: Column) -> Column:
            start = F.coalesce(F.get(cuts, j - 1) + 1, F.lit(0))
            return F.array_join(F.filter(F.slice(words, start + 1, end - start + 1), lambda w: w != "\n"), " ")

        return F.filter(F.transform(cuts, sentence), lambda s: s != "")

    return _bound(cuts, between)


def split(df: DataFrame, c: str, out: str, model: Model) -> DataFrame:
    """``df`` with the sentences of column ``c``, by all words of the model.
    Words that the lists leave open are looked up in the table of the others;
    a text gets back the places where that changes the rule."""
    if model.more is None:
        return df.withColumn(out, sentences(c, model))
    texts = df.select(F.sha2(c, 256).alias("_key"), F.col(c).alias("_text"))
    asked = exploded(texts, _bound(_lines("_text"), lambda words: _asked(words, model)), "a", "_key").select("_key", "a.*")
    found = asked.join(merged(model.more), ["starts", "word"], "left_semi")
    places = found.groupBy("_key").agg(F.collect_set(F.when(~F.col("starts"), F.col("i"))).alias("_off"),
                                       F.collect_set(F.when(F.col("starts"), F.col("i"))).alias("_on"))
    both = df.withColumn("_key", F.sha2(c, 256)).join(merged(places), "_key", "left")
    told = F.struct(_lines(c).alias("w"), F.col("_off").alias("off"), F.col("_on").alias("on"))
    cut = _bound(told, lambda t: _cut(t["w"], model, t["off"], t["on"]))
    return both.withColumn(out, F.when(F.col(c).isNotNull(), cut)).drop("_key", "_off", "_on")
