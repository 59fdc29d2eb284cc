"""Text-generation metrics as Spark jobs.

Every metric explodes tokens / n-grams into rows keyed by the pair id, counts
those of prediction and reference per (pair, n, gram) in one aggregate and
reduces to a handful of sums. No per-row Python except
the LCS kernel of ROUGE-L (bit-parallel, Arrow batches).
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from reposcope.functions import text as T
from reposcope.operators import sentences as SE
from reposcope.session import cut_lineage, exploded, merged, stored

MAX_ORDER = 4


# ---------------------------------------------------------------- n-grams

def ngrams(tokens: Column, n: int) -> Column:
    """ARRAY<STRING> of space-joined n-grams (empty when too short)."""
    return F.when(F.size(tokens) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1),
                              lambda i: F.array_join(F.slice(tokens, i, n), " "))
                  ).otherwise(F.array().cast("array<string>"))


def _tag_order(n: int):
    # one-argument lambda: F.transform passes the element index to 2-arg lambdas
    return lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"))


def _grams(tok_col: str, orders: list[int], side: int) -> Column:
    """The n-grams of a text as (n, g, p, r): p or r tells whose they are."""
    tag = lambda x: F.struct(x["n"].alias("n"), x["g"].alias("g"), F.lit(1 - side).alias("p"), F.lit(side).alias("r"))
    return F.transform(F.flatten(F.array(*[F.transform(ngrams(F.col(tok_col), n), _tag_order(n)) for n in orders])), tag)


def clipped_matches(pairs: DataFrame, key: str, pred_tok: str, ref_tok: str,
                    orders: list[int]) -> DataFrame:
    """(key, n, matches): sum over grams of min(count_pred, count_ref). Both
    sides are counted in one aggregate: no join, and no sort of either."""
    none = F.array().cast("array<struct<n:int,g:string,p:int,r:int>>")
    sides = F.concat(*[F.coalesce(_grams(c, orders, i), none) for i, c in enumerate((pred_tok, ref_tok))])
    e = exploded(pairs.where(F.col(key).isNotNull()), sides, "x", key)
    counts = e.groupBy(key, F.col("x.n").alias("n"), F.col("x.g").alias("g")).agg(F.sum("x.p").alias("cp"), F.sum("x.r").alias("cr"))
    return (counts.where((F.col("cp") > 0) & (F.col("cr") > 0))
            .groupBy(key, "n").agg(F.sum(F.least("cp", "cr")).alias("matches")))


# ---------------------------------------------------------------- BLEU

def bleu(pairs: DataFrame, key: str = "pair_id", pred: str = "prediction", ref: str = "reference",
         smooth: bool = False, max_order: int = MAX_ORDER) -> DataFrame:
    """Corpus BLEU with 13a tokenisation, clipped n-gram precision,
    geometric mean and brevity penalty (``smooth`` adds 1 to every order)."""
    p = pairs.select(key, T.bleu_tokens(pred).alias("tp"), T.bleu_tokens(ref).alias("tr"))
    orders = list(range(1, max_order + 1))
    m = clipped_matches(p, key, "tp", "tr", orders).groupBy("n").agg(F.sum("matches").alias("m"))
    lens = p.agg(F.sum(F.size("tp")).alias("tl"), F.sum(F.size("tr")).alias("rl"),
                 *[F.sum(F.greatest(F.size("tp") - n + 1, F.lit(0))).alias(f"poss{n}") for n in orders])
    mw = m.groupBy().pivot("n", orders).agg(F.first("m"))
    tot = _one_row_join(lens, mw)
    precs = []
    for n in orders:
        mn = F.coalesce(F.col(str(n)), F.lit(0)).cast("double")
        pn = F.col(f"poss{n}").cast("double")
        if smooth:
            precs.append((mn + 1.0) / (pn + 1.0))
        else:
            precs.append(F.when(pn > 0, mn / pn).otherwise(F.lit(0.0)))
    geo = F.when(F.least(*precs) > 0,
                 F.exp(sum(F.log(x) for x in precs) / float(max_order))).otherwise(F.lit(0.0))
    ratio = F.col("tl").cast("double") / F.col("rl").cast("double")
    bp = F.when(ratio > 1.0, F.lit(1.0)).when(ratio > 0, F.exp(1.0 - 1.0 / ratio)).otherwise(F.lit(0.0))
    return tot.select(
        F.round(geo * bp, 6).alias("bleu"),
        *[F.round(x, 6).alias(f"precision_{n}") for x, n in zip(precs, orders)],
        F.round(bp, 6).alias("brevity_penalty"), F.round(ratio, 6).alias("length_ratio"),
        F.col("tl").cast("bigint").alias("translation_length"),
        F.col("rl").cast("bigint").alias("reference_length"))


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two single-row aggregates (no key): both sides are one row by
    construction, so the product is one row."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


# ---------------------------------------------------------------- ROUGE

def rouge_n(pairs: DataFrame, key: str = "pair_id", pred: str = "prediction", ref: str = "reference",
            orders: tuple[int, ...] = (1, 2), stem: bool = False) -> DataFrame:
    """ROUGE-N F1 per pair, averaged over pairs (plain mean)."""
    p = pairs.select(key, T.rouge_tokens(pred).alias("tp"), T.rouge_tokens(ref).alias("tr"))
    if stem:
        p = stem_token_arrays(p, key, ["tp", "tr"])
    m = clipped_matches(p, key, "tp", "tr", list(orders))
    rows = p.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("n"),
                                                      F.greatest(F.size("tp") - n + 1, F.lit(0)).alias("np_"),
                                                      F.greatest(F.size("tr") - n + 1, F.lit(0)).alias("nr_"))
                                             for n in orders])).alias("x"))
    rows = rows.select(key, "x.n", "x.np_", "x.nr_").join(m, [key, "n"], "left")
    ov = F.coalesce("matches", F.lit(0)).cast("double")
    prec = ov / F.greatest(F.col("np_"), F.lit(1))
    rec = ov / F.greatest(F.col("nr_"), F.lit(1))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    per = rows.select(key, "n", f1.alias("f1"))
    out = per.groupBy().pivot("n", list(orders)).agg(F.avg("f1"))
    return out.select(*[F.round(F.col(str(n)), 6).alias(f"rouge{n}") for n in orders])


def _lcs_len(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyrö):
    O(len(a) * len(b) / wordsize) with Python big integers, whole texts."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


@F.pandas_udf(Ty.LongType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_lcs_len(list(x) if x is not None else [], list(y) if y is not None else [])
                      for x, y in zip(a, b)], dtype="int64")


def rouge_l(pairs: DataFrame, key: str = "pair_id", pred: str = "prediction", ref: str = "reference",
            stem: bool = False) -> DataFrame:
    """A10: ROUGE-L F1 per pair (LCS on whole token sequences)."""
    p = pairs.select(key, T.rouge_tokens(pred).alias("tp"), T.rouge_tokens(ref).alias("tr"))
    if stem:
        p = stem_token_arrays(p, key, ["tp", "tr"])
    per = p.select(key, F.size("tp").alias("np_"), F.size("tr").alias("nr_"),
                   lcs_udf("tp", "tr").alias("lcs"))
    prec = F.col("lcs") / F.greatest(F.col("np_"), F.lit(1))
    rec = F.col("lcs") / F.greatest(F.col("nr_"), F.lit(1))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return per.select(key, F.round(f1, 6).alias("rougeL"))


def rouge(pairs: DataFrame, key: str = "pair_id", pred: str = "prediction", ref: str = "reference",
          stem: bool = True) -> DataFrame:
    """A9-A11 as one row: the means of ROUGE-1, -2, -L and -Lsum over the pairs."""
    n = rouge_n(pairs, key, pred, ref, stem=stem)
    mean = lambda df, c: df.agg(F.round(F.avg(c), 6).alias(c))
    return _one_row_join(_one_row_join(n, mean(rouge_l(pairs, key, pred, ref, stem), "rougeL")),
                         mean(rouge_lsum(pairs, key, pred, ref, stem), "rougeLsum"))


# ---------------------------------------------------------------- stemming

@F.pandas_udf(Ty.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    from reposcope.functions.porter import stem
    return words.map(lambda w: w if w is None or len(w) <= 3 else stem(w))


def stem_tokens(tokens: DataFrame, tok_col: str = "token") -> DataFrame:
    """Stem the *distinct* tokens once (Arrow UDF), to be joined back."""
    d = tokens.select(tok_col).distinct()
    return d.select(tok_col, stem_udf(F.col(tok_col)).alias("stem"))


@F.pandas_udf(Ty.ArrayType(Ty.StringType()))
def stem_array_udf(arrays: pd.Series) -> pd.Series:
    from functools import lru_cache

    from reposcope.functions.porter import stem
    one = lru_cache(1 << 16)(lambda w: w if len(w) <= 3 else stem(w))
    return arrays.map(lambda a: None if a is None else [one(w) for w in a])


def stem_token_arrays(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Replace every token of the array columns by its stem, within the row."""
    return df.withColumns({c: stem_array_udf(F.col(c)) for c in cols})


# ---------------------------------------------------------------- language model (U3) and perplexity (A3, A4)

WORD = r"[\p{L}\p{N}]++"
WORD_RE2 = r"[\p{L}\p{N}]+"


def lm_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(T.col(c)), F.lit(WORD), 0)


def train_bigram_lm(corpus: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """Add-one bigram LM trained in Spark: (bigram counts, context counts,
    vocabulary size). The texts are read once: their counts are stored, the
    last token of a text with no follower, so that every token is a ``w1``."""
    t = corpus.select(lm_tokens(text_col).alias("t"))
    bi = exploded(t, F.arrays_zip(F.col("t").alias("w1"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("w2")), "b")
    counts = stored(bi.groupBy(F.col("b.w1").alias("w1"), F.col("b.w2").alias("w2")).agg(F.count(F.lit(1)).alias("c12")), "bigrams")
    big = counts.where("w2 IS NOT NULL")
    ctx = big.groupBy("w1").agg(F.sum("c12").alias("c1"))
    return big, ctx, counts.select("w1").distinct().count() + 1


def token_logprobs(docs: DataFrame, key: str, text_col: str, big: DataFrame, ctx: DataFrame,
                   vocab: int, k: float = 1.0) -> DataFrame:
    """(key, pos, token, logprob) for every token after the first."""
    t = docs.select(key, lm_tokens(text_col).alias("t"))
    e = t.select(key, F.posexplode("t").alias("pos", "w2"),
                 "t").where("pos >= 1").select(key, "pos", F.element_at("t", F.col("pos")).alias("w1"), "w2")
    j = e.join(merged(big), ["w1", "w2"], "left").join(merged(ctx), "w1", "left")
    lp = F.log((F.coalesce("c12", F.lit(0)) + k) / (F.coalesce("c1", F.lit(0)) + k * vocab))
    return j.select(key, "pos", F.col("w2").alias("token"), lp.alias("logprob"))


def perplexity(logprobs: DataFrame, key: str, num_tokens: int = 512) -> DataFrame:
    """A3: exp(-mean logprob) over the first ``num_tokens`` tokens, the first
    token excluded (positions 1 .. num_tokens-1)."""
    lp = logprobs.where((F.col("pos") >= 1) & (F.col("pos") <= num_tokens - 1))
    return lp.groupBy(key).agg(F.round(F.exp(-F.avg("logprob")), 6).alias("perplexity"))


def perplexity_summary(ppl: DataFrame) -> DataFrame:
    """A4: mean and population std."""
    return ppl.agg(F.round(F.avg("perplexity"), 6).alias("average"),
                   F.round(F.stddev_pop("perplexity"), 6).alias("std"),
                   F.count(F.lit(1)).alias("n"))


def gen_len(df: DataFrame, text_col: str, pad: str | None = None) -> DataFrame:
    """Mean generated length in tokens, without those that equal ``pad``."""
    n = T.token_count(text_col)
    if pad is not None:
        n = F.size(F.filter(F.regexp_extract_all(T.col(text_col), F.lit(T.TOKEN), 0), lambda t: t != pad))
    return df.agg(F.round(F.avg(n.cast("double")), 6).alias("gen_len"))


# ---------------------------------------------------------------- language id

def char_trigrams(c) -> Column:
    """Overlapping character trigrams of ' ' + lower(text) + ' ' in one linear
    regex pass (a zero-width lookahead captures the 3 characters at every
    position; ``substring`` per position would be quadratic on UTF-8)."""
    s = F.concat(F.lit(" "), F.lower(T.col(c)), F.lit(" "))
    return F.regexp_extract_all(s, F.lit("(?s)(?=(.{3}))"), 1)


def _counted(items: Column) -> Column:
    """ARRAY<STRUCT<gram, k>>: the distinct items of an array and how often each occurs."""
    def runs(x: Column) -> Column:
        n = F.size(x)
        first = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == 1) | (F.get(x, i - 1) != F.get(x, i - 2))))
        return F.get(F.transform(F.array(first), lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(x, i - 1).alias("gram"), (F.coalesce(F.get(at, j + 1), n + 1) - i).cast("long").alias("k")))), F.lit(0))

    return F.get(F.transform(F.array(F.array_sort(items)), runs), F.lit(0))


def train_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Character-trigram naive Bayes trained in Spark: (gram counts per
    language, per-language totals with log prior and log denominator). The
    counts are stored, so that the trigrams of the texts are cut once."""
    g = exploded(docs, char_trigrams(text_col), "gram", lang_col)
    counts = stored(g.groupBy(lang_col, "gram").agg(F.count(F.lit(1)).alias("c")), "grams")
    n_gram_types = counts.select("gram").distinct().count()
    tot = counts.groupBy(lang_col).agg(F.sum("c").alias("n_lang"))
    docs_per = docs.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n_docs"))
    n_docs = docs_per.agg(F.sum("n_docs")).first()[0]
    lang = (tot.join(docs_per, lang_col)
            .select(lang_col, F.log(F.col("n_docs") / F.lit(float(n_docs))).alias("log_prior"),
                    F.log(F.col("n_lang") + F.lit(float(n_gram_types))).alias("log_den")))
    return counts.select(lang_col, "gram", F.log(F.col("c") + 1.0).alias("log_num")), lang


def detect_language(texts: DataFrame, key: str, text_col: str, counts: DataFrame, lang: DataFrame,
                    lang_col: str = "lang") -> DataFrame:
    """Argmax over languages of log prior + sum over the text's trigrams of
    log((c + 1) / (N_lang + V)); ties -> smaller language code; empty -> 'none'."""
    langs = lang.select(lang_col, "log_prior", "log_den").orderBy(lang_col).collect()  # one row per language
    by_lang = F.map_from_entries(F.collect_list(F.struct(lang_col, "log_num")))
    # one row per gram with a value per language, so no text meets every language as a row
    grams = counts.groupBy("gram").agg(by_lang.alias("m")).select(
        F.col("gram").alias("g"), *[F.coalesce(F.try_element_at("m", F.lit(r[0])), F.lit(0.0)).alias(f"s{i}") for i, r in enumerate(langs)])
    # counted within the row: a text's trigrams are shuffled once, to meet the model
    gc = exploded(texts, _counted(char_trigrams(text_col)), "x", key).select(key, "x.gram", "x.k")
    sums = gc.join(grams.hint("rebalance"), F.col("gram") == F.col("g"), "left").groupBy(key).agg(
        F.sum("k").alias("n_grams"), *[F.coalesce(F.sum(F.col("k") * F.col(f"s{i}")), F.lit(0.0)).alias(f"s{i}") for i in range(len(langs))])
    scored = [F.struct((-F.round(F.lit(r["log_prior"]) + F.col(f"s{i}") - F.col("n_grams") * F.lit(r["log_den"]), 6)).alias("r"), F.lit(r[0]).alias("l"))
              for i, r in enumerate(langs)]
    best = sums.select(key, F.array_min(F.array(*scored))["l"].alias("pred")) if langs else sums.select(key, F.lit(None).cast("string").alias("pred"))
    return texts.select(key).join(best, key, "left").select(key, F.coalesce("pred", F.lit("none")).alias("pred_lang"))


# ---------------------------------------------------------------- markdown raw text (T5)

FENCE = r"(?s)```.*?```|~~~.*?~~~"
# a paragraph underlined with = or - is a heading (possessive for Java; RE2 needs no such thing)
UNDERLINED = r"(?m)(?:^ {0,3}[^\s#>*+|<=-][^\n]*+\n)++ {0,3}(?:=+|-+)[ \t]*$"
UNDERLINED_RE2 = r"(?m)(?:^ {0,3}[^\s#>*+|<=-][^\n]*\n)+ {0,3}(?:=+|-+)[ \t]*$"
HEADING = r"(?m)^ {0,3}#{1,6}(?:[ \t][^\n]*)?$"
# a line of these begins a block of its own, also right under a paragraph
STARTER = r"(?m)^( {0,3}(?:>|[-*+][ \t]|1[.)][ \t]))"
BLOCK_SEP = r"\n[ \t]*\n"
NON_PARAGRAPH = r"^[ ]{0,3}(?:#{1,6}(?:[ \t]|$)|>|[-*+][ \t]|[0-9]+[.)][ \t]|\||<|(?:-{3,}|\*{3,}|_{3,})[ \t]*$)|^(?: {4}|\t)"
INLINE_SPAN = r"`[^`]*`|\*\*[^*]+\*\*|\*[^*\s][^*]*\*|!?\[[^\]]*\]\([^)]*\)|<[^>\s]+>"


def markdown_text(c, max_spans: int | None = None) -> Column:
    """T5: raw text of top-level paragraphs: fenced code, headings, lists,
    quotes, tables, HTML and indented code are dropped; inline code, emphasis,
    links and autolinks split a line into separate text spans; the spans, or
    the first ``max_spans`` of them, are joined by newlines."""
    x = F.regexp_replace(T.col(c), "\r\n?", "\n")
    x = F.regexp_replace(x, FENCE, "\n\n")
    x = F.regexp_replace(x, UNDERLINED, "\n\n")
    x = F.regexp_replace(x, HEADING, "\n\n")
    x = F.regexp_replace(x, STARTER, "\n\n$1")
    blocks = F.split(x, BLOCK_SEP)
    paras = F.filter(blocks, lambda b: (F.trim(F.regexp_replace(b, r"^\n+", "")) != "")
                     & ~F.regexp_replace(b, r"^\n+", "").rlike(NON_PARAGRAPH))

    def spans_of(b):
        lines = F.split(F.regexp_replace(b, r"^\n+|\n+$", ""), "\n")
        segs = F.flatten(F.transform(lines, lambda ln: F.split(
            F.regexp_replace(T.strip_ws(ln), INLINE_SPAN, "\u0001"), "\u0001")))
        return F.filter(segs, lambda s: s != "")

    spans = F.flatten(F.transform(paras, spans_of))
    return F.array_join(spans if max_spans is None else F.slice(spans, 1, max_spans), "\n")


# ---------------------------------------------------------------- ROUGE-Lsum

SENTENCE_SPLIT = r"(?<=[.!?])[ \t\x0B\f\r]++|\n"


def sentence_tokens(c, model: SE.Model | None = None) -> Column:
    """One sentence per element, each tokenised like ROUGE; empty sentences
    dropped. Boundaries are those of a learned ``model``, or without one every
    . ! ? before a blank and every line end."""
    return _tokens_of(F.split(T.strip_ws(c), SENTENCE_SPLIT) if model is None else SE.sentences(c, model))


def _tokens_of(sents: Column) -> Column:
    toks = F.transform(sents, lambda s: T.rouge_tokens(s))
    return F.filter(toks, lambda t: F.size(t) > 0)


def _lcs_indices(a: list[str], b: list[str]) -> list[int]:
    """Indices into ``a`` of one longest common subsequence with ``b``.

    Bit-parallel: row i holds, as bits, where the length of the common
    subsequence of a[:i] grows along b; the way back counts them. Where two
    ways are as long it leaves a token of ``a``, as the metric's table does.
    """
    if not a or not b:
        return []
    masks: dict[str, int] = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    grows, v = [0], full
    for tok in a:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
        grows.append(v ^ full)
    out, i, j = [], len(a), len(b)
    while i > 0 and j > 0:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif (grows[i] & ((1 << j - 1) - 1)).bit_count() > (grows[i - 1] & ((1 << j) - 1)).bit_count():
            j -= 1
        else:
            i -= 1
    return out[::-1]


def summary_lcs_f1(ref_sents: list[list[str]], pred_sents: list[list[str]]) -> float:
    """Summary-level union-LCS F1 with token-count clipping."""
    from collections import Counter
    n_ref = sum(len(s) for s in ref_sents)
    n_pred = sum(len(s) for s in pred_sents)
    if n_ref == 0 or n_pred == 0:
        return 0.0
    cnt_r = Counter(t for s in ref_sents for t in s)
    cnt_p = Counter(t for s in pred_sents for t in s)
    hits = 0
    for r in ref_sents:
        union: set[int] = set()
        for p in pred_sents:
            union.update(_lcs_indices(r, p))
        for i in sorted(union):
            t = r[i]
            if cnt_p[t] > 0 and cnt_r[t] > 0:
                hits += 1
                cnt_p[t] -= 1
                cnt_r[t] -= 1
    prec, rec = hits / n_pred, hits / n_ref
    return 0.0 if prec + rec == 0 else 2 * prec * rec / (prec + rec)


@F.pandas_udf(Ty.DoubleType())
def lsum_udf(ref: pd.Series, pred: pd.Series) -> pd.Series:
    def conv(x):
        return [list(s) for s in x] if x is not None else []
    return pd.Series([summary_lcs_f1(conv(r), conv(p)) for r, p in zip(ref, pred)], dtype="float64")


@F.pandas_udf(Ty.ArrayType(Ty.ArrayType(Ty.StringType())))
def stem_sentences_udf(texts: pd.Series) -> pd.Series:
    from functools import lru_cache

    from reposcope.functions.porter import stem
    one = lru_cache(1 << 16)(lambda w: w if len(w) <= 3 else stem(w))
    return texts.map(lambda t: None if t is None else [[one(w) for w in s] for s in t])


def rouge_lsum(pairs: DataFrame, key: str = "pair_id", pred: str = "prediction", ref: str = "reference",
               stem: bool = False, model: SE.Model | None = None) -> DataFrame:
    """ROUGE-Lsum F1 per pair (sentence split, union LCS)."""
    if model is None:
        p = pairs.select(key, sentence_tokens(pred).alias("sp"), sentence_tokens(ref).alias("sr"))
    else:
        p = SE.split(SE.split(pairs.select(key, pred, ref), pred, "sp", model), ref, "sr", model)
        p = cut_lineage(p.select(key, _tokens_of(F.col("sp")).alias("sp"), _tokens_of(F.col("sr")).alias("sr")))
    if stem:
        p = p.withColumns({c: stem_sentences_udf(F.col(c)) for c in ("sp", "sr")})
    return p.select(key, F.round(lsum_udf("sr", "sp"), 6).alias("rougeLsum"))
