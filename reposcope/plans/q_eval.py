"""Queries for evaluation metrics, language id and markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.functions import text as T
from reposcope.operators import metrics as M
from reposcope.operators import sentences as SE
from reposcope.plans.catalog import _sq, duck, query, readmes
from reposcope.sources import corpus
from reposcope.sources.tables import read_table

WS = "[ \\t\\n\\x0B\\f\\r]"


def pairs(spark, sf):
    """Prediction/reference pairs: each assistant turn is scored against the
    user turn it answers (keyed by conv_id:turn)."""
    c = read_table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("reference"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("prediction"))
    return (u.join(a, ["conv_id", "turn"])
            .select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"),
                    "prediction", "reference"))


_PAIRS = """
pairs AS (SELECT CAST(u.conv_id AS VARCHAR) || ':' || CAST(u.turn AS VARCHAR) AS pair_id,
                 a.text AS prediction, u.text AS reference
          FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
          WHERE u.role = 'user' AND a.role = 'assistant')"""


def _bleu_tok_duck(x: str) -> str:
    y = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    y = f"replace(replace(replace(replace({y}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    y = f"(' ' || {y} || ' ')"
    y = f"regexp_replace({y}, '{_sq(T.BLEU_PUNCT)}', ' \\1 ', 'g')"
    y = f"regexp_replace({y}, '([^0-9])([\\.,])', '\\1 \\2 ', 'g')"
    y = f"regexp_replace({y}, '([\\.,])([^0-9])', ' \\1 \\2', 'g')"
    y = f"regexp_replace({y}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    y = f"regexp_replace({y}, '^{WS}+|{WS}+$', '', 'g')"
    return f"(CASE WHEN length({y}) = 0 THEN []::VARCHAR[] ELSE string_split_regex({y}, '{WS}+') END)"


def _rouge_tok_duck(x: str) -> str:
    y = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    return f"(CASE WHEN length({y}) = 0 THEN []::VARCHAR[] ELSE string_split({y}, ' ') END)"


def _grams_duck(name: str, src: str, col: str, orders: list[int]) -> str:
    lst = "[" + ", ".join(str(n) for n in orders) + "]"
    return f"""
{name} AS (SELECT pair_id, n, g, count(*) AS c FROM (
    SELECT pair_id, n, array_to_string({col}[i:i + n - 1], ' ') AS g FROM (
      SELECT pair_id, {col}, n, unnest(range(1, len({col}) - n + 2)) AS i
      FROM {src} CROSS JOIN (SELECT unnest({lst}) AS n) o) t) s GROUP BY ALL)"""


def _bleu_sql(smooth: bool) -> str:
    orders = [1, 2, 3, 4]
    prec = []
    for n in orders:
        m = f"CAST(coalesce(m{n}, 0) AS DOUBLE)"
        pz = f"CAST(poss{n} AS DOUBLE)"
        prec.append(f"(({m} + 1.0) / ({pz} + 1.0))" if smooth else f"(CASE WHEN {pz} > 0 THEN {m} / {pz} ELSE 0.0 END)")
    geo = (f"(CASE WHEN least({', '.join(prec)}) > 0 THEN exp(({' + '.join(f'ln({p})' for p in prec)}) / 4.0) ELSE 0.0 END)")
    ratio = "(CAST(tl AS DOUBLE) / CAST(rl AS DOUBLE))"
    bp = f"(CASE WHEN {ratio} > 1.0 THEN 1.0 WHEN {ratio} > 0 THEN exp(1.0 - 1.0 / {ratio}) ELSE 0.0 END)"
    precs_out = ", ".join(f"round({p}, 6) AS precision_{n}" for p, n in zip(prec, orders))
    return duck(_PAIRS + f""",
btok AS (SELECT pair_id, {_bleu_tok_duck('prediction')} AS tp, {_bleu_tok_duck('reference')} AS tr FROM pairs),"""
                + _grams_duck("gp", "btok", "tp", orders) + "," + _grams_duck("gr", "btok", "tr", orders) + f""",
mt AS (SELECT gp.n, sum(least(gp.c, gr.c)) AS matches FROM gp JOIN gr ON gp.pair_id = gr.pair_id AND gp.n = gr.n AND gp.g = gr.g GROUP BY gp.n),
tot AS (SELECT (SELECT sum(len(tp)) FROM btok) AS tl, (SELECT sum(len(tr)) FROM btok) AS rl,
               {', '.join(f'(SELECT sum(greatest(len(tp) - {n} + 1, 0)) FROM btok) AS poss{n}' for n in orders)},
               {', '.join(f'(SELECT matches FROM mt WHERE n = {n}) AS m{n}' for n in orders)})
SELECT round({geo} * {bp}, 6) AS bleu, {precs_out}, round({bp}, 6) AS brevity_penalty,
       round({ratio}, 6) AS length_ratio, CAST(tl AS BIGINT) AS translation_length, CAST(rl AS BIGINT) AS reference_length
FROM tot""")


@query("bleu", _bleu_sql(False))
def _bleu(spark, sf):
    return M.bleu(pairs(spark, sf))


@query("bleu_smooth", _bleu_sql(True))
def _bleu_smooth(spark, sf):
    return M.bleu(pairs(spark, sf), smooth=True)


def _rouge_sql() -> str:
    orders = [1, 2]
    return duck(_PAIRS + f""",
rtok AS (SELECT pair_id, {_rouge_tok_duck('prediction')} AS tp, {_rouge_tok_duck('reference')} AS tr FROM pairs),"""
                + _grams_duck("rp", "rtok", "tp", orders) + "," + _grams_duck("rr", "rtok", "tr", orders) + """,
rm AS (SELECT rp.pair_id, rp.n, sum(least(rp.c, rr.c)) AS matches FROM rp JOIN rr
       ON rp.pair_id = rr.pair_id AND rp.n = rr.n AND rp.g = rr.g GROUP BY ALL),
rrows AS (SELECT pair_id, n, greatest(len(tp) - n + 1, 0) AS np_, greatest(len(tr) - n + 1, 0) AS nr_
          FROM rtok CROSS JOIN (SELECT unnest([1, 2]) AS n) o),
rf AS (SELECT r.n, CAST(coalesce(m.matches, 0) AS DOUBLE) / greatest(r.np_, 1) AS p,
              CAST(coalesce(m.matches, 0) AS DOUBLE) / greatest(r.nr_, 1) AS rc
       FROM rrows r LEFT JOIN rm m ON r.pair_id = m.pair_id AND r.n = m.n),
rf1 AS (SELECT n, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END AS f1 FROM rf)
SELECT round(avg(f1) FILTER (WHERE n = 1), 6) AS rouge1, round(avg(f1) FILTER (WHERE n = 2), 6) AS rouge2 FROM rf1""")


@query("rouge_n", _rouge_sql())
def _rouge_n(spark, sf):
    return M.rouge_n(pairs(spark, sf))


@query("rouge_l")
def _rouge_l(spark, sf):
    """A10: per-pair ROUGE-L F1 (LCS, bit-parallel kernel)."""
    return M.rouge_l(pairs(spark, sf))


@query("rouge_lsum")
def _rouge_lsum(spark, sf):
    """Per-pair ROUGE-Lsum F1 (learned sentence boundaries + union LCS)."""
    return M.rouge_lsum(pairs(spark, sf), model=SE.learn(read_table(spark, sf, "documents")))


_BASES = f"""
sw AS (SELECT regexp_extract(w, '{_sq(SE.BARE)}', 1) AS w FROM (
  SELECT unnest(list_filter(regexp_split_to_array(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '{WS}+'), lambda x: x <> '')) AS w FROM documents) t),
sb AS (SELECT lower(regexp_replace(w, '[.,;:!?]$', '')) AS base, suffix(w, '.') AS p FROM sw),
sc AS (SELECT base, count_if(p) AS n_with, count_if(NOT p) AS n_without FROM sb WHERE regexp_matches(base, '{SE.ABBREVIATED}') GROUP BY base)"""


@query("sentence_word_counts", "WITH" + _BASES + "\nSELECT base, CAST(n_with AS BIGINT) AS n_with, CAST(n_without AS BIGINT) AS n_without FROM sc")
def _sentence_word_counts(spark, sf):
    """How often each word stands before a period, and not."""
    return SE.word_counts(read_table(spark, sf, "documents"))


@query("abbreviations", "WITH" + _BASES + f""",
st AS (SELECT least(greatest(CAST(sum(n_with) AS DOUBLE) / CAST(sum(n_with + n_without) AS DOUBLE), 1e-9), 1 - 1e-9) AS r FROM sc),
ss AS (SELECT base, n_with AS a, n_without AS b, length(base) - length(replace(base, '.', '')) AS inside, length(replace(base, '.', '')) AS letters FROM sc WHERE n_with > 0),
sr AS (SELECT base, round(2 * (a * ln({SE.RATE} / r) + b * ln((1 - {SE.RATE}) / (1 - r))) * exp(-letters) * (inside + 1) * pow(CAST(letters AS DOUBLE), -b), 6) AS score FROM ss, st)
SELECT base, score FROM sr WHERE score >= {SE.ABBREVIATION}""")
def _abbreviations(spark, sf):
    """The words that are abbreviations, with their scores."""
    return SE.abbreviations(SE.word_counts(read_table(spark, sf, "documents")))


@query("sentence_split")
def _sentence_split(spark, sf):
    """Sentences per document, by boundaries learned from all documents."""
    docs = read_table(spark, sf, "documents")
    s = SE.split(docs.select("doc_id", "text"), "text", "s", SE.learn(docs))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


@query("stem_tokens")
def _stem_tokens(spark, sf):
    """Porter stems of the distinct ROUGE tokens of all pairs."""
    p = pairs(spark, sf)
    toks = p.select(F.explode(F.concat(T.rouge_tokens("prediction"), T.rouge_tokens("reference"))).alias("token"))
    return M.stem_tokens(toks)


@query("rouge_n_stemmed")
def _rouge_n_stemmed(spark, sf):
    """A9 as configured by the source (stemmed tokens)."""
    return M.rouge_n(pairs(spark, sf), stem=True)


@query("gen_len", duck(f"""
SELECT round(avg(CAST(len(regexp_extract_all(text, '{_sq(T.TOKEN_RE2)}')) AS DOUBLE)), 6) AS gen_len
FROM conversations WHERE role = 'assistant'"""))
def _gen_len(spark, sf):
    c = read_table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return M.gen_len(c, "text")


# ---------------------------------------------------------------- LM / perplexity

_LM = f"""
lm_docs AS (SELECT regexp_extract_all(lower(text), '{_sq(M.WORD_RE2)}') AS t FROM documents),
lm_big AS (SELECT w1, w2, count(*) AS c12 FROM (
    SELECT t[i] AS w1, t[i + 1] AS w2 FROM (SELECT t, unnest(range(1, len(t))) AS i FROM lm_docs) a) b GROUP BY ALL),
lm_ctx AS (SELECT w1, sum(c12) AS c1 FROM lm_big GROUP BY w1),
lm_v AS (SELECT count(DISTINCT w) + 1 AS v FROM (SELECT unnest(t) AS w FROM lm_docs) u),
ev AS (SELECT item_id, regexp_extract_all(lower(text), '{_sq(M.WORD_RE2)}') AS t FROM benchmark),
ev_tok AS (SELECT item_id, i - 1 AS pos, t[i - 1] AS w1, t[i] AS w2 FROM (
    SELECT item_id, t, unnest(range(2, len(t) + 1)) AS i FROM ev) a),
ev_lp AS (SELECT e.item_id, e.pos, e.w2 AS token,
                 ln((coalesce(b.c12, 0) + 1.0) / (coalesce(c.c1, 0) + 1.0 * (SELECT v FROM lm_v))) AS logprob
          FROM ev_tok e LEFT JOIN lm_big b ON e.w1 = b.w1 AND e.w2 = b.w2 LEFT JOIN lm_ctx c ON e.w1 = c.w1),
ppl AS (SELECT item_id, round(exp(-avg(logprob)), 6) AS perplexity FROM ev_lp WHERE pos BETWEEN 1 AND 511 GROUP BY item_id)"""


def _stored_lm(spark, sf):
    """Bigram LM trained once per scale factor (model stage)."""
    def train():
        big, ctx, v = M.train_bigram_lm(read_table(spark, sf, "documents"))
        return [big, ctx, spark.range(1).select(F.lit(v).cast("long").alias("vocab"))]
    big, ctx, v = corpus.model_tables(spark, sf, "bigram_lm", train)
    return big, ctx, int(v.first()["vocab"])


def _ppl(spark, sf):
    big, ctx, v = _stored_lm(spark, sf)
    lp = M.token_logprobs(read_table(spark, sf, "benchmark"), "item_id", "text", big, ctx, v)
    return M.perplexity(lp, "item_id", 512)


@query("perplexity", duck(_LM + "\nSELECT item_id, perplexity FROM ppl"))
def _perplexity(spark, sf):
    return _ppl(spark, sf)


@query("perplexity_summary", duck(_LM + """
SELECT round(avg(perplexity), 6) AS average, round(stddev_pop(perplexity), 6) AS std, count(*) AS n FROM ppl"""))
def _perplexity_summary(spark, sf):
    return M.perplexity_summary(_ppl(spark, sf))


@query("ngram_lm", duck(_LM + "\nSELECT w1, w2, CAST(c12 AS BIGINT) AS c12 FROM lm_big"))
def _ngram_lm(spark, sf):
    big, _, _ = M.train_bigram_lm(read_table(spark, sf, "documents"))
    return big.select("w1", "w2", F.col("c12").cast("bigint").alias("c12"))


# ---------------------------------------------------------------- language id / markdown

def _tri_duck(tbl: str, key: str, text: str) -> str:
    return (f"SELECT {key}, substr(s, i, 3) AS gram FROM (SELECT {key}, s, unnest(range(1, length(s) - 1)) AS i "
            f"FROM (SELECT {key}, ' ' || lower({text}) || ' ' AS s FROM {tbl}) a) b")


_LANG = f"""
li_counts AS (SELECT lang, gram, count(*) AS c FROM ({_tri_duck('documents', 'lang', 'text')}) g GROUP BY ALL),
li_v AS (SELECT count(DISTINCT gram) AS v FROM li_counts),
li_docs AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang),
li_lang AS (SELECT t.lang, ln(CAST(d.n_docs AS DOUBLE) / (SELECT sum(n_docs) FROM li_docs)) AS log_prior,
                   ln(t.n_lang + CAST((SELECT v FROM li_v) AS DOUBLE)) AS log_den
            FROM (SELECT lang, sum(c) AS n_lang FROM li_counts GROUP BY lang) t JOIN li_docs d ON t.lang = d.lang),
li_num AS (SELECT lang, gram, ln(c + 1.0) AS log_num FROM li_counts)"""


def _detect_duck(tbl: str, key: str, text: str) -> str:
    return f"""
dl_gc AS (SELECT {key}, gram, count(*) AS k FROM ({_tri_duck(tbl, key, text)}) g GROUP BY ALL),
dl_n AS (SELECT {key}, sum(k) AS n_grams FROM dl_gc GROUP BY {key}),
dl_seen AS (SELECT g.{key}, m.lang, sum(g.k * m.log_num) AS s FROM dl_gc g JOIN li_num m ON g.gram = m.gram GROUP BY ALL),
dl_sc AS (SELECT n.{key}, l.lang, round(l.log_prior + coalesce(s.s, 0.0) - n.n_grams * l.log_den, 6) AS score
          FROM dl_n n CROSS JOIN li_lang l LEFT JOIN dl_seen s ON n.{key} = s.{key} AND l.lang = s.lang),
dl_best AS (SELECT {key}, lang AS pred FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, lang) AS rn
                                              FROM dl_sc) t WHERE rn = 1),
dl_out AS (SELECT x.{key}, coalesce(b.pred, 'none') AS pred_lang FROM {tbl} x LEFT JOIN dl_best b ON x.{key} = b.{key})"""


def _lang_model(spark, sf):
    """Trigram language model trained once per scale factor (model stage)."""
    counts, lang = corpus.model_tables(
        spark, sf, "langid", lambda: list(M.train_language_model(read_table(spark, sf, "documents"))))
    return counts, lang


@query("train_language_model", duck(_LANG + """
SELECT lang, round(log_prior, 6) AS log_prior, round(log_den, 6) AS log_den FROM li_lang"""))
def _train_language_model(spark, sf):
    """T6 training step (always retrains): per-language prior and denominator."""
    _, lang = M.train_language_model(read_table(spark, sf, "documents"))
    return lang.select("lang", F.round("log_prior", 6).alias("log_prior"), F.round("log_den", 6).alias("log_den"))


@query("detect_language", duck(_LANG + "," + _detect_duck("documents", "doc_id", "text") + "\nSELECT * FROM dl_out"))
def _detect_language(spark, sf):
    counts, lang = _lang_model(spark, sf)
    d = read_table(spark, sf, "documents")
    return M.detect_language(d, "doc_id", "text", counts, lang)


def _md_duck(x: str, max_spans: int | None = None) -> str:
    y = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    for rule in (M.FENCE, M.UNDERLINED_RE2, M.HEADING):
        y = f"regexp_replace({y}, '{_sq(rule)}', chr(10) || chr(10), 'g')"
    y = f"regexp_replace({y}, '{_sq(M.STARTER)}', chr(10) || chr(10) || '\\1', 'g')"
    blocks = f"string_split_regex({y}, '{_sq(M.BLOCK_SEP)}')"
    paras = (f"list_filter({blocks}, lambda b: trim(regexp_replace(b, '^\\n+', '')) <> '' AND NOT "
             f"regexp_matches(regexp_replace(b, '^\\n+', ''), '{_sq(M.NON_PARAGRAPH)}'))")
    strip = "regexp_replace(ln, '^" + WS + "+|" + WS + "+$', '', 'g')"
    spans = (f"flatten(list_transform({paras}, lambda b: list_filter(flatten(list_transform("
             f"string_split(regexp_replace(b, '^\\n+|\\n+$', '', 'g'), chr(10)), lambda ln: "
             f"string_split(regexp_replace({strip}, '{_sq(M.INLINE_SPAN)}', chr(1), 'g'), chr(1)))), lambda s: s <> '')))")
    return f"array_to_string({spans}{'' if max_spans is None else f'[1:{max_spans}]'}, chr(10))"


@query("markdown_text", duck(f"""
SELECT repo_id, md5(raw) AS raw_md5, CAST(length(raw) AS BIGINT) AS n_chars
FROM (SELECT repo_id, {_md_duck('content')} AS raw FROM readmes) t"""))
def _markdown_text(spark, sf):
    r = readmes(spark, sf)
    raw = M.markdown_text("content")
    return r.select("repo_id", F.md5(raw).alias("raw_md5"), F.length(raw).cast("bigint").alias("n_chars"))


README_GATE = (_LANG + f""",
rg_raw AS (SELECT repo_id, name, excluded, content, left({_md_duck('content', P.RAW_TEXT_MAX_SPANS)}, {P.README_LANG_CHARS}) AS raw FROM readmes),
""" + _detect_duck("rg_raw", "repo_id", "raw").lstrip() + f""",
rgate AS (SELECT r.repo_id,
       CASE WHEN m.repo_id IS NULL THEN 'missing' WHEN m.excluded THEN 'excluded'
            WHEN length(m.content) < {P.MIN_README_CHARS} THEN 'too_short'
            WHEN lower(regexp_extract(m.name, '(\\.[^.]*)$', 1)) <> '.md' THEN 'not_markdown'
            WHEN d.pred_lang <> 'en' THEN 'not_english' ELSE 'ok' END AS reason
FROM repos r LEFT JOIN rg_raw m ON r.repo_id = m.repo_id LEFT JOIN dl_out d ON r.repo_id = d.repo_id)""")


def readme_reasons(spark, sf):
    from reposcope.operators import filters as FL
    from reposcope.plans.catalog import repos
    r = readmes(spark, sf)
    raw = r.select("repo_id", F.substring(M.markdown_text("content", P.RAW_TEXT_MAX_SPANS), 1,
                                          P.README_LANG_CHARS).alias("raw"))
    return FL.readme_gate(repos(spark, sf), r, language_detector(spark, sf)(raw))


def language_detector(spark, sf):
    """T6 with the trained model, on (repo_id, raw)."""
    model = _lang_model(spark, sf)
    return lambda raw: M.detect_language(raw, "repo_id", "raw", *model)


@query("readme_gate", duck(README_GATE + "\nSELECT repo_id, reason FROM rgate"))
def _readme_gate(spark, sf):
    return readme_reasons(spark, sf)


@query("all_metrics")
def _all_metrics(spark, sf):
    """BLEU, smoothed BLEU and stemmed ROUGE-1/2/L/Lsum on full texts and on markdown raw
    text (first 10 spans); one row per variant."""
    p = pairs(spark, sf)
    raw = p.select("pair_id", M.markdown_text("prediction", P.RAW_TEXT_MAX_SPANS).alias("prediction"),
                   M.markdown_text("reference", P.RAW_TEXT_MAX_SPANS).alias("reference"))
    out = None
    for name, df in (("full", p), ("raw_text", raw)):
        b = M.bleu(df).select(F.lit(name).alias("variant"), "bleu")
        bs = M.bleu(df, smooth=True).select(F.col("bleu").alias("bleus"))
        r = M.rouge(df)
        row = M._one_row_join(M._one_row_join(b, bs), r)
        out = row if out is None else out.unionByName(row)
    return out
