"""Queries for context assembly."""

from __future__ import annotations

import regex
from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.functions import text as T
from reposcope.operators import context as CX
from reposcope.operators import features as FE
from reposcope.operators import weak as WK
from reposcope.plans.catalog import _sq, duck, features, query, readmes, repos, tree
from reposcope.plans.q_files import PIECE, TOK, WSCLS, _cleanse_duck
from reposcope.plans.q_labels import _FEATS, proba_duck, ranked_files
from reposcope.sources.corpus import sql_text

MAX_TOKENS = 512
FILE_VOTES = [c for c in P.VOTE_NAMES if c not in P.ANSWER_VOTES]
SEP_TOKENS = len(regex.findall(T.TOKEN_RE2, P.FILE_SEPARATOR))


def _ntok(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOK}'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WSCLS}+|{WSCLS}+$', '', 'g')"


def _trunc(x: str, n: str) -> str:
    pieces = f"regexp_extract_all({x}, '{PIECE}')"
    return f"(CASE WHEN len({pieces}) <= {n} THEN {x} ELSE array_to_string({pieces}[1:{n}], '') END)"


def _prompt_sql(kind: str, use_prompt: bool) -> tuple[str, str]:
    """(prefix, suffix) SQL over repos.name (and ``names`` for entrypoint)."""
    if not use_prompt:
        if kind == "entrypoint":
            return "''", f"{sql_text(P.FILE_SEPARATOR)} || names"
        return "''", "''"
    head = {"all_data": P.PROMPT_ALL_DATA, "entrypoint": P.PROMPT_ENTRYPOINT,
            "random_file": P.PROMPT_RANDOM_FILE, "file_names": P.PROMPT_FILE_NAMES_HEAD}[kind]
    tail = P.PROMPT_FILE_NAMES_TAIL if kind == "file_names" else ""
    pre = (f"'{head}' || CASE WHEN name IS NOT NULL THEN ' called \"' || name || '\"' ELSE '' END || "
           f"'{tail}' || {sql_text(P.PROMPT_OPEN)}")
    suf = sql_text(P.PROMPT_SUFFIX)
    if kind == "entrypoint":
        suf = f"CASE WHEN length(names) > 0 THEN {sql_text(P.PROMPT_NAMES)} || names || {suf} ELSE {suf} END"
    return pre, suf


_HORDER = """
hseed AS (SELECT repo_id, md5(CAST(bit_xor(CAST(('0x' || substr(md5(name), 1, 15)) AS BIGINT)) AS VARCHAR)) AS seed
          FROM tree GROUP BY repo_id),
horder AS (SELECT t.*, sha256(s.seed || t.path_str) AS hkey FROM tree t JOIN hseed s ON t.repo_id = s.repo_id)"""

_NAMES = """
snames AS (SELECT repo_id, array_to_string(list(name ORDER BY rn), ' ') AS names FROM (
    SELECT repo_id, name, row_number() OVER (PARTITION BY repo_id ORDER BY hkey) AS rn FROM horder) t
  WHERE rn <= 10 GROUP BY repo_id)"""


def _out(expr_ctx: str, src: str) -> str:
    return f"SELECT repo_id, md5({expr_ctx}) AS context_md5, CAST(length({expr_ctx}) AS BIGINT) AS n_chars FROM {src}"


def _spark_out(df):
    return df.select("repo_id", F.md5("context").alias("context_md5"),
                     F.length("context").cast("bigint").alias("n_chars"))


# ---------------------------------------------------------------- L1 / W3 / W4

@query("hash_order", duck(_HORDER + "\nSELECT repo_id, path_str, hkey FROM horder"))
def _hash_order(spark, sf):
    return CX.hash_order(tree(spark, sf)).select("repo_id", "path_str", "hkey")


@query("sample_names", duck(_HORDER + "," + _NAMES + "\nSELECT repo_id, names FROM snames"))
def _sample_names(spark, sf):
    return CX.sample_names(tree(spark, sf))


def _budget_concat_duck(budget: str, src_budget: str) -> str:
    return f"""
bc_t AS (SELECT h.repo_id, h.hkey, {_strip('h.content')} AS txt FROM horder h WHERE NOT h.excluded),
bc_c AS (SELECT *, coalesce(sum({_ntok('txt')} + {SEP_TOKENS}) OVER (PARTITION BY repo_id ORDER BY hkey
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bc_t),
bc_b AS (SELECT c.repo_id, array_to_string(list(c.txt ORDER BY c.hkey), {sql_text(P.FILE_SEPARATOR)}) AS body
         FROM bc_c c JOIN {src_budget} b ON c.repo_id = b.repo_id WHERE c.before < {budget} GROUP BY c.repo_id)"""


@query("budget_concat", duck(_HORDER + ", bud AS (SELECT repo_id, 256 AS budget FROM repos)," +
                             _budget_concat_duck("b.budget", "bud") + "\n" +
                             "SELECT repo_id, md5(body) AS body_md5, CAST(length(body) AS BIGINT) AS n_chars FROM bc_b"))
def _budget_concat(spark, sf):
    b = CX.budget_concat(tree(spark, sf), 256)
    return b.select("repo_id", F.md5("body").alias("body_md5"), F.length("body").cast("bigint").alias("n_chars"))


# ---------------------------------------------------------------- C1-C6

def _ctx_all_duck(use_prompt: bool) -> str:
    pre, suf = _prompt_sql("all_data", use_prompt)
    return duck(_HORDER + f""",
ad_r AS (SELECT repo_id, pre, suf, {MAX_TOKENS} - {_ntok('pre')} - {_ntok('suf')} AS budget
         FROM (SELECT repo_id, {pre} AS pre, {suf} AS suf FROM repos) r),""" + _budget_concat_duck("b.budget", "ad_r") + f""",
ad AS (SELECT r.repo_id, r.pre || {_trunc("coalesce(b.body, '')", 'r.budget')} || r.suf AS context
       FROM ad_r r LEFT JOIN bc_b b ON r.repo_id = b.repo_id)
""" + _out("context", "ad"))


@query("ctx_all_data", _ctx_all_duck(False))
def _ctx_all_data(spark, sf):
    return _spark_out(CX.ctx_all_data(tree(spark, sf), repos(spark, sf), MAX_TOKENS))


def _single_duck(kind: str, use_prompt: bool, chosen: str) -> str:
    pre, suf = _prompt_sql(kind, use_prompt)
    names_join = "LEFT JOIN snames s ON r.repo_id = s.repo_id" if kind == "entrypoint" else ""
    names_col = ", coalesce(s.names, '') AS names" if kind == "entrypoint" else ""
    return f"""
{kind}_r AS (SELECT repo_id, pre, suf, {MAX_TOKENS} - {_ntok('pre')} - {_ntok('suf')} AS budget
             FROM (SELECT repo_id, {pre} AS pre, {suf} AS suf FROM (
                   SELECT r.repo_id, r.name{names_col} FROM repos r {names_join}) x) y),
{kind}_ctx AS (SELECT c.repo_id, r.pre || {_trunc(_cleanse_duck('c.content'), 'r.budget')} || r.suf AS context
               FROM {chosen} c JOIN {kind}_r r ON c.repo_id = r.repo_id)"""


_RANDOM_FIRST = f"""
rf_first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY hkey) AS rn FROM horder
             WHERE NOT excluded AND regexp_extract(name, '{_sq(P.PYTHON_FILE)}', 1) <> '') t WHERE rn = 1)"""


@query("ctx_random_file", duck(_HORDER + "," + _RANDOM_FIRST + "," + _single_duck("random_file", True, "rf_first")
                               + "\n" + _out("context", "random_file_ctx")))
def _ctx_random_file(spark, sf):
    return _spark_out(CX.ctx_random_file(tree(spark, sf), repos(spark, sf), MAX_TOKENS, use_prompt=True))


def _file_names_duck(use_prompt: bool) -> str:
    pre, suf = _prompt_sql("file_names", use_prompt)
    return f"""
fn_r AS (SELECT repo_id, pre, suf, {MAX_TOKENS} - {_ntok('pre')} - {_ntok('suf')} AS budget
         FROM (SELECT repo_id, {pre} AS pre, {suf} AS suf FROM repos) r),
fn_c AS (SELECT h.repo_id, h.hkey, h.name, coalesce(sum({_ntok('h.name')}) OVER (PARTITION BY h.repo_id ORDER BY h.hkey
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM horder h),
fn_b AS (SELECT c.repo_id, array_to_string(list(c.name ORDER BY c.hkey), ' ') AS body FROM fn_c c
         JOIN fn_r r ON c.repo_id = r.repo_id WHERE c.before < r.budget GROUP BY c.repo_id),
file_names_ctx AS (SELECT r.repo_id, r.pre || {_trunc("coalesce(b.body, '')", 'r.budget')} || r.suf AS context
                   FROM fn_r r LEFT JOIN fn_b b ON r.repo_id = b.repo_id)"""


@query("ctx_file_names", duck(_HORDER + "," + _file_names_duck(True) + "\n" + _out("context", "file_names_ctx")))
def _ctx_file_names(spark, sf):
    return _spark_out(CX.ctx_file_names(tree(spark, sf), repos(spark, sf), MAX_TOKENS, use_prompt=True))


@query("ctx_dummy", duck("SELECT repo_id, md5('') AS context_md5, CAST(0 AS BIGINT) AS n_chars FROM repos"))
def _ctx_dummy(spark, sf):
    return _spark_out(CX.ctx_dummy(repos(spark, sf)))


def _scores(spark, sf):
    """Given entry-point scores: posterior with fixed accuracies over the votes
    that look at the files alone (deterministic, so the context is checkable)."""
    v = FE.votes(features(spark, sf))
    return v.select("repo_id", "path_str",
                    F.round(WK.posterior({c: WK.DEFAULT_ACC for c in FILE_VOTES}, 0.5, FILE_VOTES), 6).alias("score"))


_ENTRY_BEST = """
ep_best AS (SELECT * FROM (SELECT p.repo_id, p.path_str, t.content,
                   row_number() OVER (PARTITION BY p.repo_id ORDER BY p.proba DESC, p.ord) AS rn
            FROM proba p JOIN tree t ON p.repo_id = t.repo_id AND p.path_str = t.path_str) x WHERE rn = 1)"""

_ENTRY = _FEATS + "," + proba_duck(FILE_VOTES) + "," + _HORDER + "," + _NAMES + "," + _ENTRY_BEST + "," + _single_duck(
    "entrypoint", False, "ep_best")


@query("ctx_entrypoint", duck(_ENTRY + "\n" + _out("context", "entrypoint_ctx")))
def _ctx_entrypoint(spark, sf):
    return _spark_out(CX.ctx_entrypoint(tree(spark, sf), repos(spark, sf), _scores(spark, sf), MAX_TOKENS))


@query("ctx_entrypoint_ranked")
def _ctx_entrypoint_ranked(spark, sf):
    """C2 with the fitted ranker (M5, M6) choosing the entry point."""
    scored = ranked_files(spark, sf).select("repo_id", "path_str", "score")
    return _spark_out(CX.ctx_entrypoint(tree(spark, sf), repos(spark, sf), scored, MAX_TOKENS))


@query("ctx_fallback", duck(_ENTRY + "," + _RANDOM_FIRST + "," + _single_duck("random_file", False, "rf_first") + ","
                            + _file_names_duck(False) + """
SELECT r.repo_id, md5(coalesce(e.context, f.context, n.context)) AS context_md5,
       CASE WHEN e.context IS NOT NULL THEN 'entrypoint' WHEN f.context IS NOT NULL THEN 'random_file'
            ELSE 'file_names' END AS source
FROM repos r LEFT JOIN entrypoint_ctx e ON r.repo_id = e.repo_id LEFT JOIN random_file_ctx f ON r.repo_id = f.repo_id
     LEFT JOIN file_names_ctx n ON r.repo_id = n.repo_id"""))
def _ctx_fallback(spark, sf):
    c = CX.ctx_fallback(tree(spark, sf), repos(spark, sf), _scores(spark, sf), MAX_TOKENS)
    return c.select("repo_id", F.md5("context").alias("context_md5"), "source")


@query("training_pairs", duck(_HORDER + "," + _RANDOM_FIRST + "," + _single_duck("random_file", False, "rf_first") + f""",
tp AS (SELECT c.repo_id, {_trunc('c.context', '1024')} AS source, {_trunc('m.content', '512')} AS target
       FROM random_file_ctx c JOIN readmes m ON c.repo_id = m.repo_id
       WHERE length(c.context) > 0 AND length(m.content) > 0)
SELECT repo_id, md5(source) AS source_md5, md5(target) AS target_md5 FROM tp"""))
def _training_pairs(spark, sf):
    ctx = CX.ctx_random_file(tree(spark, sf), repos(spark, sf), MAX_TOKENS)
    tp = CX.training_pairs(ctx, readmes(spark, sf), 1024, 512)
    return tp.select("repo_id", F.md5("source").alias("source_md5"), F.md5("target").alias("target_md5"))
