"""Queries for predictions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.functions import text as T
from reposcope.operators import context as CX
from reposcope.operators import report as RP
from reposcope.plans.catalog import _sq, duck, query, readmes, repos, tree
from reposcope.plans.q_context import MAX_TOKENS, _HORDER, _RANDOM_FIRST, _file_names_duck, _single_duck
from reposcope.plans.q_files import WSCLS

INPUT_TOKENS = 0  # of the README, as a prompt
PROMPT_TOKENS = 20  # of the README, in the queries with a prompt
SYSTEMS = ["random_file", "file_names"]


def _preds(spark, sf, system, tokens=INPUT_TOKENS):
    t, r = tree(spark, sf), repos(spark, sf)
    ctx = (CX.ctx_random_file(t, r, MAX_TOKENS, use_prompt=False) if system == "random_file"
           else CX.ctx_file_names(t, r, MAX_TOKENS, use_prompt=False))
    return RP.predictions(ctx, readmes(spark, sf), r, tokens, system)


def _words_duck(x: str, n: int) -> str:
    if n == 0:
        return "''"
    wp = _sq(T.WORD_PIECE_RE2)
    pieces = f"regexp_extract_all({x}, '{wp}')"
    return f"(CASE WHEN len({pieces}) < {n} THEN {x} ELSE array_to_string({pieces}[1:{n}], '') END)"


def _rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{WSCLS}+$', '')"


def _esc(x: str) -> str:
    y = f"replace({x}, '&', '&amp;')"
    y = f"replace({y}, '<', '&lt;')"
    y = f"replace({y}, '>', '&gt;')"
    y = f"replace({y}, '\"', '&quot;')"
    y = f"replace({y}, '''', '&#x27;')"
    return f"replace({y}, chr(10), '<br/>')"


def _pred_duck(system: str, ctx_cte: str, tokens: int = INPUT_TOKENS) -> str:
    gen = "(CASE WHEN length(input_text) > 0 THEN input_text || ' ' || context ELSE context END)"
    return f"""
pred_{system} AS (
  SELECT repo_id, full_name, html_url, description, input_text, reference, context, '{system}' AS system,
         {_rstrip(gen)} AS result, {_rstrip(f'substr({gen}, length(input_text) + 1)')} AS diff
  FROM (SELECT r.repo_id, r.full_name, r.html_url, r.description, c.context, m.content AS reference,
               {_words_duck('m.content', tokens)} AS input_text
        FROM repos r JOIN {ctx_cte} c ON r.repo_id = c.repo_id JOIN readmes m ON r.repo_id = m.repo_id) x)"""


_PRED = (_HORDER + "," + _RANDOM_FIRST + "," + _single_duck("random_file", False, "rf_first") + ","
         + _file_names_duck(False) + "," + _pred_duck("random_file", "random_file_ctx") + ","
         + _pred_duck("file_names", "file_names_ctx"))
_PROMPTED = (_HORDER + "," + _RANDOM_FIRST + "," + _single_duck("random_file", False, "rf_first") + ","
             + _pred_duck("random_file", "random_file_ctx", PROMPT_TOKENS))


@query("postprocess", duck(_PRED + """
SELECT full_name, md5(result) AS result_md5, md5(diff) AS diff_md5 FROM pred_random_file"""))
def _postprocess(spark, sf):
    p = _preds(spark, sf, "random_file")
    return p.select("full_name", F.md5("result").alias("result_md5"), F.md5("diff").alias("diff_md5"))


@query("edit_record_prompted", duck(_PROMPTED + """
SELECT full_name, md5(input_text) AS prompt_md5, md5(result) AS result_md5, md5(diff) AS diff_md5,
       CAST(length(result) - length(diff) AS INT) AS edit_start FROM pred_random_file"""))
def _edit_record_prompted(spark, sf):
    """P15, P16 behind a prompt: what is generated follows the first words of the README."""
    p = _preds(spark, sf, "random_file", PROMPT_TOKENS)
    e = p.select("full_name", "input_text", "result").join(RP.edit_records(p), "full_name")
    return e.select("full_name", F.md5("input_text").alias("prompt_md5"), F.md5("result").alias("result_md5"),
                    F.md5("edit.text").alias("diff_md5"), F.col("edit.start").cast("int").alias("edit_start"))


@query("edit_record", duck(_PRED + """
SELECT full_name, 'insertion' AS edit_type, CAST(length(result) - length(diff) AS INT) AS edit_start,
       md5(diff) AS edit_text_md5 FROM pred_random_file"""))
def _edit_record(spark, sf):
    e = RP.edit_records(_preds(spark, sf, "random_file"))
    return e.select("full_name", F.col("edit.type").alias("edit_type"), F.col("edit.start").cast("int").alias("edit_start"),
                    F.md5("edit.text").alias("edit_text_md5"))


def _page_duck(title: str, body: str) -> str:
    """The report page as a SQL template: {name} stands for an escaped column."""
    cells = {"n": _esc("full_name"), "u": _esc("coalesce(html_url, '')"), "a": _esc("coalesce(description, '')")}
    return (f"format('<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>{title}</title><style>{{}}</style></head>"
            "<body><header><h1>{}</h1><dl><dt>Repository</dt><dd>{}</dd><dt>About</dt><dd>{}</dd></dl></header>"
            f"<main>{{}}</main></body></html>', '{RP.PAGE_STYLE}', {cells['n']}, {cells['u']}, {cells['a']}, {body})")


def _article_duck(kind: str, caption: str, body: str) -> str:
    return f"format('<article class=\"{kind}\"><h2>{{}}</h2><p>{{}}</p></article>', {caption}, {body})"


_OUTPUT = f"'<mark>' || {_esc('input_text')} || '</mark>' || {_esc('substr(result, length(input_text) + 1)')}"
_TRUTH = _article_duck("truth", "'Readme of the repository'", _esc("reference"))
_HTML_V1 = _page_duck("Readme generation", " || ".join([
    _article_duck("output", "'Written by the model'", _OUTPUT), _TRUTH,
    _article_duck("input", "'What the model was given'", _esc("context"))]))


@query("report_html", duck(_PRED + f"""
SELECT replace(full_name, '/', '.') || '.html' AS file_name, md5({_HTML_V1}) AS html_md5,
       CAST(length({_HTML_V1}) AS BIGINT) AS n_chars FROM pred_random_file"""))
def _report_html(spark, sf):
    h = RP.report_html(_preds(spark, sf, "random_file"))
    return h.select("file_name", F.md5("html").alias("html_md5"), F.length("html").cast("bigint").alias("n_chars"))


@query("write_html", duck(_PRED + f"""
SELECT replace(full_name, '/', '.') || '.html' AS file_name, md5({_HTML_V1}) AS html_md5, full_name AS mapped FROM pred_random_file"""))
def _write_html(spark, sf):
    """One HTML file per repository and the mapping to it, read back."""
    from reposcope.plans.q_sources import _run_dir
    from reposcope.sources import pages
    folder = _run_dir(spark, "pages")
    p = _preds(spark, sf, "random_file")
    of = p.select("full_name", F.concat(F.replace("full_name", F.lit("/"), F.lit(".")), F.lit(".html")).alias("file_name"))
    pages.write_pages(RP.report_html(p).join(of, "file_name").select("full_name", "file_name", "html"), folder)
    mapping = spark.read.schema("full_name string, file_name string").json(f"{folder}/mapping-*.jsonl")
    return pages.read_pages(spark, folder).join(mapping, "file_name").select("file_name", F.md5("html").alias("html_md5"), F.col("full_name").alias("mapped"))


def _all_preds(spark, sf):
    return _preds(spark, sf, SYSTEMS[0]).unionByName(_preds(spark, sf, SYSTEMS[1]))


_ALL = _PRED + """,
preds AS (SELECT * FROM pred_random_file UNION ALL SELECT * FROM pred_file_names)"""


@query("align_systems", duck(_ALL + """
SELECT full_name, count(DISTINCT system) AS n_systems FROM preds GROUP BY full_name"""))
def _align_systems(spark, sf):
    return RP.align_systems(_all_preds(spark, sf), SYSTEMS)


_BLIND = _ALL + f""",
blind AS (SELECT *, CAST(row_number() OVER (PARTITION BY full_name ORDER BY md5('{P.SHUFFLE_SEED}' || ':' || full_name || ':' || system)) - 1 AS INT) AS position FROM preds)"""


@query("ab_blind", duck(_BLIND + "\nSELECT full_name, system, position FROM blind"))
def _ab_blind(spark, sf):
    _, mappings = RP.ab_report(_all_preds(spark, sf), SYSTEMS)
    return mappings


_PART = _article_duck("candidate", "'Candidate ' || CAST(position AS VARCHAR)", _OUTPUT)


@query("ab_report", duck(_BLIND + f""",
per AS (SELECT repo_id, full_name, any_value(html_url) AS html_url, any_value(description) AS description,
               any_value(reference) AS reference, array_to_string(list({_PART} ORDER BY position), '') AS parts
        FROM blind GROUP BY repo_id, full_name),
docs AS (SELECT CASE WHEN length(CAST(repo_id AS VARCHAR)) >= 4 THEN CAST(repo_id AS VARCHAR) ELSE lpad(CAST(repo_id AS VARCHAR), 4, '0') END || '_' || replace(full_name, '/', '.') || '.html' AS file_name,
                {_page_duck('Readme comparison', 'parts || ' + _TRUTH)} AS html FROM per)
SELECT file_name, md5(html) AS html_md5 FROM docs"""))
def _ab_report(spark, sf):
    docs, _ = RP.ab_report(_all_preds(spark, sf), SYSTEMS)
    return docs.select("file_name", F.md5("html").alias("html_md5"))


RESPONSES = f"""
SELECT sha256(CAST(c.repo_id AS VARCHAR) || ':') AS id, 'echo' AS model, md5({_rstrip('c.context')}) AS text_md5,
       CAST(0 AS INT) AS edit_start, md5({_rstrip('c.context')}) AS edit_md5
FROM random_file_ctx c JOIN readmes m ON c.repo_id = m.repo_id"""


def response_columns(df):
    """A response row as plain columns: its first choice and that choice's edit."""
    choice = F.col("choices")[0]
    return df.select("id", "model", F.md5(choice["text"]).alias("text_md5"),
                     choice["edits"][0]["start"].cast("int").alias("edit_start"), F.md5(choice["edits"][0]["text"]).alias("edit_md5"))


@query("serve_requests", duck(_HORDER + "," + _RANDOM_FIRST + "," + _single_duck("random_file", False, "rf_first") + RESPONSES))
def _serve_requests(spark, sf):
    """Request rows (repository, prompt) -> response rows."""
    r = repos(spark, sf)
    reqs = readmes(spark, sf).select("repo_id", T.truncate_words("content", INPUT_TOKENS).alias("prompt"))
    ctx = CX.ctx_random_file(tree(spark, sf), r, MAX_TOKENS, use_prompt=False)
    return response_columns(RP.responses(reqs, ctx))


@query("read_predictions", duck(_ALL + """
SELECT full_name, system, md5(result) AS result_md5 FROM preds"""))
def _read_predictions(spark, sf):
    """S7 + J9: per-system prediction JSONL folders read back and aligned."""
    from reposcope.plans.q_sources import _run_dir
    run = _run_dir(spark, "predictions")
    for system in SYSTEMS:
        RP.write_predictions(_preds(spark, sf, system).drop("system"), f"{run}/{system}")
    back = RP.read_predictions(spark, [f"{run}/{s}" for s in SYSTEMS])
    aligned = RP.align_systems(back, SYSTEMS)
    return back.join(aligned.select("full_name"), "full_name").select(
        "full_name", "system", F.md5("result").alias("result_md5"))
