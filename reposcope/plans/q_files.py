"""Queries over files and text: P*, T*, X*, J4, A1, A2."""

from __future__ import annotations

from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.functions import text as T
from reposcope.operators import extract as X
from reposcope.operators import filters as FL
from reposcope.operators import stats as ST
from reposcope.plans.catalog import (astr, duck, files, pyfiles, query, raw_files, readmes,
                                     repos, setups, tree, tree_all, _sq)
from reposcope.sources.tables import read_table

TOK = _sq(T.TOKEN_RE2)
PIECE = _sq(T.PIECE_RE2)
WPIECE = _sq(T.WORD_PIECE_RE2)
IMP = _sq(P.IMPORT_RE2)
WSCLS = r"[ \t\n\x0B\f\r]"


def _wm(words):
    return _sq(P.word_matcher(words))


# ---------------------------------------------------------------- A2 / A1

def _repo_stats(spark, sf):
    return ST.repo_stats(tree(spark, sf), readmes(spark, sf), repos(spark, sf))


query("repo_stats", duck(f"""
fs AS (SELECT repo_id,
         count_if(NOT (regexp_extract(name, '{_sq(P.PYTHON_FILE)}', 1) <> '' AND NOT excluded)) AS n_excluded,
         count_if(regexp_extract(name, '{_sq(P.PYTHON_FILE)}', 1) <> '' AND NOT excluded) AS n_files,
         sum(CASE WHEN regexp_extract(name, '{_sq(P.PYTHON_FILE)}', 1) <> '' AND NOT excluded
                  THEN len(regexp_extract_all(content, '{TOK}')) ELSE 0 END) AS n_repo_tokens,
         string_agg(CASE WHEN regexp_extract(name, '{_sq(P.PYTHON_FILE)}', 1) <> '' AND NOT excluded
                  THEN CAST(len(regexp_extract_all(content, '{TOK}')) AS VARCHAR) END, ',' ORDER BY path_str) AS n_file_tokens
       FROM tree GROUP BY repo_id)
SELECT r.full_name, coalesce(fs.n_file_tokens, '') AS n_file_tokens,
       CAST(coalesce(len(regexp_extract_all(m.content, '{TOK}')), 0) AS BIGINT) AS n_reference_tokens,
       CAST(coalesce(fs.n_repo_tokens, 0) AS BIGINT) AS n_repo_tokens,
       CAST(coalesce(fs.n_files, 0) AS BIGINT) AS n_files,
       CAST(coalesce(fs.n_excluded, 0) AS BIGINT) AS n_excluded
FROM repos r LEFT JOIN fs USING (repo_id) LEFT JOIN readmes m USING (repo_id)
"""))(_repo_stats)


def _corpus_summary(spark, sf):
    return ST.corpus_summary(_repo_stats(spark, sf))


query("corpus_summary", duck(f"""
fs AS (SELECT repo_id,
         count_if(NOT (regexp_extract(name, '{_sq(P.PYTHON_FILE)}', 1) <> '' AND NOT excluded)) AS n_excluded,
         count_if(regexp_extract(name, '{_sq(P.PYTHON_FILE)}', 1) <> '' AND NOT excluded) AS n_files,
         sum(CASE WHEN regexp_extract(name, '{_sq(P.PYTHON_FILE)}', 1) <> '' AND NOT excluded
                  THEN len(regexp_extract_all(content, '{TOK}')) ELSE 0 END) AS n_repo_tokens
       FROM tree GROUP BY repo_id),
st AS (SELECT CAST(coalesce(len(regexp_extract_all(m.content, '{TOK}')), 0) AS DOUBLE) AS n_reference_tokens,
              CAST(coalesce(fs.n_repo_tokens, 0) AS DOUBLE) AS n_repo_tokens,
              CAST(coalesce(fs.n_files, 0) AS DOUBLE) AS n_files,
              CAST(coalesce(fs.n_excluded, 0) AS DOUBLE) AS n_excluded
       FROM repos r LEFT JOIN fs USING (repo_id) LEFT JOIN readmes m USING (repo_id)),
u AS (SELECT 'n_reference_tokens' AS metric, n_reference_tokens AS v FROM st
      UNION ALL SELECT 'n_repo_tokens', n_repo_tokens FROM st
      UNION ALL SELECT 'n_excluded', n_excluded FROM st
      UNION ALL SELECT 'n_files', n_files FROM st)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median,
       round(max(v), 6) AS max, round(min(v), 6) AS min
FROM u GROUP BY metric
"""))(_corpus_summary)


# ---------------------------------------------------------------- P*

@query("filter_ignored", duck("SELECT repo_id, path_str, ignored FROM raw_flag"))
def _filter_ignored(spark, sf):
    return raw_files(spark, sf).select("repo_id", "path_str", FL.ignored("path").alias("ignored"))


@query("exclude_flags", duck(r"""
SELECT repo_id, path_str, n_bytes >= 100000 AS too_large,
       coalesce(regexp_matches(left(content, 1024), '[\x00-\x06\x0B\x0E-\x1A\x1C-\x1F\x7F]'), false) AS binary,
       excluded
FROM files"""))
def _exclude_flags(spark, sf):
    return FL.exclude_flags(files(spark, sf))


@query("python_files", duck(
    "SELECT repo_id, path_str, base, array_to_string(module, '.') AS module FROM py"))
def _python_files(spark, sf):
    return pyfiles(spark, sf).select("repo_id", "path_str", "base", astr("module").alias("module"))


@query("module_paths", duck(
    "SELECT repo_id, array_to_string(module, '.') AS module, count(*) AS n_paths FROM py GROUP BY ALL"))
def _module_paths(spark, sf):
    return (pyfiles(spark, sf).groupBy("repo_id", astr("module").alias("module"))
            .agg(F.count(F.lit(1)).alias("n_paths")))


@query("pick_readme", duck(
    "SELECT repo_id, name, excluded, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS content_md5 FROM readmes"))
def _pick_readme(spark, sf):
    return readmes(spark, sf).select("repo_id", "name", "excluded",
                                     F.length("content").cast("bigint").alias("n_chars"),
                                     F.md5("content").alias("content_md5"))


@query("pick_setup", duck("SELECT repo_id, name, md5(content) AS content_md5 FROM setups"))
def _pick_setup(spark, sf):
    return setups(spark, sf).select("repo_id", "name", F.md5("content").alias("content_md5"))


@query("repo_gate", duck(f"""
SELECT repo_id, n_files, n_python,
       CASE WHEN n_files > {P.MAX_REPO_FILES} THEN 'too_many_files' WHEN n_files = 0 THEN 'no_files'
            WHEN n_python = 0 THEN 'no_python_file' ELSE 'ok' END AS reason
FROM (SELECT r.repo_id, count(t.repo_id) AS n_files,
             count_if(regexp_extract(t.name, '{_sq(P.PYTHON_FILE)}', 1) <> '' AND NOT t.excluded) AS n_python
      FROM repos r LEFT JOIN tree_all t ON r.repo_id = t.repo_id GROUP BY r.repo_id) g"""))
def _repo_gate(spark, sf):
    return FL.repo_gate(tree_all(spark, sf), repos=repos(spark, sf))


@query("filter_blacklist", duck(
    f"SELECT repo_id, path_str FROM py WHERE NOT list_has_any(path, {''.join(['['] + [', '.join(repr(b) for b in P.BLACKLIST)] + [']'])})"))
def _filter_blacklist(spark, sf):
    return pyfiles(spark, sf).where(~FL.blacklisted("path")).select("repo_id", "path_str")


# ---------------------------------------------------------------- T*

@query("word_match", duck(
    f"SELECT doc_id, regexp_matches(lower(text), '{_wm(P.HEADER_WORDS)}') AS has_license FROM documents"))
def _word_match(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.word_match(F.lower("text"), P.HEADER_WORDS).alias("has_license"))


_COLLAPSE_DUCK = "regexp_replace(replace({x}, chr(13), chr(10)), '\\n\\n+', chr(10) || chr(10), 'g')"


def _collapse_duck(x: str) -> str:
    return _COLLAPSE_DUCK.format(x=x)


@query("cleanse_text", duck(
    f"SELECT doc_id, md5({_collapse_duck('text')}) AS text_md5, CAST(length({_collapse_duck('text')}) AS BIGINT) AS n_chars FROM documents"))
def _cleanse_text(spark, sf):
    d = read_table(spark, sf, "documents")
    c = T.collapse_newlines("text")
    return d.select("doc_id", F.md5(c).alias("text_md5"), F.length(c).cast("bigint").alias("n_chars"))


def _strip_header_duck(x: str) -> str:
    head = f"regexp_extract({x}, '{_sq(T.HEADER_RE2)}', 0)"
    return (f"CASE WHEN length({head}) > 0 AND regexp_matches(lower({head}), '{_wm(P.HEADER_WORDS)}') "
            f"THEN substr({x}, length({head}) + 1) ELSE {x} END")


def _cleanse_duck(x: str) -> str:
    y = _collapse_duck(x)
    y = _strip_header_duck(y)
    y = f"regexp_replace({y}, '{IMP}', '', 'g')"
    y = f"regexp_replace({y}, '\\n\\n+', chr(10) || chr(10), 'g')"
    return f"regexp_replace({y}, '^{WSCLS}+|{WSCLS}+$', '', 'g')"


@query("strip_header", duck(f"""
SELECT repo_id, path_str, md5(h) AS content_md5, CAST(length(h) AS BIGINT) AS n_chars
FROM (SELECT repo_id, path_str, {_strip_header_duck(_collapse_duck('content'))} AS h FROM py) t"""))
def _strip_header(spark, sf):
    h = T.strip_header(T.collapse_newlines("content"))
    return pyfiles(spark, sf).select("repo_id", "path_str", F.md5(h).alias("content_md5"),
                                     F.length(h).cast("bigint").alias("n_chars"))


@query("strip_imports", duck(f"""
SELECT repo_id, path_str, md5(s) AS content_md5, CAST(length(s) AS BIGINT) AS n_chars
FROM (SELECT repo_id, path_str, regexp_replace(content, '{IMP}', '', 'g') AS s FROM py) t"""))
def _strip_imports(spark, sf):
    s = T.strip_imports("content")
    return pyfiles(spark, sf).select("repo_id", "path_str", F.md5(s).alias("content_md5"),
                                     F.length(s).cast("bigint").alias("n_chars"))


@query("cleanse_file", duck(f"""
SELECT repo_id, path_str, md5(s) AS content_md5, CAST(length(s) AS BIGINT) AS n_chars
FROM (SELECT repo_id, path_str, {_cleanse_duck('content')} AS s FROM py) t"""))
def _cleanse_file(spark, sf):
    s = T.cleanse_file("content")
    return pyfiles(spark, sf).select("repo_id", "path_str", F.md5(s).alias("content_md5"),
                                     F.length(s).cast("bigint").alias("n_chars"))


@query("token_count", duck(
    f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{TOK}')) AS BIGINT) AS n_tokens FROM documents"))
def _token_count(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.token_count("text").cast("bigint").alias("n_tokens"))


def _trunc_duck(x: str, n: int) -> str:
    pieces = f"regexp_extract_all({x}, '{PIECE}')"
    return f"CASE WHEN len({pieces}) <= {n} THEN {x} ELSE array_to_string({pieces}[1:{n}], '') END"


@query("truncate_tokens", duck(f"""
SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars
FROM (SELECT doc_id, {_trunc_duck('text', 512)} AS t FROM documents) s"""))
def _truncate_tokens(spark, sf):
    d = read_table(spark, sf, "documents")
    t = T.truncate_tokens("text", 512)
    return d.select("doc_id", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("n_chars"))


@query("truncate_words", duck(f"""
SELECT conv_id, turn, t AS input_text
FROM (SELECT conv_id, CAST(turn AS BIGINT) AS turn,
             CASE WHEN len(regexp_extract_all(text, '{WPIECE}')) < 20 THEN text
                  ELSE array_to_string(regexp_extract_all(text, '{WPIECE}')[1:20], '') END AS t
      FROM conversations) s"""))
def _truncate_words(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                    T.truncate_words("text", 20).alias("input_text"))


# ---------------------------------------------------------------- X*

_IMPORTS_DUCK = f"""
imps_raw AS (
  SELECT repo_id, path_str, module,
         unnest(regexp_extract_all(content, '{IMP}', 1)) AS f,
         unnest(regexp_extract_all(content, '{IMP}', 2)) AS p,
         unnest(regexp_extract_all(content, '{IMP}', 3)) AS l
  FROM py),
imps_items AS (
  SELECT repo_id, path_str, module, trim(f) AS f,
         regexp_replace(trim(it), ' +as +.*$', '') AS item
  FROM (SELECT *, unnest(string_split(regexp_replace(CASE WHEN p <> '' THEN p ELSE l END, '[\\n\\r\\\\]+', ' ', 'g'), ',')) AS it
        FROM imps_raw) s),
imports AS (
  SELECT DISTINCT repo_id, path_str, module,
         list_concat(CASE WHEN f = '' THEN []::VARCHAR[]
                          WHEN regexp_full_match(f, '\\.+') THEN list_transform(range(length(f)), lambda x: '')
                          ELSE string_split(f, '.') END,
                     string_split(item, '.')) AS imp
  FROM imps_items WHERE item <> '')"""


@query("extract_imports", duck(_IMPORTS_DUCK + """
SELECT repo_id, path_str, array_to_string(imp, '.') AS imp FROM imports"""))
def _extract_imports(spark, sf):
    return X.extract_imports(pyfiles(spark, sf)).select("repo_id", "path_str", astr("imp").alias("imp"))


_CLASSES_DUCK = f"""
cls_raw AS (
  SELECT repo_id, path_str,
         unnest(regexp_extract_all(content, '{_sq(P.CLASS_RE)}', 1)) AS cls,
         unnest(regexp_extract_all(content, '{_sq(P.CLASS_RE)}', 2)) AS b,
         unnest(range(len(regexp_extract_all(content, '{_sq(P.CLASS_RE)}', 1)))) AS cls_idx
  FROM py),
classes AS (
  SELECT repo_id, path_str, cls_idx, cls,
         list_distinct(list_filter(list_transform(string_split(regexp_replace(b, '[\\r\\n\\\\]', ' ', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')) AS bases
  FROM cls_raw)"""


@query("extract_classes", duck(_CLASSES_DUCK + """
SELECT repo_id, path_str, CAST(cls_idx AS INT) AS cls_idx, cls, coalesce(array_to_string(list_sort(bases), ','), '') AS bases
FROM classes"""))
def _extract_classes(spark, sf):
    c = X.extract_classes(pyfiles(spark, sf))
    return c.select("repo_id", "path_str", "cls_idx", "cls",
                    F.array_join(F.array_sort("bases"), ",").alias("bases"))


INHERIT_DUCK = _CLASSES_DUCK + """,
cls_defs AS (SELECT DISTINCT repo_id, cls, path_str AS def_path FROM classes),
cls_ment AS (SELECT repo_id, unnest(bases) AS cls FROM classes),
inherit AS (
  SELECT p.repo_id, p.path_str, CAST(coalesce(h.n, 0) AS BIGINT) AS num_inherited
  FROM py p LEFT JOIN (SELECT d.repo_id, d.def_path, count(*) AS n FROM cls_ment m JOIN cls_defs d
                       ON m.repo_id = d.repo_id AND m.cls = d.cls GROUP BY ALL) h
  ON p.repo_id = h.repo_id AND p.path_str = h.def_path)"""


@query("inheritance_counts", duck(INHERIT_DUCK + "\nSELECT repo_id, path_str, num_inherited FROM inherit"))
def _inheritance_counts(spark, sf):
    return X.inheritance_counts(pyfiles(spark, sf))


_CONTENT_DUCK = f"""
content_feats AS (
  SELECT repo_id, path_str,
         regexp_matches(content, '{_wm(P.MAIN_FUNC_WORDS)}') AS contains_main_func,
         regexp_matches(content, '{_wm(P.ARGUMENT_PARSER_WORDS)}') AS contains_argument_parser,
         regexp_matches(content, '{_wm(P.WEB_FRAMEWORK_WORDS)}') AS contains_web_framework,
         CAST(length(content) AS BIGINT) AS content_chars,
         length(content) < {P.TOO_SHORT_CHARS} AS too_short
  FROM py)"""


@query("content_features", duck(_CONTENT_DUCK + "\nSELECT * FROM content_feats"))
def _content_features(spark, sf):
    return X.content_features(pyfiles(spark, sf))


_FILENAME_DUCK = """
name_feats AS (
  SELECT p.repo_id, p.path_str,
         contains(lower(p.name), 'main') AS has_main_in_filename,
         lower(p.name) IN ('cli.py', '_cli.py', 'app.py') AS is_main_ish_names,
         lower(p.name) = '__init__.py' AS is_module,
         starts_with(lower(p.name), 'test_') AS is_test_ish_name,
         coalesce(string_split(lower(p.name), '.')[1] = lower(r.name), false) AS has_same_name_as_repo,
         CAST(len(p.path) - 1 AS BIGINT) AS level
  FROM py p LEFT JOIN repos r USING (repo_id))"""


@query("filename_features", duck(_FILENAME_DUCK + "\nSELECT * FROM name_feats"))
def _filename_features(spark, sf):
    return X.filename_features(pyfiles(spark, sf), repos(spark, sf))


_ENTRY_DUCK = f"""
ep_dicts AS (SELECT repo_id, unnest(regexp_extract_all(content, '{_sq(P.ENTRY_POINTS_RE)}', 1)) AS d FROM setups),
ep_lists AS (SELECT repo_id, unnest(regexp_extract_all(d, '{_sq(P.LIST_RE)}', 1)) AS l FROM ep_dicts),
ep_members AS (SELECT repo_id, coalesce(a, '') || coalesce(b, '') || CASE WHEN c IS NULL OR regexp_matches(c, ':(\\s|$)') THEN '' ELSE regexp_replace(c, '\\s+', ' ', 'g') END AS m FROM (
    SELECT repo_id, unnest(regexp_extract_all(l, '{_sq(P.MEMBER_RE)}', 1)) AS a,
           unnest(regexp_extract_all(l, '{_sq(P.MEMBER_RE)}', 2)) AS b,
           unnest(regexp_extract_all(l, '{_sq(P.MEMBER_RE)}', 3)) AS c FROM ep_lists) s),
ep_eq AS (SELECT repo_id, string_split(trim(m), '=') AS parts FROM ep_members),
ep_rhs AS (SELECT repo_id, string_split(trim(parts[2]), ':') AS parts FROM ep_eq WHERE len(parts) = 2),
entry_mods AS (SELECT DISTINCT repo_id, list_transform(string_split(parts[1], '.'), lambda x: trim(x)) AS module
               FROM ep_rhs WHERE len(parts) = 2)"""


@query("setup_entrypoints", duck(_ENTRY_DUCK + """
SELECT repo_id, array_to_string(module, '.') AS module FROM entry_mods"""))
def _setup_entrypoints(spark, sf):
    s = setups(spark, sf)
    return (s.select("repo_id", F.explode(X.setup_entrypoint_modules(F.col("content"))).alias("m"))
            .select("repo_id", astr("m").alias("module")))


_EXEC_DUCK = f"""
exec_mods AS (SELECT DISTINCT repo_id, string_split(m, '.') AS module FROM (
    SELECT repo_id, unnest(regexp_extract_all(content, '{_sq(P.MODULE_EXEC_RE)}', 1)) AS m FROM readmes) s)"""


@query("module_exec_mentions", duck(_EXEC_DUCK + """
SELECT repo_id, array_to_string(module, '.') AS module FROM exec_mods"""))
def _module_exec_mentions(spark, sf):
    r = readmes(spark, sf)
    return (r.select("repo_id", F.explode(X.module_exec_mentions(F.col("content"))).alias("m"))
            .select("repo_id", astr("m").alias("module")))


_BLOCKS_DUCK = f"""
blocks AS (
  SELECT repo_id, unnest(regexp_extract_all(content, '{_sq(P.CODE_FENCE_RE)}', 1)) AS lang,
         unnest(regexp_extract_all(content, '{_sq(P.CODE_FENCE_RE)}', 2)) AS body,
         unnest(range(len(regexp_extract_all(content, '{_sq(P.CODE_FENCE_RE)}', 1)))) AS block_idx
  FROM readmes)"""


@query("code_blocks", duck(_BLOCKS_DUCK + """
SELECT repo_id, CAST(block_idx AS INT) AS block_idx, lang, md5(body) AS body_md5 FROM blocks"""))
def _code_blocks(spark, sf):
    r = readmes(spark, sf)
    return (r.select("repo_id", F.posexplode(X.code_blocks(F.col("content"))).alias("block_idx", "b"))
            .select("repo_id", "block_idx", F.col("b.lang").alias("lang"), F.md5("b.body").alias("body_md5")))


_README_IMPORTS_DUCK = _BLOCKS_DUCK + f""",
rb_raw AS (
  SELECT repo_id,
         unnest(regexp_extract_all(body, '{IMP}', 1)) AS f,
         unnest(regexp_extract_all(body, '{IMP}', 2)) AS p,
         unnest(regexp_extract_all(body, '{IMP}', 3)) AS l
  FROM blocks WHERE lang = '' OR lang = 'python'),
rb_items AS (
  SELECT repo_id, trim(f) AS f, regexp_replace(trim(it), ' +as +.*$', '') AS item
  FROM (SELECT *, unnest(string_split(regexp_replace(CASE WHEN p <> '' THEN p ELSE l END, '[\\n\\r\\\\]+', ' ', 'g'), ',')) AS it
        FROM rb_raw) s),
readme_imps AS (
  SELECT DISTINCT repo_id,
         list_concat(CASE WHEN f = '' THEN []::VARCHAR[]
                          WHEN regexp_full_match(f, '\\.+') THEN list_transform(range(length(f)), lambda x: '')
                          ELSE string_split(f, '.') END,
                     string_split(item, '.')) AS imp
  FROM rb_items WHERE item <> '')"""


@query("readme_imports", duck(_README_IMPORTS_DUCK + """
SELECT repo_id, array_to_string(imp, '.') AS imp FROM readme_imps"""))
def _readme_imports(spark, sf):
    r = readmes(spark, sf)
    return (r.select("repo_id", F.explode(X.readme_imports(F.col("content"))).alias("m"))
            .select("repo_id", astr("m").alias("imp")))


@query("path_mentions", duck("""
SELECT p.repo_id, p.path_str FROM py p JOIN readmes r ON p.repo_id = r.repo_id
WHERE contains(r.content, p.path_str)"""))
def _path_mentions(spark, sf):
    return X.path_mentions(pyfiles(spark, sf), readmes(spark, sf))
