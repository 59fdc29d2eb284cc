"""Projections, filters and predicates over the flat ``files`` table.

``files`` schema: repo_id BIGINT, ord INT, path ARRAY<STRING>, path_str STRING,
name STRING, excluded BOOLEAN, content STRING, n_bytes BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.functions import text as T


def ignored(path_col="path") -> Column:
    """True when any path prefix, tested as './<prefix>' (directories with
    a trailing '/'), hits an ignore rule. Evaluated per component, so
    multi-component rules fire as intended and dot-components are dropped."""
    p = F.col(path_col)
    n = F.size(p)
    tested = F.transform(
        F.sequence(F.lit(1), n),
        lambda k: F.concat(F.lit("./"), F.array_join(F.slice(p, 1, k), "/"),
                           F.when(k < n, F.lit("/")).otherwise(F.lit(""))))
    return F.exists(tested, lambda s: s.rlike(P.IGNORE_RE))


def filter_ignored(files: DataFrame) -> DataFrame:
    return files.where(~ignored("path"))


def binary_sniff(content_bin) -> Column:
    """First 1024 bytes contain a byte outside the text set."""
    head = F.substring(T.col(content_bin), 1, P.SNIFF_BYTES)
    return F.decode(head, "ISO-8859-1").rlike(r"[^\x07-\x0a\x0c\x0d\x1b\x20-\x7e\x80-\xff]")


def exclude_flags(files: DataFrame) -> DataFrame:
    """P2 + P3 on stored content: size limit and binary sniff."""
    content_bin = F.encode(F.col("content"), "UTF-8")
    return files.select(
        "repo_id", "path_str",
        (F.col("n_bytes") >= P.MAX_FILE_BYTES).alias("too_large"),
        F.coalesce(binary_sniff(content_bin), F.lit(False)).alias("binary"),
        "excluded")


def with_python_base(files: DataFrame) -> DataFrame:
    return files.withColumn("base", T.python_base_name("name"))


def python_files(files: DataFrame) -> DataFrame:
    """Non-excluded files whose whole name is ``<word>.py[cx]?``."""
    return with_python_base(files).where((F.col("base") != "") & ~F.col("excluded"))


def is_readme_candidate() -> Column:
    return (F.size("path") == 1) & F.lower(F.col("name")).contains("readme")


def pick_readme(files: DataFrame) -> DataFrame:
    """Among root-level files whose lower name contains 'readme', the
    shortest name wins (ties: first in traversal order). One row per repo."""
    cand = files.where(is_readme_candidate())
    best = cand.groupBy("repo_id").agg(
        F.min_by(F.struct("name", "excluded", "content", "ord"),
                 F.struct(F.length("name"), F.col("ord"))).alias("readme"))
    return best.select("repo_id", "readme.name", "readme.excluded", "readme.content")


def drop_readme(files: DataFrame) -> DataFrame:
    return files.where(~is_readme_candidate())


def is_root_setup() -> Column:
    return (F.size("path") == 1) & (F.col("name") == "setup.py")


def pick_setup(files: DataFrame) -> DataFrame:
    """Root ``setup.py`` of each repo."""
    return files.where(is_root_setup()).select("repo_id", "name", "excluded", "content")


def drop_setup(files: DataFrame) -> DataFrame:
    return files.where(~is_root_setup())


def tree_files(files: DataFrame) -> DataFrame:
    """Repository tree as the feature extractors see it: ignore rules applied,
    README candidates and root setup.py taken out."""
    return drop_setup(drop_readme(filter_ignored(files)))


def blacklisted(path_col="path") -> Column:
    """Any path component in the blacklist."""
    return F.arrays_overlap(F.col(path_col), F.array(*[F.lit(x) for x in P.BLACKLIST]))


def module_of(path_col="path", base_col="base") -> Column:
    """Path -> module (directories + base name without extension)."""
    p = F.col(path_col)
    return F.concat(F.slice(p, 1, F.size(p) - 1), F.array(F.col(base_col)))


def repo_gate(files: DataFrame, max_files: int = P.MAX_REPO_FILES, repos: DataFrame | None = None) -> DataFrame:
    """P10: 0 < #files <= max and at least one Python file; reason column.
    With ``repos`` each of them has a row, also without any file."""
    agg = with_python_base(files).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if((F.col("base") != "") & ~F.col("excluded")).alias("n_python"))
    if repos is not None:
        zero = F.lit(0).cast("bigint")
        agg = repos.select("repo_id").distinct().join(agg, "repo_id", "left").select(
            "repo_id", F.coalesce("n_files", zero).alias("n_files"), F.coalesce("n_python", zero).alias("n_python"))
    reason = (F.when(F.col("n_files") > max_files, F.lit("too_many_files"))
              .when(F.col("n_files") == 0, F.lit("no_files"))
              .when(F.col("n_python") == 0, F.lit("no_python_file"))
              .otherwise(F.lit("ok")))
    return agg.select("repo_id", "n_files", "n_python", reason.alias("reason"))


def readme_gate(repos: DataFrame, readmes: DataFrame, languages: DataFrame, language: str = "en",
                min_chars: int = P.MIN_README_CHARS) -> DataFrame:
    """One row per repository: does its README exist, is it kept, long
    enough, Markdown and in ``language``? ``languages``: (repo_id, pred_lang)
    of the README's raw text."""
    j = repos.select("repo_id").join(readmes, "repo_id", "left").join(languages, "repo_id", "left")
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    reason = (F.when(F.col("name").isNull(), "missing").when(F.col("excluded"), "excluded")
              .when(F.length("content") < min_chars, "too_short").when(ext != ".md", "not_markdown")
              .when(F.col("pred_lang") != language, "not_english").otherwise("ok"))
    return j.select("repo_id", reason.alias("reason"))


def postprocess(c) -> Column:
    """Right-trim generated text."""
    return T.rstrip_ws(c)


def edit_record(readme_col, diff_col) -> Column:
    """Insertion edit at len(readme) - len(diff)."""
    r, d = T.col(readme_col), T.col(diff_col)
    return F.struct(F.lit("insertion").alias("type"),
                    (F.length(r) - F.length(d)).alias("start"),
                    F.lit(None).cast("int").alias("end"),
                    d.alias("text"))
