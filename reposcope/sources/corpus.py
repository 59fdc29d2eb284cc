"""Derived repository corpus.

The driver tables hold prose, not code. Every code operator therefore runs on
a repository corpus that Spark derives from ``documents`` (its size grows with
the table): 20 consecutive documents form one repository, each document
becomes one file whose Python content is chosen by the hex digits of
``md5(doc_id)`` and which carries the whole document text as comment lines.

The rule is written once as SQL expressions valid in Spark SQL and DuckDB
(only a handful of dialect fragments differ), so the oracle SQL builds the
exact same rows.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.sources.tables import read_table

FILES_PER_REPO = 20

_DIALECT = {
    "spark": {
        "date_plus": "date_add(DATE'2020-01-01', {n})",
        "split_path": "split({x}, '/')",
        "n_bytes": "octet_length({x})",
    },
    "duckdb": {
        "date_plus": "(DATE '2020-01-01' + {n})",
        "split_path": "string_split({x}, '/')",
        "n_bytes": "strlen({x})",
    },
}


def sql_text(s: str) -> str:
    """A Python string as a dialect-neutral SQL expression (newlines and
    backslashes via chr(), no escape processing in either engine)."""
    parts = []
    buf = ""
    for ch in s:
        if ch in ("\n", "\\"):
            if buf:
                parts.append("'" + buf + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            assert ch != "'", "single quotes are not used in templates"
            buf += ch
    if buf:
        parts.append("'" + buf + "'")
    return "(" + " || ".join(parts) + ")" if parts else "''"


def _n(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _import_line(x: str, y: str) -> str:
    t = sql_text
    return (
        f"CASE {x} % 8 "
        f"WHEN 0 THEN {t('import sys, ' + chr(92) + chr(10) + '    json' + chr(10))} "
        f"WHEN 1 THEN {t('from pkg import mod')} || {_n(f'6 + {y} % 6')} || chr(10) "
        f"WHEN 2 THEN {t('from . import mod')} || {_n(f'6 + {y} % 6')} || chr(10) "
        f"WHEN 3 THEN {t('from .core import base')} || {_n(f'13 + {y} % 3')} || chr(10) "
        f"WHEN 4 THEN {t('import mod')} || {_n(f'6 + {y} % 6')} || chr(10) "
        f"WHEN 5 THEN {t('import pkg.core.base')} || {_n(f'13 + {y} % 3')} || {t(' as engine' + chr(10))} "
        f"WHEN 6 THEN {t('from ..pkg import app' + chr(10))} "
        f"ELSE {t('from pkg.cli import (main,' + chr(10) + '    run)' + chr(10))} END"
    )


#: the whole text of the document as comment lines
_COMMENT = "chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10)"


def _python_content() -> str:
    t = sql_text
    header = (f"CASE WHEN lic THEN {t('# Copyright (c) 2021 the repo authors' + chr(10) + '# Licensed under the MIT License' + chr(10) + chr(10))} "
              "ELSE '' END")
    classes = (
        "CASE WHEN ord BETWEEN 13 AND 15 THEN "
        f"'class Base' || {_n('ord - 13')} || {t('(object):' + chr(10) + '    pass' + chr(10) + chr(10))} || "
        f"'class Mixin' || {_n('ord - 13')} || {t(':' + chr(10) + '    pass' + chr(10))} "
        "WHEN d5 % 3 = 1 THEN "
        f"'class Node' || {_n('ord')} || '(Base' || {_n('d6 % 3')} || {t('):' + chr(10) + '    pass' + chr(10))} "
        "WHEN d5 % 3 = 2 THEN "
        f"'class Node' || {_n('ord')} || {t('(' + chr(10) + '    Base')} || {_n('d6 % 3')} || "
        f"{t(',' + chr(10) + '    Mixin')} || {_n('d7 % 3')} || {t(chr(10) + '):' + chr(10) + '    pass' + chr(10))} "
        "ELSE '' END"
    )
    body = (
        f"CASE WHEN ord = 0 OR d7 % 4 = 0 THEN {t('def main():' + chr(10) + '    pass' + chr(10))} ELSE '' END || "
        f"CASE WHEN d8 % 3 = 0 THEN {t('if __name__ == ' + chr(34) + '__main__' + chr(34) + ':' + chr(10) + '    main()' + chr(10))} ELSE '' END || "
        f"CASE WHEN d2 % 4 = 1 THEN {t('parser = argparse.ArgumentParser()' + chr(10))} ELSE '' END || "
        f"CASE WHEN d4 % 6 = 5 THEN {t('app = Flask(__name__)' + chr(10))} ELSE '' END"
    )
    comment = _COMMENT
    return (f"{header} || {_import_line('d1', 'd2')} || {_import_line('d3', 'd4')} || chr(10) || "
            f"{classes} || {body} || {comment}")


def _readme_content() -> str:
    t = sql_text
    mention = (
        f"{t('```python' + chr(10) + 'import pkg.mod')} || {_n('6 + d1 % 6')} || "
        f"{t(chr(10) + '```' + chr(10) + chr(10) + 'Run it with python -m pkg.cli --help' + chr(10) + chr(10) + 'Main code lives in pkg/app.py.' + chr(10))}"
    )
    return (f"'# repo' || {_n('repo_id')} || chr(10) || chr(10) || text || chr(10) || chr(10) || "
            f"CASE WHEN repo_id % 5 = 0 THEN '' ELSE {mention} END")


def _setup_content() -> str:
    t = sql_text
    q = chr(34)
    nl = chr(10)
    rid = _n("repo_id")
    with_ep = (
        f"{t('from setuptools import setup' + nl + nl + 'setup(' + nl + '    name=' + q + 'repo')} || {rid} || "
        f"{t(q + ',' + nl + '    entry_points={' + nl + '        ' + q + 'console_scripts' + q + ': [' + nl + '            ' + q + 'repo')} || {rid} || "
        f"{t('=pkg.cli:main' + q + ',' + nl + '            ' + q + 'repo')} || {rid} || "
        f"{t('-app = pkg.app:run' + q + ',' + nl + '        ],' + nl + '    },' + nl + ')' + nl)}"
    )
    plain = f"{t('from setuptools import setup' + nl + nl + 'setup(name=' + q + 'repo')} || {rid} || {t(q + ')' + nl)}"
    return f"(CASE WHEN repo_id % 3 = 0 THEN {plain} ELSE {with_ep} END || {_COMMENT})"


def _stage1() -> list[str]:
    exprs = [
        "doc_id",
        "text",
        f"CAST(floor(doc_id / {FILES_PER_REPO}) AS BIGINT) AS repo_id",
        f"CAST(doc_id % {FILES_PER_REPO} AS INT) AS ord",
        "lower(text) LIKE '%license%' AS lic",
    ]
    for k in range(1, 9):
        exprs.append(f"instr('0123456789abcdef', substr(md5(CAST(doc_id AS STRING)), {k}, 1)) - 1 AS d{k}")
    return exprs


def _stage2(dialect: str) -> list[str]:
    rel = (
        "CASE WHEN ord = 0 THEN 'main.py' WHEN ord = 1 THEN 'setup.py' WHEN ord = 2 THEN 'README.md' "
        "WHEN ord = 3 THEN 'pkg/__init__.py' WHEN ord = 4 THEN 'pkg/cli.py' WHEN ord = 5 THEN 'pkg/app.py' "
        f"WHEN ord BETWEEN 6 AND 11 THEN 'pkg/mod' || {_n('ord')} || '.py' "
        "WHEN ord = 12 THEN 'pkg/core/__init__.py' "
        f"WHEN ord BETWEEN 13 AND 15 THEN 'pkg/core/base' || {_n('ord')} || '.py' "
        "WHEN ord = 16 THEN 'tests/test_mod6.py' "
        "WHEN ord = 17 AND repo_id % 4 = 3 THEN 'pkg/__pycache__/conf.cpython-38.pyc' "
        "WHEN ord = 17 THEN 'docs/conf.py' WHEN ord = 18 THEN 'data/blob.bin' ELSE 'my-script.py' END"
    )
    prefix = "CASE WHEN repo_id % 2 = 1 AND ord NOT IN (0, 1, 2) THEN 'src/' ELSE '' END"
    raw = (f"CASE WHEN ord = 18 THEN chr(1) || text WHEN ord = 1 THEN {_setup_content()} "
           f"WHEN ord = 2 THEN {_readme_content()} ELSE {_python_content()} END")
    return [
        "repo_id", "ord", "doc_id",
        f"{prefix} || {rel} AS path_str",
        f"{raw} AS raw_content",
    ]


def _stage3(dialect: str) -> list[str]:
    d = _DIALECT[dialect]
    nb = d["n_bytes"].format(x="raw_content")
    return [
        "repo_id", "ord",
        f"{d['split_path'].format(x='path_str')} AS path",
        "path_str",
        f"CAST({nb} AS BIGINT) AS n_bytes",
        # the blob holds a control character, as the binary sniff would find
        f"(raw_content IS NULL OR ord = 18 OR {nb} >= 100000) AS excluded",
        f"CASE WHEN raw_content IS NULL OR ord = 18 OR {nb} >= 100000 THEN NULL ELSE raw_content END AS content",
    ]


def _repo_exprs(dialect: str) -> list[str]:
    d = _DIALECT[dialect]
    return [
        "repo_id",
        f"'user' || {_n('repo_id % 7')} || '/repo' || {_n('repo_id')} AS full_name",
        f"'repo' || {_n('repo_id')} AS name",
        f"{d['date_plus'].format(n='CAST((repo_id * 13) % 365 AS INT)')} AS created_at",
        f"'https://github.com/user' || {_n('repo_id % 7')} || '/repo' || {_n('repo_id')} AS html_url",
        f"CASE WHEN repo_id % 4 = 0 THEN NULL ELSE 'Project repo' || {_n('repo_id')} END AS description",
    ]


def raw_files_sql(dialect: str) -> str:
    """SQL producing the raw file listing of the derived corpus (before the
    ignore-rule filter), as a sub-query over ``documents``."""
    s1 = ", ".join(_stage1())
    s2 = ", ".join(_stage2(dialect))
    s3 = ", ".join(_stage3(dialect))
    name = "element_at(path, -1)" if dialect == "spark" else "path[-1]"
    return (f"SELECT repo_id, ord, path, path_str, {name} AS name, excluded, content, n_bytes FROM ("
            f"SELECT {s3} FROM (SELECT {s2} FROM (SELECT {s1} FROM documents) s1) s2) s3")


def repos_sql(dialect: str) -> str:
    ex = ", ".join(_repo_exprs(dialect))
    return (f"SELECT {ex} FROM (SELECT DISTINCT CAST(floor(doc_id / {FILES_PER_REPO}) AS BIGINT) AS repo_id "
            f"FROM documents) r")


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw file listing (repo_id, ord, path, path_str, name, excluded, content, n_bytes)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    s1 = docs.selectExpr(*_stage1())
    s2 = s1.selectExpr(*_stage2("spark"))
    s3 = s2.selectExpr(*_stage3("spark"))
    return s3.select("repo_id", "ord", "path", "path_str",
                     F.element_at("path", -1).alias("name"), "excluded", "content", "n_bytes")


def _materialized_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    from reposcope.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:16]
    return f"{base.rstrip('/')}/reposcope_corpus/{tag}/{name}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def stage_table(spark: SparkSession, sf_dir: str, name: str, build, sort_cols=("repo_id",),
                key: str = "repo_id") -> DataFrame:
    """A pipeline stage written once per scale factor into the shared
    checkpoint folder, clustered by repo_id, and read back as Parquet by every
    later job (survives executor loss; no recomputation of upstream regex
    work). ``build()`` returns the DataFrame to store."""
    path = _materialized_path(spark, sf_dir, name)
    if not _exists(spark, path):
        df = build()
        # REBALANCE: AQE sizes output partitions to the advisory size (not to
        # the core count) and splits the partition of a hot repository; the
        # sort keeps each file clustered by repo_id for row-group pruning.
        (df.hint("rebalance", key).sortWithinPartitions(*sort_cols)
           .write.mode("overwrite").parquet(path))
    out = spark.read.parquet(path)
    slots = spark.sparkContext.defaultParallelism
    if out.rdd.getNumPartitions() < slots:
        # a small stage (tests, small scale factors) still uses every task slot
        out = out.repartition(slots, key)
    return out


def model_tables(spark: SparkSession, sf_dir: str, name: str, train) -> list[DataFrame]:
    """Model stage: ``train()`` returns several DataFrames that are trained
    together once per scale factor and stored (scoring jobs read them back,
    like a model file)."""
    done = _materialized_path(spark, sf_dir, f"{name}_done")
    path = lambda i: _materialized_path(spark, sf_dir, f"{name}_{i}")
    if not _exists(spark, done):
        n = 0
        for df in train():
            df.write.mode("overwrite").parquet(path(n))
            n += 1
        # the marker comes last: a model without it is trained again
        spark.range(n).write.mode("overwrite").parquet(done)
    return [spark.read.parquet(path(i)) for i in range(spark.read.parquet(done).count())]


def files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest step: the derived file table (see ``stage_table``)."""
    return stage_table(spark, sf_dir, "files", lambda: raw_files(spark, sf_dir), ("repo_id", "ord"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    ids = docs.select(F.floor(F.col("doc_id") / FILES_PER_REPO).cast("bigint").alias("repo_id")).distinct()
    return ids.selectExpr(*_repo_exprs("spark"))
