"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Spark builders take (spark, sf_dir) and return a DataFrame; those that train a
model, loop to a fixpoint or write a stage table run jobs before they return.
Oracle SQL strings run in DuckDB against the driver tables registered as
views; they rebuild the same derived corpus with ``corpus.raw_files_sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.operators import extract as X
from reposcope.operators import filters as FL
from reposcope.sources import corpus

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        assert name not in REGISTRY, name
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


# ---------------------------------------------------------------------------
# Spark base views of the derived corpus
# ---------------------------------------------------------------------------

def raw_files(spark, sf):
    return corpus.files_table(spark, sf)


def files(spark, sf):
    """Files after the ignore rules (what a directory scan would keep)."""
    return FL.filter_ignored(raw_files(spark, sf))


def repos(spark, sf):
    return corpus.repos(spark, sf)


def tree_all(spark, sf):
    """Repository trees before the repository gate."""
    return FL.tree_files(raw_files(spark, sf))


def tree(spark, sf):
    """Trees of all repositories, whatever their size."""
    return tree_all(spark, sf)


def gated_tree(spark, sf):
    """Trees of the repositories that pass the P10 gate: what the dataset
    writer and the ingest take in."""
    t = tree_all(spark, sf)
    ok = FL.repo_gate(t).where("reason = 'ok'").select("repo_id")
    return t.join(ok, "repo_id", "left_semi")


def pyfiles(spark, sf):
    return X.modules(tree(spark, sf))


def readmes(spark, sf):
    return FL.pick_readme(FL.filter_ignored(raw_files(spark, sf)))


def setups(spark, sf):
    return FL.pick_setup(FL.filter_ignored(raw_files(spark, sf)))


def features(spark, sf):
    """Feature stage (J7 output) stored once per scale factor, like the
    reference pipeline's feature file; the ``assemble_features`` query itself
    always recomputes it."""
    from reposcope.operators import features as FE
    return corpus.stage_table(
        spark, sf, "features",
        lambda: FE.assemble_features(pyfiles(spark, sf), repos(spark, sf), readmes(spark, sf), setups(spark, sf)),
        ("repo_id", "ord"))


def astr(c, sep="."):
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------------------
# DuckDB base CTEs (same rows as the Spark views above)
# ---------------------------------------------------------------------------

def _sq(s: str) -> str:
    return s.replace("'", "''")


IGNORE_RE_SQL = _sq(P.IGNORE_RE)
BLACKLIST_SQL = "[" + ", ".join(f"'{b}'" for b in P.BLACKLIST) + "]"


def duck(body: str) -> str:
    ignored = ("list_bool_or(list_transform(range(1, len(path) + 1), lambda k: regexp_matches("
               "'./' || array_to_string(path[1:k], '/') || CASE WHEN k < len(path) THEN '/' ELSE '' END, "
               f"'{IGNORE_RE_SQL}')))")
    readme_cand = "(len(path) = 1 AND contains(lower(name), 'readme'))"
    root_setup = "(len(path) = 1 AND name = 'setup.py')"
    base = f"regexp_extract(name, '{_sq(P.PYTHON_FILE)}', 1)"
    ctes = [
        f"raw_files AS ({corpus.raw_files_sql('duckdb')})",
        f"raw_flag AS (SELECT *, {ignored} AS ignored FROM raw_files)",
        "files AS (SELECT repo_id, ord, path, path_str, name, excluded, content, n_bytes FROM raw_flag WHERE NOT ignored)",
        f"repos AS ({corpus.repos_sql('duckdb')})",
        f"tree_all AS (SELECT * FROM files WHERE NOT {readme_cand} AND NOT {root_setup})",
        "tree AS (SELECT * FROM tree_all)",
        f"tree_ok AS (SELECT * FROM tree_all WHERE repo_id IN (SELECT repo_id FROM tree_all GROUP BY repo_id "
        f"HAVING count(*) BETWEEN 1 AND {P.MAX_REPO_FILES} AND count_if({base} <> '' AND NOT excluded) > 0))",
        f"py AS (SELECT *, list_concat(path[1:len(path) - 1], [base]) AS module FROM "
        f"(SELECT *, {base} AS base FROM tree) t WHERE base <> '' AND NOT excluded)",
        f"readmes AS (SELECT repo_id, arg_min(name, (length(name), ord)) AS name, "
        f"arg_min(excluded, (length(name), ord)) AS excluded, arg_min(content, (length(name), ord)) AS content "
        f"FROM files WHERE {readme_cand} GROUP BY repo_id)",
        f"setups AS (SELECT repo_id, name, excluded, content FROM files WHERE {root_setup})",
    ]
    return "WITH " + ",\n".join(ctes) + (",\n" + body if not body.lstrip().upper().startswith("SELECT") else "\n" + body)
