"""Per-file feature assembly (J7), vote matrix (M1) and feature matrix (M2).

Groups that a file does not have (import features for modules outside the
import graph) stay NULL: votes abstain (-1), features are NULL (imputed at
model time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.operators import extract as X
from reposcope.operators import filters as FL
from reposcope.operators import graph as G
from reposcope.operators import resolve as R
from reposcope.session import merged, stored


FEATURE_GROUPS: dict = {}
"""U1: extra feature groups, name -> fn(pyfiles) -> DataFrame(repo_id, path_str, cols...).
Registered groups are left-joined into the assembled table (missing -> NULL)."""


EXTRA_VOTES: list[str] = []
"""Columns of registered groups that are votes in {-1, 0, 1}."""


def register_feature_group(name: str, fn, votes: tuple[str, ...] = ()) -> None:
    """``votes`` names the columns of the group that are labeling functions;
    ``vote_names()`` then lists them after the built-in ones."""
    FEATURE_GROUPS[name] = fn
    EXTRA_VOTES.extend(v for v in votes if v not in EXTRA_VOTES)


def vote_names() -> list[str]:
    return [*P.VOTE_NAMES, *EXTRA_VOTES]


def assemble_features(pyfiles: DataFrame, repos: DataFrame, readmes: DataFrame,
                      setups: DataFrame) -> DataFrame:
    """Every feature group joined on (repo_id, path_str), blacklist applied
    last (import features use blacklisted files as importers). The text of a
    Python file is read once, for a narrow table that all groups share; a
    registered group (U1) gets the files with their text."""
    with_text = pyfiles
    pyfiles = stored(X.file_signals(pyfiles), "signals")
    readmes, setups = stored(readmes, "readmes"), stored(setups, "setups")
    content = X.content_features(pyfiles)
    names = X.filename_features(pyfiles, repos)
    inherit = X.inheritance_counts(pyfiles)

    imps = X.extract_imports(pyfiles)
    edges, _ = R.import_edges(pyfiles, imps)
    gfeat = G.import_features(G.prune_two_way(G.keyed_edges(edges)))

    ep = setups.select("repo_id", F.explode(X.setup_entrypoint_modules(F.col("content"))).alias("module"))
    setup_m = R.setup_mentions(pyfiles, ep)
    r_imps = readmes.select("repo_id", F.explode(X.readme_imports(F.col("content"))).alias("imp"))
    r_exec = readmes.select("repo_id", F.explode(X.module_exec_mentions(F.col("content"))).alias("imp"))
    readme_m = R.readme_mentions(pyfiles, readmes, r_imps.unionByName(r_exec).distinct(),
                                 X.path_mentions(pyfiles, readmes))

    key = ["repo_id", "path_str"]
    base = pyfiles.select("repo_id", "path_str", "path", "ord",
                          F.array_join("module", "/").alias("node"))
    g = gfeat.select("repo_id", "node", "rank", "num_importers", "num_importees", "bottom_rank")
    out = base
    for group in (content, names, inherit, setup_m, readme_m):
        out = out.join(merged(group), key)
    out = out.join(merged(g), ["repo_id", "node"], "left")
    for fn in FEATURE_GROUPS.values():
        out = out.join(merged(fn(with_text)), key, "left")
    return out.where(~FL.blacklisted("path")).drop("path", "node")


def _vote(cond: Column, value: int) -> Column:
    return F.when(cond, F.lit(value)).otherwise(F.lit(-1)).cast("int")


def votes(feats: DataFrame) -> DataFrame:
    """M1: 14 labeling-function columns in {-1 abstain, 0, 1}."""
    c = F.col
    cols = [
        _vote(c("contains_main_func"), 1),
        _vote(c("contains_argument_parser"), 1),
        _vote(c("contains_web_framework"), 1),
        _vote(c("too_short"), 0),
        _vote(c("has_main_in_filename"), 1),
        _vote(c("is_main_ish_names"), 1),
        _vote(c("is_module"), 0),
        _vote(c("is_test_ish_name"), 0),
        _vote(c("has_same_name_as_repo"), 1),
        _vote(F.coalesce(c("rank") == 0, F.lit(False)), 1),
        _vote(F.coalesce(c("bottom_rank"), F.lit(False)), 0),
        _vote(c("num_inherited") >= P.INHERITED_MANY_TIMES, 1),
        c("is_setup_entrypoint").cast("int"),
        c("is_mentioned_in_readme").cast("int"),
    ]
    extra = [c(v) for v in EXTRA_VOTES if v in feats.columns]
    return feats.select("repo_id", "path_str", *[x.alias(n) for x, n in zip(cols, P.VOTE_NAMES)], *extra)


def feature_matrix(feats: DataFrame) -> DataFrame:
    """M2: 14 numeric feature columns (DOUBLE, NULL when the group is missing)."""
    d = "double"
    c = F.col
    cols = [c("contains_main_func").cast(d), c("contains_argument_parser").cast(d),
            c("contains_web_framework").cast(d), c("content_chars").cast(d),
            c("has_main_in_filename").cast(d), c("is_main_ish_names").cast(d), c("is_module").cast(d),
            c("level").cast(d), c("is_test_ish_name").cast(d),
            c("rank").cast(d), c("num_importers").cast(d), c("num_importees").cast(d),
            c("bottom_rank").cast(d), c("num_inherited").cast(d)]
    return feats.select("repo_id", "path_str", *[x.alias(n) for x, n in zip(cols, P.FEATURE_NAMES)])
