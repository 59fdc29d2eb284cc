"""Import resolution (J1-J3) and README / setup.py mentions.

The source tests an import against every candidate module with a Python
predicate (a theta join, O(n^3) per repository). Here the predicate is turned
into an equi-join: an import ``P`` made in module ``I`` can only resolve to a
module whose path ``C`` (without a trailing ``__init__``) is one of a handful
of *keys* derived from (I, P):

* relative (``P[0] == ''``, n = number of '' parts, all leading):
  ``I[:-n] ++ P[n:n+k]`` for k = 0..|P|-n
* absolute: ``P[:k]`` for k = 1..|P|, and (implicit relative)
  ``I[:-1] ++ P[:k]`` for k = 0..|P|
* the empty key only for ``P == ['.']``.

So resolution is: explode keys -> hash join on (repo_id, key) -> the best
candidate as an aggregate. An import is tried under every source root of its
repository, but has no row per root: below a root of length r its keys depend
on r alone (``import_keys``), and the keys that contain the root itself are
found by splitting the candidate (``candidate_keys``). No pairs of modules are
ever formed, and no window holds a repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.session import merged, stored


def _slice_upto(a: Column, n: Column) -> Column:
    """a[:n] for n >= 0 (Python semantics: n past the end -> whole array)."""
    return F.slice(a, 1, F.greatest(n, F.lit(0)))


def resolution_keys(I: Column, Pc: Column) -> Column:
    """ARRAY<ARRAY<STRING>>: module keys C for which the import resolves."""
    n = F.size(F.filter(Pc, lambda x: x == ""))
    lead_ok = F.forall(F.slice(Pc, 1, n), lambda x: x == "")
    t_rel = _slice_upto(I, F.size(I) - n)
    rel = F.transform(F.sequence(F.lit(0), F.size(Pc) - n),
                      lambda k: F.concat(t_rel, F.slice(Pc, n + 1, k)))
    t_abs = _slice_upto(I, F.size(I) - 1)
    absk = F.concat(
        F.transform(F.sequence(F.lit(1), F.size(Pc)), lambda k: F.slice(Pc, 1, k)),
        F.transform(F.sequence(F.lit(0), F.size(Pc)), lambda k: F.concat(t_abs, F.slice(Pc, 1, k))))
    keys = (F.when(F.element_at(Pc, 1) == "",
                   F.when(lead_ok, rel).otherwise(F.array().cast("array<array<string>>")))
            .otherwise(absk))
    dot = F.array(F.lit("."))
    nonempty = F.filter(keys, lambda k: F.size(k) > 0)
    return F.when(Pc == dot, F.concat(nonempty, F.array(F.array().cast("array<string>")))).otherwise(nonempty)


def key_str(c: Column) -> Column:
    return F.array_join(c, "/")


#: separates the kind of a key from its path; no path has it
_SEP = "\u0001"


def _tagged(tag: Column | str, *parts: Column) -> Column:
    t = F.lit(tag) if isinstance(tag, str) else tag.cast("string")
    return F.concat(t, *[x for p in parts for x in (F.lit(_SEP), key_str(p))])


def _prefixes(a: Column, least: int) -> Column:
    """a[:k] for k = least..size(a)."""
    return F.transform(F.sequence(F.lit(least), F.greatest(F.size(a), F.lit(least))), lambda k: F.slice(a, 1, k))


def _when(cond: Column, keys: Column) -> Column:
    return F.when(cond, keys).otherwise(F.array().cast("array<string>"))


def candidates(modules: DataFrame) -> DataFrame:
    """Every module under every proper prefix (root) of itself, rows per module = its depth:
    (repo_id, root_key, root_len, cand_key, clen, is_init, stem, root)."""
    m = modules.select("repo_id", "module").distinct()
    e = m.select("repo_id", "module", F.explode(F.sequence(F.lit(0), F.size("module") - 1)).alias("root_len"))
    e = e.select("repo_id", "root_len", F.slice("module", 1, F.col("root_len")).alias("root"),
                 F.slice("module", F.col("root_len") + 1, F.size("module") - F.col("root_len")).alias("cand"))
    is_init = F.element_at("cand", -1) == "__init__"
    stem = F.when(is_init, F.slice("cand", 1, F.size("cand") - 1)).otherwise(F.col("cand"))
    return e.select("repo_id", key_str(F.col("root")).alias("root_key"), "root_len", "root", stem.alias("stem"),
                    key_str(F.col("cand")).alias("cand_key"), F.size("cand").alias("clen"), is_init.alias("is_init"))


def candidate_keys(cands: DataFrame) -> DataFrame:
    """The candidates with the keys that imports reach them by.

    ``<r>`` is the path below a root of length r, ``*`` the same for any r > 0.
    An import is also tried with the root R in front, so a candidate below R
    is split: it is found by every import (``all``) if it repeats the start of
    R, by the rest Y after R (``abs``), and, behind the folder D of an
    importer, likewise (``dir``, ``dirabs``).
    """
    stem, root, r = F.col("stem"), F.col("root"), F.col("root_len")
    below = F.size(stem) > 0
    starts_root = lambda x: (F.size(x) <= r) & (F.slice(root, 1, F.size(x)) == x)
    past_root = lambda x: (F.size(x) > r) & (F.slice(x, 1, r) == root)
    tail = lambda x: F.slice(x, r + 1, F.size(x))
    head = lambda d: F.slice(stem, 1, d)
    rest = lambda d: F.slice(stem, d + 1, F.size(stem))
    folders = F.sequence(F.lit(1), F.greatest(F.size(stem), F.lit(1)))
    split = F.concat(
        _when(starts_root(stem), F.array(F.lit("all"))),
        _when(past_root(stem), F.array(_tagged("abs", tail(stem)))),
        F.transform(F.filter(folders, lambda d: starts_root(rest(d))), lambda d: _tagged("dir", head(d))),
        F.transform(F.filter(folders, lambda d: past_root(rest(d))), lambda d: _tagged("dirabs", head(d), tail(rest(d)))))
    keys = F.concat(F.array(_tagged(r, stem)), _when(r > 0, F.array(_tagged("*", stem))), _when((r > 0) & below, split))
    return cands.select("repo_id", "root_key", "root_len", "cand_key", "clen", "is_init", F.explode(F.array_distinct(keys)).alias("key"))


def import_keys(imports: DataFrame) -> DataFrame:
    """(repo_id, importer, imp, key, mode, least): what an import can resolve to under a root of at
    least ``least`` parts, whichever root it is. Rows per import depend on its own path and the depth of
    its importer alone; the root comes out of the match."""
    I, Pc = F.col("importer"), F.col("imp")
    n = F.size(F.filter(Pc, lambda x: x == ""))
    relative = F.element_at(Pc, 1) == ""
    lead_ok = F.forall(F.slice(Pc, 1, n), lambda x: x == "")
    up = F.when(relative, n).otherwise(F.lit(1))       # folders that the importer climbs
    names = F.when(relative, F.slice(Pc, n + 1, F.size(Pc))).otherwise(Pc)
    reach = F.size(I) - up                             # below that root length the importer's folder is not empty
    folder = F.slice(I, 1, F.greatest(F.size(I) - 1, F.lit(0)))
    ok = ~relative | lead_ok
    entry = lambda key, mode, least: F.struct(key.alias("key"), F.lit(mode).alias("mode"), least.cast("int").alias("least"))
    one = F.lit(1)
    at_top = F.transform(resolution_keys(I, Pc), lambda k: entry(_tagged("0", k), 0, F.lit(0)))
    lengths = F.filter(F.sequence(F.lit(1), F.greatest(reach, one)), lambda r: r < reach)
    by_length = F.flatten(F.transform(lengths, lambda r: F.transform(
        _prefixes(names, 0), lambda k: entry(_tagged(r, F.concat(F.slice(I, r + 1, reach - r), k)), 1, one))))
    anywhere = F.transform(F.filter(_prefixes(names, 0), lambda k: F.size(k) > 0),
                           lambda k: entry(_tagged("*", k), 1, F.when(relative, F.greatest(reach, one)).otherwise(one)))
    package = F.when(Pc == F.array(F.lit(".")), F.array(entry(_tagged("*", F.array().cast("array<string>")), 1, one)))
    none = F.slice(at_top, 1, 0)
    here = F.size(folder) > 0
    rooted = F.concat(
        F.array(entry(F.lit("all"), 0, one)),
        F.transform(_prefixes(Pc, 1), lambda k: entry(_tagged("abs", k), 0, one)),
        F.when(here, F.concat(F.array(entry(_tagged("dir", folder), 0, one)),
                              F.transform(_prefixes(Pc, 1), lambda k: entry(_tagged("dirabs", folder, k), 0, one)))).otherwise(none))
    keys = F.concat(at_top, F.when(ok, F.concat(by_length, anywhere)).otherwise(none), F.coalesce(package, none), rooted)
    return (imports.select("repo_id", F.col("module").alias("importer"), "imp").distinct()
            .select("repo_id", "importer", "imp", F.explode(F.array_distinct(keys)).alias("k"))
            .select("repo_id", "importer", "imp", "k.key", "k.mode", "k.least"))


def resolve_all_roots(modules: DataFrame, imports: DataFrame,
                      max_modules: int | None = None) -> DataFrame:
    """J1 + J2 for every admissible source root.

    modules: (repo_id, module); imports: (repo_id, module, imp).
    Returns (repo_id, root_key, root_len, importer, target_key) distinct, where
    target_key is the full path of the best candidate: the longest, then found
    with the root in front, then no ``__init__``, then by name. There is no row
    per import and root, only per match.

    With ``max_modules`` a root is skipped when the repo has more modules than
    that and the root holds fewer than half of them; by default every root is
    tried, whatever the size of the repository.
    """
    cands = candidates(modules)
    if max_modules is not None:
        size = modules.select("repo_id", "module").distinct().groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_mod"))
        held = cands.groupBy("repo_id", "root_key").agg(F.count(F.lit(1)).alias("n_valid")).join(merged(size), "repo_id")
        few = held.where((F.col("n_mod") > max_modules) & (F.col("n_valid") < F.col("n_mod") / 2))
        cands = cands.join(merged(few.select("repo_id", "root_key")), ["repo_id", "root_key"], "left_anti")
    matched = import_keys(imports).join(merged(candidate_keys(cands)), ["repo_id", "key"]).where("root_len >= least")
    best = matched.groupBy("repo_id", "root_key", "root_len", "importer", "imp").agg(
        F.min(F.struct((-F.col("clen")).alias("shortness"), "mode", "is_init", "cand_key")).alias("b"))
    target = F.when(F.col("root_len") > 0, F.concat("root_key", F.lit("/"), "b.cand_key")).otherwise(F.col("b.cand_key"))
    return best.select("repo_id", "root_key", "root_len", "importer", target.alias("target_key")).distinct()


def best_roots(resolved: DataFrame) -> DataFrame:
    """The best root per repository: most distinct resolved imports, then
    the shortest root, then the lexicographically smallest (the source leaves
    that tie to set order). (repo_id, root_key, n_resolved)."""
    counts = resolved.groupBy("repo_id", "root_key", "root_len").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("repo_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "root_len", "root_key")).alias("b"))
    return best.select("repo_id", F.col("b.root_key").alias("root_key"), (-F.col("b.n")).alias("n_resolved"))


def import_edges(modules: DataFrame, imports: DataFrame,
                 max_modules: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges(repo_id, importer, importee), roots(repo_id, root, root_key, n_resolved))."""
    resolved = stored(resolve_all_roots(modules, imports, max_modules), "resolved")
    best = best_roots(resolved)
    chosen = resolved.join(merged(best), ["repo_id", "root_key"])
    parts = lambda c: F.when(F.length(c) > 0, F.split(c, "/")).otherwise(F.array().cast("array<string>"))
    edges = chosen.select("repo_id", "importer", parts("target_key").alias("importee"))
    return edges, best.select("repo_id", parts("root_key").alias("root"), "root_key", "n_resolved")


PLACEHOLDER = "!placeholder"


def readme_targets(modules: DataFrame, readme_imports: DataFrame,
                   max_modules: int | None = None) -> DataFrame:
    """J5 (import part): README imports and ``-m`` modules resolved as if made
    by a virtual top-level module; (repo_id, target)."""
    ph = F.array(F.lit(PLACEHOLDER))
    repos_with = readme_imports.select("repo_id").distinct()
    mods = (modules.select("repo_id", "module").join(merged(repos_with), "repo_id", "left_semi")
            .unionByName(repos_with.select("repo_id", ph.alias("module"))))
    imps = readme_imports.select("repo_id", ph.alias("module"), "imp")
    edges, _ = import_edges(mods, imps, max_modules)
    return edges.select("repo_id", F.col("importee").alias("module")).distinct()


def mention_vote(flag: Column, repo_has_any: Column, available: Column) -> Column:
    """-1 not available / 0 available, not mentioned / 1 mentioned."""
    return (F.when(~available | ~repo_has_any, F.lit(-1))
            .when(flag, F.lit(1)).otherwise(F.lit(0))).cast("int")


def readme_mentions(pyfiles: DataFrame, readmes: DataFrame, readme_imps: DataFrame,
                    path_hits: DataFrame) -> DataFrame:
    """Per python file -1/0/1 (repo-level gate: no hit in the repo -> -1)."""
    targets = readme_targets(pyfiles, readme_imps)
    f = (pyfiles.select("repo_id", "path_str", "module")
         .join(merged(targets.withColumn("t_hit", F.lit(True))), ["repo_id", "module"], "left")
         .join(merged(path_hits.withColumn("p_hit", F.lit(True))), ["repo_id", "path_str"], "left")
         .join(merged(readmes.select("repo_id", F.lit(True).alias("has_readme"))), "repo_id", "left"))
    hit = F.coalesce(F.col("t_hit"), F.lit(False)) | F.coalesce(F.col("p_hit"), F.lit(False))
    f = _with_any(f.withColumn("hit", hit))
    return f.select("repo_id", "path_str", mention_vote(F.col("hit"), F.col("any_hit"), F.coalesce("has_readme", F.lit(False))).alias(
        "is_mentioned_in_readme"))


def _with_any(f: DataFrame) -> DataFrame:
    """``any_hit``: does the repository have a hit? One small row per repository, joined back."""
    some = f.where("hit").groupBy("repo_id").agg(F.lit(True).alias("any_hit"))
    return f.join(merged(some), "repo_id", "left").withColumn("any_hit", F.coalesce("any_hit", F.lit(False)))


def setup_mentions(pyfiles: DataFrame, entry_modules: DataFrame) -> DataFrame:
    """Per python file -1/0/1 for being a setup.py entry point module."""
    e = entry_modules.select("repo_id", "module").distinct().withColumn("e_hit", F.lit(True))
    f = pyfiles.select("repo_id", "path_str", "module").join(merged(e), ["repo_id", "module"], "left")
    hit = F.coalesce(F.col("e_hit"), F.lit(False))
    f = _with_any(f.withColumn("hit", hit))
    return f.select("repo_id", "path_str", mention_vote(F.col("hit"), F.col("any_hit"), F.lit(True)).alias("is_setup_entrypoint"))
