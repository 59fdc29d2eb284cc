"""Queries for import resolution, the import graph and mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reposcope.operators import extract as X
from reposcope.operators import graph as G
from reposcope.operators import resolve as R
from reposcope.plans.catalog import astr, duck, pyfiles, query, readmes, setups
from reposcope.plans.q_files import (_ENTRY_DUCK, _EXEC_DUCK, _IMPORTS_DUCK,
                                     _README_IMPORTS_DUCK)


def duck_keys(I: str, Pc: str) -> str:
    """DuckDB twin of ``resolve.resolution_keys``."""
    nz = f"len(list_filter({Pc}, lambda x: x = ''))"
    rel = (f"list_transform(range(0, len({Pc}) - {nz} + 1), lambda k: "
           f"list_concat({I}[1:greatest(len({I}) - {nz}, 0)], {Pc}[{nz} + 1:{nz} + k]))")
    absk = (f"list_concat(list_transform(range(1, len({Pc}) + 1), lambda k: {Pc}[1:k]), "
            f"list_transform(range(0, len({Pc}) + 1), lambda k: list_concat({I}[1:greatest(len({I}) - 1, 0)], {Pc}[1:k])))")
    keys = (f"CASE WHEN {Pc}[1] = '' THEN (CASE WHEN len(list_filter({Pc}[1:{nz}], lambda x: x <> '')) = 0 "
            f"THEN {rel} ELSE []::VARCHAR[][] END) ELSE {absk} END")
    nonempty = f"list_filter({keys}, lambda k: len(k) > 0)"
    return f"CASE WHEN {Pc} = ['.'] THEN list_concat({nonempty}, [[]::VARCHAR[]]) ELSE {nonempty} END"


def duck_resolve(prefix: str, mods: str, imps: str, max_modules: int = 500) -> str:
    """CTEs ``{prefix}_resolved`` (all roots), ``{prefix}_best`` (chosen root)
    and ``{prefix}_edges`` from ``mods(repo_id, module)`` and
    ``imps(repo_id, module, imp)``."""
    p = prefix
    return f"""
{p}_mods AS (SELECT DISTINCT repo_id, module FROM {mods}),
{p}_nmod AS (SELECT repo_id, count(*) AS n_mod FROM {p}_mods GROUP BY repo_id),
{p}_cands AS (
  SELECT repo_id, root, array_to_string(root, '/') AS root_key, cand,
         array_to_string(CASE WHEN cand[-1] = '__init__' THEN cand[1:len(cand) - 1] ELSE cand END, '/') AS ckey,
         len(cand) AS clen, cand[-1] = '__init__' AS is_init, array_to_string(cand, '/') AS cand_key
  FROM (SELECT repo_id, module[1:rl] AS root, module[rl + 1:len(module)] AS cand
        FROM (SELECT repo_id, module, unnest(range(0, len(module))) AS rl FROM {p}_mods) a) b),
{p}_roots AS (
  SELECT cc.repo_id, cc.root_key, cc.root FROM
    (SELECT repo_id, root_key, any_value(root) AS root, count(*) AS n_valid FROM {p}_cands GROUP BY ALL) cc
    JOIN {p}_nmod nm ON cc.repo_id = nm.repo_id
  WHERE NOT (nm.n_mod > {max_modules} AND cc.n_valid < nm.n_mod / 2)),
{p}_ir AS (
  SELECT i.repo_id, i.module AS importer, i.imp, r.root, r.root_key,
         i.module[len(r.root) + 1:len(i.module)] AS rel_i, list_concat(r.root, i.imp) AS abs_p
  FROM (SELECT DISTINCT repo_id, module, imp FROM {imps}) i JOIN {p}_roots r ON i.repo_id = r.repo_id),
{p}_keyed AS (
  SELECT repo_id, importer, imp, root, root_key, 0 AS mode, unnest({duck_keys('importer', 'abs_p')}) AS key FROM {p}_ir
  UNION ALL
  SELECT repo_id, importer, imp, root, root_key, 1 AS mode, unnest({duck_keys('rel_i', 'imp')}) AS key FROM {p}_ir
  WHERE len(root) > 0),
{p}_matched AS (
  SELECT k.repo_id, k.importer, k.imp, k.root, k.root_key, k.mode, c.cand, c.clen, c.is_init, c.cand_key
  FROM {p}_keyed k JOIN {p}_cands c
    ON k.repo_id = c.repo_id AND k.root_key = c.root_key AND array_to_string(k.key, '/') = c.ckey),
{p}_bestc AS (
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY repo_id, root_key, array_to_string(importer, '/'), array_to_string(imp, chr(1))
      ORDER BY clen DESC, mode, is_init, cand_key) AS rn FROM {p}_matched) t WHERE rn = 1),
{p}_resolved AS (SELECT DISTINCT repo_id, root, root_key, importer, list_concat(root, cand) AS target FROM {p}_bestc),
{p}_best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n_resolved DESC, len(root), root_key) AS rn
                 FROM (SELECT repo_id, root_key, any_value(root) AS root, count(*) AS n_resolved
                       FROM {p}_resolved GROUP BY ALL) s) t WHERE rn = 1),
{p}_edges AS (
  SELECT r.repo_id, r.importer, r.target AS importee
  FROM {p}_resolved r JOIN {p}_best b ON r.repo_id = b.repo_id AND r.root_key = b.root_key)"""


_RESOLVE = _IMPORTS_DUCK + "," + duck_resolve("ri", "py", "imports")

_GRAPH = _RESOLVE + """,
kedges AS (SELECT DISTINCT repo_id, array_to_string(importer, '/') AS src, array_to_string(importee, '/') AS dst,
                  len(importer) AS src_depth, len(importee) AS dst_depth FROM ri_edges),
pedges AS (
  SELECT e.repo_id, e.src, e.dst, e.src_depth, e.dst_depth FROM kedges e
  LEFT JOIN kedges r ON e.repo_id = r.repo_id AND e.src = r.dst AND e.dst = r.src
  WHERE r.src IS NULL OR e.src_depth <= e.dst_depth),
gnodes AS (SELECT DISTINCT repo_id, node FROM (SELECT repo_id, src AS node FROM pedges UNION ALL SELECT repo_id, dst FROM pedges) u),
gnn AS (SELECT repo_id, count(*) AS nn FROM gnodes GROUP BY repo_id),
reach AS (
  WITH RECURSIVE walk(repo_id, s, v, d) AS (
    SELECT repo_id, node, node, 0 FROM gnodes
    UNION
    SELECT w.repo_id, w.s, e.dst, w.d + 1 FROM walk w
    JOIN pedges e ON w.repo_id = e.repo_id AND w.v = e.src
    JOIN gnn n ON w.repo_id = n.repo_id
    WHERE w.d + 1 < n.nn)
  SELECT repo_id, s, v, min(d) AS d FROM walk GROUP BY ALL),
granks AS (
  SELECT repo_id, v AS node, CAST(dense_rank() OVER (PARTITION BY repo_id ORDER BY raw_rank) - 1 AS BIGINT) AS rank
  FROM (SELECT repo_id, v, max(d) AS raw_rank FROM reach GROUP BY ALL) t),
gdeg AS (
  SELECT n.repo_id, n.node,
         CAST((SELECT count(*) FROM pedges e WHERE e.repo_id = n.repo_id AND e.dst = n.node) AS BIGINT) AS num_importers,
         CAST((SELECT count(*) FROM pedges e WHERE e.repo_id = n.repo_id AND e.src = n.node) AS BIGINT) AS num_importees
  FROM gnodes n),
gfeat AS (
  SELECT r.repo_id, r.node, r.rank, d.num_importers, d.num_importees,
         r.rank = max(r.rank) OVER (PARTITION BY r.repo_id) AS bottom_rank
  FROM granks r JOIN gdeg d ON r.repo_id = d.repo_id AND r.node = d.node)"""


def _edges(spark, sf):
    py = pyfiles(spark, sf)
    imps = X.extract_imports(py)
    return R.import_edges(py, imps)


@query("resolve_imports", duck(_RESOLVE + """
SELECT repo_id, array_to_string(importer, '.') AS importer, array_to_string(importee, '.') AS importee FROM ri_edges"""))
def _resolve_imports(spark, sf):
    edges, _ = _edges(spark, sf)
    return edges.select("repo_id", astr("importer").alias("importer"), astr("importee").alias("importee"))


@query("source_root", duck(_RESOLVE + """
SELECT repo_id, array_to_string(root, '.') AS root, CAST(n_resolved AS BIGINT) AS n_resolved FROM ri_best"""))
def _source_root(spark, sf):
    _, best = _edges(spark, sf)
    return best.select("repo_id", astr("root").alias("root"), F.col("n_resolved").cast("bigint").alias("n_resolved"))


def _pruned(spark, sf):
    edges, _ = _edges(spark, sf)
    return G.prune_two_way(G.keyed_edges(edges))


@query("prune_two_way", duck(_GRAPH + "\nSELECT repo_id, src, dst FROM pedges"))
def _prune_two_way(spark, sf):
    return _pruned(spark, sf).select("repo_id", "src", "dst")


@query("graph_degree", duck(_GRAPH + "\nSELECT repo_id, node, num_importers, num_importees FROM gdeg"))
def _graph_degree(spark, sf):
    return G.graph_degree(_pruned(spark, sf))


@query("graph_rank", duck(_GRAPH + "\nSELECT repo_id, node, rank FROM granks"))
def _graph_rank(spark, sf):
    return G.node_ranks(_pruned(spark, sf))


@query("import_features", duck(_GRAPH + """
SELECT repo_id, node, rank, num_importers, num_importees, bottom_rank FROM gfeat"""))
def _import_features(spark, sf):
    return G.import_features(_pruned(spark, sf)).select(
        "repo_id", "node", "rank", "num_importers", "num_importees", "bottom_rank")


# ---------------------------------------------------------------- J5 / J6

_README_MENTION = _README_IMPORTS_DUCK + "," + _EXEC_DUCK + """,
rmx_imps AS (SELECT repo_id, ['!placeholder'] AS module, imp FROM readme_imps
            UNION SELECT repo_id, ['!placeholder'], module FROM exec_mods),
rmx_mods AS (SELECT repo_id, module FROM py WHERE repo_id IN (SELECT repo_id FROM rmx_imps)
            UNION SELECT DISTINCT repo_id, ['!placeholder'] FROM rmx_imps),""" + duck_resolve("rm", "rmx_mods", "rmx_imps") + """,
rm_targets AS (SELECT DISTINCT repo_id, importee AS module FROM rm_edges),
rm_path AS (SELECT p.repo_id, p.path_str FROM py p JOIN readmes r ON p.repo_id = r.repo_id WHERE contains(r.content, p.path_str)),
rm_flag AS (
  SELECT p.repo_id, p.path_str,
         (t.module IS NOT NULL OR h.path_str IS NOT NULL) AS hit,
         r.repo_id IS NOT NULL AS has_readme
  FROM py p LEFT JOIN rm_targets t ON p.repo_id = t.repo_id AND p.module = t.module
            LEFT JOIN rm_path h ON p.repo_id = h.repo_id AND p.path_str = h.path_str
            LEFT JOIN readmes r ON p.repo_id = r.repo_id),
readme_mention AS (
  SELECT repo_id, path_str,
         CAST(CASE WHEN NOT has_readme OR NOT bool_or(hit) OVER (PARTITION BY repo_id) THEN -1
                   WHEN hit THEN 1 ELSE 0 END AS INT) AS is_mentioned_in_readme
  FROM rm_flag)"""


def _readme_mention_df(spark, sf):
    py = pyfiles(spark, sf)
    rd = readmes(spark, sf)
    imps = rd.select("repo_id", F.explode(X.readme_imports(F.col("content"))).alias("imp"))
    execs = rd.select("repo_id", F.explode(X.module_exec_mentions(F.col("content"))).alias("imp"))
    hits = X.path_mentions(py, rd)
    return R.readme_mentions(py, rd, imps.unionByName(execs).distinct(), hits)


@query("readme_mentions", duck(_README_MENTION + "\nSELECT * FROM readme_mention"))
def _readme_mentions(spark, sf):
    return _readme_mention_df(spark, sf)


_SETUP_MENTION = _ENTRY_DUCK + """,
sm_flag AS (SELECT p.repo_id, p.path_str, e.module IS NOT NULL AS hit
            FROM py p LEFT JOIN entry_mods e ON p.repo_id = e.repo_id AND p.module = e.module),
setup_mention AS (
  SELECT repo_id, path_str,
         CAST(CASE WHEN NOT bool_or(hit) OVER (PARTITION BY repo_id) THEN -1 WHEN hit THEN 1 ELSE 0 END AS INT)
           AS is_setup_entrypoint
  FROM sm_flag)"""


def _setup_mention_df(spark, sf):
    py = pyfiles(spark, sf)
    st = setups(spark, sf)
    em = st.select("repo_id", F.explode(X.setup_entrypoint_modules(F.col("content"))).alias("module"))
    return R.setup_mentions(py, em)


@query("setup_mentions", duck(_SETUP_MENTION + "\nSELECT * FROM setup_mention"))
def _setup_mentions(spark, sf):
    return _setup_mention_df(spark, sf)
