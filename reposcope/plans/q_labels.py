"""Queries for feature assembly, votes and weak supervision."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.operators import boost as B
from reposcope.operators import features as FE
from reposcope.operators import moments as MO
from reposcope.operators import rank as RK
from reposcope.operators import stats as ST
from reposcope.operators import weak as WK
from reposcope.plans.catalog import BLACKLIST_SQL, duck, features, pyfiles, query, readmes, repos, setups
from reposcope.plans.q_files import INHERIT_DUCK, _CONTENT_DUCK, _FILENAME_DUCK
from reposcope.plans.q_graph import _GRAPH, _README_MENTION, _SETUP_MENTION
from reposcope.session import merged
from reposcope.sources import corpus

_FEATS = (_GRAPH + "," + INHERIT_DUCK + "," + _CONTENT_DUCK + "," + _FILENAME_DUCK + "," + _README_MENTION
          + "," + _SETUP_MENTION + f""",
feats AS (
  SELECT p.repo_id, p.path_str, p.ord,
         c.contains_main_func, c.contains_argument_parser, c.contains_web_framework, c.content_chars, c.too_short,
         n.has_main_in_filename, n.is_main_ish_names, n.is_module, n.is_test_ish_name, n.has_same_name_as_repo, n.level,
         i.num_inherited, s.is_setup_entrypoint, m.is_mentioned_in_readme,
         g.rank, g.num_importers, g.num_importees, g.bottom_rank
  FROM py p
  JOIN content_feats c ON p.repo_id = c.repo_id AND p.path_str = c.path_str
  JOIN name_feats n ON p.repo_id = n.repo_id AND p.path_str = n.path_str
  JOIN inherit i ON p.repo_id = i.repo_id AND p.path_str = i.path_str
  JOIN setup_mention s ON p.repo_id = s.repo_id AND p.path_str = s.path_str
  JOIN readme_mention m ON p.repo_id = m.repo_id AND p.path_str = m.path_str
  LEFT JOIN gfeat g ON p.repo_id = g.repo_id AND g.node = array_to_string(p.module, '/')
  WHERE NOT list_has_any(p.path, {BLACKLIST_SQL})),
votes AS (
  SELECT repo_id, path_str, ord,
    CAST(CASE WHEN contains_main_func THEN 1 ELSE -1 END AS INT) AS contains_main_func,
    CAST(CASE WHEN contains_argument_parser THEN 1 ELSE -1 END AS INT) AS contains_argument_parser,
    CAST(CASE WHEN contains_web_framework THEN 1 ELSE -1 END AS INT) AS contains_web_framework,
    CAST(CASE WHEN too_short THEN 0 ELSE -1 END AS INT) AS too_short,
    CAST(CASE WHEN has_main_in_filename THEN 1 ELSE -1 END AS INT) AS has_main_in_filename,
    CAST(CASE WHEN is_main_ish_names THEN 1 ELSE -1 END AS INT) AS is_main_ish_names,
    CAST(CASE WHEN is_module THEN 0 ELSE -1 END AS INT) AS is_module,
    CAST(CASE WHEN is_test_ish_name THEN 0 ELSE -1 END AS INT) AS is_test_ish_name,
    CAST(CASE WHEN has_same_name_as_repo THEN 1 ELSE -1 END AS INT) AS has_same_name_as_repo,
    CAST(CASE WHEN coalesce(rank = 0, false) THEN 1 ELSE -1 END AS INT) AS top_rank,
    CAST(CASE WHEN coalesce(bottom_rank, false) THEN 0 ELSE -1 END AS INT) AS bottom_rank,
    CAST(CASE WHEN num_inherited >= {P.INHERITED_MANY_TIMES} THEN 1 ELSE -1 END AS INT) AS inherited_many_times,
    CAST(is_setup_entrypoint AS INT) AS is_setup_entrypoint,
    CAST(is_mentioned_in_readme AS INT) AS is_mentioned_in_readme
  FROM feats)""")


def _feats(spark, sf):
    return features(spark, sf)


def _votes(spark, sf):
    return FE.votes(_feats(spark, sf))


@query("assemble_features", duck(_FEATS + """
SELECT repo_id, path_str, content_chars, level, num_inherited, is_setup_entrypoint, is_mentioned_in_readme,
       rank, num_importers, num_importees, bottom_rank FROM feats"""))
def _assemble_features(spark, sf):
    f = FE.assemble_features(pyfiles(spark, sf), repos(spark, sf), readmes(spark, sf), setups(spark, sf))
    return f.select("repo_id", "path_str", "content_chars", "level", "num_inherited",
                                    "is_setup_entrypoint", "is_mentioned_in_readme", "rank",
                                    "num_importers", "num_importees", "bottom_rank")


@query("votes", duck(_FEATS + "\nSELECT * EXCLUDE (ord) FROM votes"))
def _votes_q(spark, sf):
    return _votes(spark, sf)


_FM_SQL = ", ".join(
    [f"CAST({c} AS DOUBLE) AS {c}" for c in P.FEATURE_NAMES])


@query("feature_matrix", duck(_FEATS + f"\nSELECT repo_id, path_str, {_FM_SQL} FROM feats"))
def _feature_matrix(spark, sf):
    return FE.feature_matrix(_feats(spark, sf))


_UNPIVOT = " UNION ALL ".join(
    f"SELECT '{c}' AS lf, {c} AS vote, _nn, _np, _ng FROM vc" for c in P.VOTE_NAMES)
_VC = ("vc AS (SELECT *, " + " + ".join(f"CAST({c} <> -1 AS INT)" for c in P.VOTE_NAMES) + " AS _nn, "
       + " + ".join(f"CAST({c} = 1 AS INT)" for c in P.VOTE_NAMES) + " AS _np, "
       + " + ".join(f"CAST({c} = 0 AS INT)" for c in P.VOTE_NAMES) + " AS _ng FROM votes)")


@query("lf_summary", duck(_FEATS + "," + _VC + f""",
lv AS ({_UNPIVOT})
SELECT lf,
       coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN vote <> -1 THEN CAST(vote AS VARCHAR) END))), ','), '') AS polarity,
       round(avg(CAST(vote <> -1 AS DOUBLE)), 6) AS coverage,
       round(avg(CAST(vote <> -1 AND _nn >= 2 AS DOUBLE)), 6) AS overlaps,
       round(avg(CAST(vote <> -1 AND ((vote = 1 AND _ng > 0) OR (vote = 0 AND _np > 0)) AS DOUBLE)), 6) AS conflicts
FROM lv GROUP BY lf"""))
def _lf_summary(spark, sf):
    return WK.lf_summary(_votes(spark, sf))


@query("nonabstain_ratio", duck(_FEATS + "," + _VC + f""",
lv AS ({_UNPIVOT})
SELECT lf, round(avg(CAST(vote <> -1 AS DOUBLE)), 6) AS nonabstain_ratio FROM lv GROUP BY lf"""))
def _nonabstain_ratio(spark, sf):
    return WK.nonabstain_ratio(_votes(spark, sf))


@query("majority_vote", duck(_FEATS + "," + _VC + """
SELECT repo_id, path_str, _np AS n_pos, _ng AS n_neg,
       CAST(CASE WHEN _np > _ng THEN 1 WHEN _ng > _np THEN 0 ELSE -1 END AS INT) AS label FROM vc"""))
def _majority_vote(spark, sf):
    return WK.majority_vote(_votes(spark, sf))


_W = math.log(WK.DEFAULT_ACC / (1 - WK.DEFAULT_ACC))


def proba_duck(lfs: list[str]) -> str:
    logit = " + ".join(f"CASE {c} WHEN 1 THEN {_W!r} WHEN 0 THEN {-_W!r} ELSE 0.0 END" for c in lfs)
    return f"proba AS (SELECT repo_id, path_str, ord, round(1.0 / (1.0 + exp(-(0.0 + {logit}))), 6) AS proba FROM votes)"


_PROBA = proba_duck(P.VOTE_NAMES)


@query("label_proba", duck(_FEATS + "," + _PROBA + "\nSELECT repo_id, path_str, proba FROM proba"))
def _label_proba(spark, sf):
    return WK.label_proba(_votes(spark, sf))


@query("best_file", duck(_FEATS + "," + _PROBA + """
SELECT repo_id, path_str, proba FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY proba DESC, ord) AS rn FROM proba) t WHERE rn = 1"""))
def _best_file(spark, sf):
    f = _feats(spark, sf)
    p = FE.votes(f).join(merged(f.select("repo_id", "path_str", "ord")), ["repo_id", "path_str"])
    scored = p.select("repo_id", "path_str", "ord", F.round(WK.posterior({c: WK.DEFAULT_ACC for c in P.VOTE_NAMES}, 0.5), 6).alias("proba"))
    return RK.best_per_repo(scored, "proba").select("repo_id", "path_str", "proba")


@query("group_sizes", duck(_FEATS + "\nSELECT repo_id, count(*) AS group_size FROM feats GROUP BY repo_id"))
def _group_sizes(spark, sf):
    return ST.group_sizes(_feats(spark, sf), "repo_id")


@query("label_model_em")
def _label_model_em(spark, sf):
    """EM with one accuracy per function; rows = distinct vote patterns with their posterior."""
    _, _, patterns = WK.fit_label_model(_votes(spark, sf))
    return patterns


_LF_NAMES = "['" + "', '".join(P.VOTE_NAMES) + "']"
#: the moments and their closed-form solution, step by step, on the rows of votes themselves
_MOMENTS = "cast_votes AS (SELECT row_number() OVER () AS r, * FROM votes),\nind AS (" + " UNION ALL ".join(
    f"SELECT r, {2 * i} + {c} AS i FROM cast_votes WHERE {c} >= 0" for i, c in enumerate(P.VOTE_NAMES)) + f"""),
m0 AS (SELECT count(*) AS total FROM votes),
m1 AS (SELECT i, count(*) AS n, count(*) / any_value(CAST(total AS DOUBLE)) AS m FROM ind, m0 GROUP BY i),
m2 AS (SELECT a.i AS i, b.i AS j, count(*) AS n FROM ind a JOIN ind b ON a.r = b.r AND a.i < b.i GROUP BY ALL),
m3 AS (SELECT a.i AS i, b.i AS j, c.i AS k, count(*) AS n FROM ind a JOIN ind b ON a.r = b.r AND a.i < b.i
       JOIN ind c ON a.r = c.r AND b.i < c.i GROUP BY ALL),
grid AS (SELECT a.i AS i, b.i AS j, a.m AS mi, b.m AS mj, coalesce(m2.n, 0) / CAST(total AS DOUBLE) AS pr
         FROM m0, m1 a JOIN m1 b ON a.i // 2 <> b.i // 2
         LEFT JOIN m2 ON least(a.i, b.i) = m2.i AND greatest(a.i, b.i) = m2.j),
cov AS (SELECT *, pr - mi * mj AS c FROM grid),
above AS (SELECT a.i, sum(a.c * b.c * c.c) AS v FROM cov a JOIN cov b ON a.i = b.i JOIN cov c ON a.j = c.i AND b.j = c.j GROUP BY a.i),
below AS (SELECT m1.i, sum(c.c * c.c) AS v FROM m1 JOIN cov c ON c.i // 2 <> m1.i // 2 AND c.j // 2 <> m1.i // 2 GROUP BY m1.i),
sgn AS (SELECT i, CASE WHEN sum(c * CASE j % 2 WHEN 1 THEN 1.0 ELSE -1.0 END) >= 0 THEN 1.0 ELSE -1.0 END AS v FROM cov GROUP BY i),
xs AS (SELECT m1.i, m1.m, coalesce(s.v, 1.0) * CASE WHEN a.v > 0 AND b.v > 0 THEN sqrt(a.v / b.v) ELSE 0.0 END AS x
       FROM m1 LEFT JOIN above a ON m1.i = a.i LEFT JOIN below b ON m1.i = b.i LEFT JOIN sgn s ON m1.i = s.i),
tri AS (SELECT coalesce(m3.n, 0) / CAST(total AS DOUBLE) - a.m * bc.pr - b.m * ac.pr - c.m * ab.pr + 2 * a.m * b.m * c.m AS t,
               a.x * b.x * c.x AS product
        FROM m0, xs a JOIN xs b ON a.i < b.i AND a.i // 2 <> b.i // 2 JOIN xs c ON b.i < c.i AND b.i // 2 <> c.i // 2
        JOIN grid ab ON ab.i = a.i AND ab.j = b.i JOIN grid ac ON ac.i = a.i AND ac.j = c.i JOIN grid bc ON bc.i = b.i AND bc.j = c.i
        LEFT JOIN m3 ON m3.i = a.i AND m3.j = b.i AND m3.k = c.i),
skew AS (SELECT CASE WHEN sum(product * product) > 0 THEN sum(t * product) / sum(product * product) ELSE 0.0 END AS s FROM tri),
bal AS (SELECT least(greatest(0.5 - coalesce(s, 0.0) / (2 * sqrt(4 + coalesce(s, 0.0) * coalesce(s, 0.0))), {MO.BALANCE[0]}), {MO.BALANCE[1]}) AS p FROM skew),
rates AS (SELECT i, {_LF_NAMES}[CAST(i // 2 + 1 AS INT)] AS lf, CAST(i % 2 AS INT) AS vote, p,
                 least(greatest(m + (1 - p) * x / sqrt(p * (1 - p)), {MO.LEAST_RATE} * m), 1.0) AS r1,
                 least(greatest(m - p * x / sqrt(p * (1 - p)), {MO.LEAST_RATE} * m), 1.0) AS r0 FROM xs, bal)"""


@query("label_moments", duck(_FEATS + "," + _MOMENTS + """
SELECT NULL::INT AS i, NULL::INT AS j, NULL::INT AS k, total AS n FROM m0
UNION ALL SELECT CAST(i AS INT), NULL, NULL, n FROM m1
UNION ALL SELECT CAST(i AS INT), CAST(j AS INT), NULL, n FROM m2
UNION ALL SELECT CAST(i AS INT), CAST(j AS INT), CAST(k AS INT), n FROM m3"""))
def _label_moments(spark, sf):
    """M3: counts of votes, and of pairs and triples of votes cast together."""
    return MO.vote_moments(MO.vote_patterns(_votes(spark, sf)))


@query("label_model", duck(_FEATS + "," + _MOMENTS + """
SELECT lf, vote, round(r1, 6) AS rate_1, round(r0, 6) AS rate_0, round(ln(r1 / r0), 6) AS weight, round(p, 6) AS balance FROM rates"""))
def _label_model(spark, sf):
    """M3: label model from agreement moments; one row per function and vote."""
    return MO.weights(MO.fit(_votes(spark, sf)), spark)


@query("label_proba_fitted", duck(_FEATS + "," + _MOMENTS + """,
odds AS (SELECT v.repo_id, v.path_str, any_value(ln(b.p / (1 - b.p))) + coalesce(sum(ln(t.r1 / t.r0)), 0.0) AS o
         FROM cast_votes v CROSS JOIN bal b LEFT JOIN ind ON ind.r = v.r LEFT JOIN rates t ON t.i = ind.i GROUP BY ALL)
SELECT repo_id, path_str, round(1.0 / (1.0 + exp(-o)), 6) AS proba FROM odds"""))
def _label_proba_fitted(spark, sf):
    """M4 with the fitted weights of M3."""
    v = _votes(spark, sf)
    return v.select("repo_id", "path_str", F.round(MO.fit(v).posterior(), 6).alias("proba"))


def _training_rows(spark, sf):
    """Features of every candidate file with the posterior of the fitted label model as target."""
    f = _feats(spark, sf)
    v = FE.votes(f)
    target = v.select("repo_id", "path_str", MO.fit(v).posterior().alias("target"))
    return FE.feature_matrix(f).join(merged(target), ["repo_id", "path_str"]).join(merged(f.select("repo_id", "path_str", "ord")), ["repo_id", "path_str"])


def _fitted_ranker(spark, sf):
    return B.fit_boosted_ranker(_training_rows(spark, sf), P.FEATURE_NAMES, "target")


@query("train_ranker")
def _train_ranker(spark, sf):
    """M5: boosted pairwise ranker; one row per node of its trees."""
    return B.nodes(_fitted_ranker(spark, sf), spark)


@query("train_ranker_linear")
def _train_ranker_linear(spark, sf):
    """The linear pairwise ranker; one row per coefficient."""
    model = RK.fit_pairwise_ranker(_training_rows(spark, sf), P.FEATURE_NAMES, "target")
    return RK.coefficients(model, spark)


def ranked_files(spark, sf):
    """M5 + M6: every candidate file with its score by the fitted ranker, a stage written once."""
    def build():
        rows = _training_rows(spark, sf)
        return B.score(B.fit_boosted_ranker(rows, P.FEATURE_NAMES, "target"), rows)

    return corpus.stage_table(spark, sf, "ranked_files", build, ("repo_id", "ord"))


@query("rank_files")
def _rank_files(spark, sf):
    """M6: score every candidate file with the ranker, best file per repo."""
    return RK.rank_summary(ranked_files(spark, sf))
