"""Queries of the operators: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from reposcope.llm import bpe, decontaminate, jaccard, licenses, line_rules, ngram_lm, periodic_runs, pii, quality_trees, ranked_search, suffix_dedup, toxicity, warc

QUERIES = {
    "op7_licenses": (licenses.op7, licenses.OP7_SQL),
    "op2_interpolated_lm": (ngram_lm.op2, None),
    "op1_suffix_dedup": (suffix_dedup.op1, None),
    "op5_jaccard_join": (jaccard.op5, jaccard.OP5_SQL),
    "op3_line_rules": (line_rules.op3, line_rules.OP3_SQL),
    "op4_warc": (warc.op4, warc.OP4_SQL),
    "op10_quality_trees": (quality_trees.op10, None),
    "op6_pii": (pii.op6, None),
    "op8_wu_manber": (decontaminate.op8, decontaminate.OP8_SQL),
    "op9_bpe": (bpe.op9, None),
    "op11_ranked_search": (ranked_search.op11, ranked_search.OP11_SQL),
    "op12_toxicity": (toxicity.op12, None),
    "op13_periodic_runs": (periodic_runs.op13, None),
}
