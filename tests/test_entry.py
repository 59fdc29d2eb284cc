"""Driver contract: entry() runs, every oracle has a query."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert {r.metric for r in rows} == {"n_reference_tokens", "n_repo_tokens", "n_excluded", "n_files"}


def test_oracle_keys_are_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
