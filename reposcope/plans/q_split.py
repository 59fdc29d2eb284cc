"""Queries for splits, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.operators import split as SP
from reposcope.operators import stats as ST
from reposcope.plans.catalog import duck, query, repos
from reposcope.sources.tables import read_table

_SPLIT = f"""
tsplit AS (SELECT full_name, CASE WHEN CAST(created_at AS TIMESTAMP) > TIMESTAMP '{P.SPLIT_DATE}' THEN 'heldout' ELSE 'train' END AS split FROM repos),
held AS (SELECT full_name, row_number() OVER (ORDER BY md5('{P.SPLIT_SEED}:' || full_name)) AS pos,
                count(*) OVER () AS n FROM tsplit WHERE split = 'heldout'),
splits AS (SELECT full_name, split FROM tsplit WHERE split = 'train'
           UNION ALL
           SELECT full_name, CASE WHEN pos <= floor(CAST(n AS DOUBLE) * CAST({P.DEV_RATIO} AS DOUBLE) + 1.0) THEN 'dev' ELSE 'test' END FROM held)"""


@query("temporal_split", duck(_SPLIT + "\nSELECT full_name, split FROM tsplit"))
def _temporal_split(spark, sf):
    return SP.temporal_split(repos(spark, sf)).select("full_name", "split")


def _splits(spark, sf):
    return SP.dev_test_split(repos(spark, sf).select("full_name", "created_at")).select("full_name", "split")


@query("dev_test_split", duck(_SPLIT + "\nSELECT full_name, split FROM splits"))
def _dev_test_split(spark, sf):
    return _splits(spark, sf)


@query("split_counts", duck(_SPLIT + "\nSELECT split, count(*) AS n FROM splits GROUP BY split"))
def _split_counts(spark, sf):
    return SP.split_counts(_splits(spark, sf))


@query("split_disjoint", duck(_SPLIT + """
SELECT s.split, count(*) AS n,
       count(*) FILTER (WHERE EXISTS (SELECT 1 FROM splits o WHERE o.full_name = s.full_name AND o.split <> s.split)) AS n_shared
FROM splits s GROUP BY s.split"""))
def _split_disjoint(spark, sf):
    return SP.split_disjoint(_splits(spark, sf))


@query("shuffle_corpus", duck(f"""
SELECT full_name, CAST(row_number() OVER (ORDER BY md5('{P.SHUFFLE_SEED}:' || full_name)) AS BIGINT) AS pos FROM repos"""))
def _shuffle_corpus(spark, sf):
    return SP.shuffle_corpus(repos(spark, sf).select("full_name"))


@query("head_sample", duck(_SPLIT + f"""
SELECT full_name FROM splits WHERE split = 'train' ORDER BY md5('{P.SHUFFLE_SEED}:' || full_name) LIMIT 10"""))
def _head_sample(spark, sf):
    tr = _splits(spark, sf).where(F.col("split") == "train")
    return SP.head_sample(tr.withColumn("_k", SP.seeded_key(P.SHUFFLE_SEED, "full_name")), "_k", 10).select("full_name")


@query("resume_antijoin", duck(_SPLIT + """
SELECT r.full_name FROM repos r WHERE r.full_name NOT IN (SELECT full_name FROM tsplit WHERE split = 'train')"""))
def _resume_antijoin(spark, sf):
    r = repos(spark, sf)
    emitted = SP.temporal_split(r).where(F.col("split") == "train")
    return SP.resume_antijoin(r.select("full_name"), emitted)


@query("duplicate_ids", duck("""
SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1"""))
def _duplicate_ids(spark, sf):
    d = read_table(spark, sf, "documents").select(F.md5("text").alias("text_md5"))
    return ST.duplicate_ids(d, "text_md5")
