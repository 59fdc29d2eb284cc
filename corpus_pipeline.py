"""From documents to token ids, in five stages over all documents.

Each stage works on all that its predecessor kept; what it decides takes effect:

1. quality rules: rejected documents go;
2. n-gram Jaccard join: of each class of near-duplicates the document with the smallest id stays;
3. benchmark decontamination: documents that hold a window of a benchmark item go;
4. personal data: marks take the place of identifiers, and ``n_chars`` follows the new text;
5. BPE: per document the number of tokens and digests of the ids and of the decoded text.

All stages but the last return the columns of the documents, whatever those are besides doc_id,
text and source. Null texts are empty (and fail the quality rules); an empty table gives empty
results; the cases of each stage are stated with its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reposcope.llm import bpe, decontaminate, jaccard, line_rules, pii
from reposcope.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe", tokens),
]

#: SQL cannot express the join, the redaction and the encoding; tests/llm holds a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
