"""Incremental corpus ingest (ST1) and request -> response streams (ST2).

Both run as Structured Streaming file-source queries with a checkpoint and
``trigger(availableNow=True)``. Each micro-batch writes its output into its
own ``epoch=<id>`` folder with overwrite, so a replayed batch (after an
executor or driver failure) replaces its own output instead of duplicating
it. The ingest is two streams: the first parses records and puts them through
both gates, the second keeps the first accepted record of each repository, by
keyed state, and flattens it. No table of earlier names is read again. What a
batch stores on its way goes with it.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.operators import filters as FL
from reposcope.operators import metrics as M
from reposcope.session import merged, scratch, stored
from reposcope.sources import jsonl

#: detects languages: (repo_id, raw) -> (repo_id, pred_lang)
Detector = Callable[[DataFrame], DataFrame]
GATED_SCHEMA = "full_name string, value string"


def judged(lines: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(repo_id, full_name, reason) per distinct record with a name: the reason of
    the repository gate (P10) if it rejects, else that of the README gate (P11;
    left out without a ``detector``). Records are judged one by one, also those
    that share a name; ``repo_id`` is a record's digest. The records are parsed
    once, and their trees are kept and flattened without the texts."""
    parsed = lines.select(F.sha2("value", 256).alias("repo_id"), F.from_json("value", jsonl.RECORD_SCHEMA).alias("r")).where("r.meta.full_name IS NOT NULL")
    slim = parsed.select("repo_id", jsonl.without_texts("r.repo").alias("repo"), F.slice("r.references", 1, 1).alias("references"), "r.meta")
    recs = stored(slim.dropDuplicates(["repo_id"]), "records")
    files = jsonl.flatten_tree(recs.select("repo", F.struct(F.col("repo_id").alias("full_name")).alias("meta")), content=False)
    reasons = FL.repo_gate(files.withColumnRenamed("full_name", "repo_id"), repos=recs).select("repo_id", F.col("reason").alias("files_reason"))
    out = recs.select("repo_id", F.col("meta.full_name").alias("full_name")).join(merged(reasons), "repo_id")
    reason = F.col("files_reason")
    if detector is not None:
        readme = F.from_json(F.get("references", F.lit(0)), "struct<name:string, excluded:boolean, content:string>")
        readmes = recs.select("repo_id", readme.alias("f")).where("f.name IS NOT NULL").select("repo_id", "f.*")
        raw = F.substring(M.markdown_text("content", P.RAW_TEXT_MAX_SPANS), 1, P.README_LANG_CHARS)
        gate = FL.readme_gate(recs, readmes, detector(readmes.select("repo_id", raw.alias("raw"))))
        out = out.join(merged(gate.select("repo_id", F.col("reason").alias("readme_reason"))), "repo_id")
        reason = F.when(reason != "ok", reason).otherwise(F.col("readme_reason"))
    return out.select("repo_id", "full_name", reason.alias("reason"))


def gate_batch(batch: DataFrame, epoch: int, work: str, detector: Detector | None = None) -> None:
    """Accepted records under ``gated``, the names and reasons of the others under ``rejected``."""
    with scratch(batch.sparkSession):
        rows = stored(judged(batch, detector), "judged")
        rows.where("reason <> 'ok'").select("full_name", "reason").write.mode("overwrite").parquet(os.path.join(work, "rejected", f"epoch={epoch}"))
        ok = rows.where("reason = 'ok'").select("repo_id", "full_name")
        # of equal records one goes on
        values = batch.select("value", F.sha2("value", 256).alias("repo_id")).join(merged(ok), "repo_id").dropDuplicates(["repo_id"])
        values.select("full_name", "value").write.mode("overwrite").parquet(os.path.join(work, "gated", f"epoch={epoch}"), compression="zstd")


def store_batch(batch: DataFrame, epoch: int, sink: str) -> None:
    """Files of the repositories that are new: state has dropped the rest."""
    recs = batch.select(F.from_json("value", jsonl.RECORD_SCHEMA).alias("r")).select("r.*")
    with scratch(batch.sparkSession):
        jsonl.flatten_tree(recs).write.mode("overwrite").parquet(os.path.join(sink, f"epoch={epoch}"))


def _rated(reader, max_files_per_trigger: int | None):
    """No limit on a batch unless one is asked for."""
    return reader if max_files_per_trigger is None else reader.option("maxFilesPerTrigger", max_files_per_trigger)


def _drain(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()).awaitTermination()


def run_ingest(spark: SparkSession, source_dir: str, sink: str, checkpoint: str,
               max_files_per_trigger: int | None = None, detector: Detector | None = None) -> str:
    """ST1: process every JSONL file under ``source_dir`` not seen before. What
    the gates let through and what they reject lies in the returned folder,
    beside the sink. The state of the second stream holds names alone."""
    work = sink.rstrip("/") + "_work"
    lines = _rated(spark.readStream.schema("value string"), max_files_per_trigger).text(source_dir)
    _drain(lines, lambda df, epoch: gate_batch(df, epoch, work, detector), os.path.join(checkpoint, "gate"))
    gated = os.path.join(work, "gated")
    spark.createDataFrame([], GATED_SCHEMA).write.mode("ignore").parquet(os.path.join(gated, "epoch=-1"))
    accepted = spark.readStream.schema(GATED_SCHEMA).parquet(gated).select("full_name", "value").dropDuplicates(["full_name"])
    _drain(accepted, lambda df, epoch: store_batch(df, epoch, sink), os.path.join(checkpoint, "store"))
    return work


REQUEST_SCHEMA = "repo_id bigint, prompt string, model string"


def run_requests(spark: SparkSession, source_dir: str, sink: str, checkpoint: str,
                 contexts: DataFrame, max_files_per_trigger: int | None = None, generate=None) -> None:
    """ST2: request rows -> responses (context lookup, generation,
    post-processing, edit record) for every new request file. ``generate`` is
    a model as ``report.generate_with`` takes it."""
    from reposcope.operators import report as RP

    def batch(df: DataFrame, epoch: int) -> None:
        out = RP.responses(df, contexts, generate=generate)
        out.write.mode("overwrite").parquet(os.path.join(sink, f"epoch={epoch}"))

    _drain(_rated(spark.readStream.schema(REQUEST_SCHEMA), max_files_per_trigger).json(source_dir), batch, checkpoint)
