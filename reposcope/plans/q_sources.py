"""Queries for dataset JSONL sources/sinks and the streaming ingest (S3-S6, P5, P17, ST1, ST2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reposcope.operators import context as CX
from reposcope.plans.catalog import duck, gated_tree, query, readmes, repos, setups, tree
from reposcope.plans.q_context import _HORDER, _RANDOM_FIRST, _single_duck
from reposcope.plans.q_eval import README_GATE, language_detector, readme_reasons
from reposcope.plans.q_report import RESPONSES, response_columns
from reposcope.session import ensure_checkpoint_dir, merged, scratch, stored
from reposcope.sources import jsonl
from reposcope.streaming import ingest as ST


def _run_dir(spark, name: str) -> str:
    """Fresh folder for one run inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/reposcope_runs/{name}-{uuid.uuid4().hex[:12]}"


def _write_dataset(spark, sf) -> str:
    path = _run_dir(spark, "dataset")
    recs = jsonl.dataset_records(gated_tree(spark, sf), readmes(spark, sf), setups(spark, sf), repos(spark, sf))
    jsonl.write_dataset(recs, path)
    return path


@query("write_dataset", duck(README_GATE + """
SELECT r.full_name, CASE WHEN r.repo_id IN (SELECT repo_id FROM setups) THEN 1 ELSE 0 END AS n_removed
FROM repos r WHERE r.repo_id IN (SELECT repo_id FROM tree_ok) AND r.repo_id IN (SELECT repo_id FROM rgate WHERE reason = 'ok')"""))
def _write_dataset_q(spark, sf):
    """S5 + P10 + P11 + P17: dataset JSONL of the repositories that pass both
    gates, read back; one row per written line."""
    ok = stored(readme_reasons(spark, sf).where("reason = 'ok'").select("repo_id"), "readme-ok")
    path = _run_dir(spark, "dataset")
    recs = jsonl.dataset_records(gated_tree(spark, sf).join(merged(ok), "repo_id", "left_semi"), readmes(spark, sf), setups(spark, sf), repos(spark, sf))
    jsonl.write_dataset(recs, path)
    back = jsonl.read_records(spark, path)
    return back.select(F.col("meta.full_name").alias("full_name"), F.size("removed_files").alias("n_removed"))


@query("read_repo_jsonl", duck("""
SELECT full_name, name, CAST(created_at AS VARCHAR) AS created_at, description FROM repos"""))
def _read_repo_jsonl(spark, sf):
    recs = jsonl.read_records(spark, _write_dataset(spark, sf))
    return recs.select("meta.full_name", "meta.name", "meta.created_at", "meta.description")


@query("flatten_tree", duck("""
SELECT r.full_name, t.path_str, t.excluded, md5(t.content) AS content_md5
FROM tree_ok t JOIN repos r ON t.repo_id = r.repo_id"""))
def _flatten_tree(spark, sf):
    recs = jsonl.read_records(spark, _write_dataset(spark, sf))
    flat = jsonl.flatten_tree(recs)
    return flat.select("full_name", "path_str", "excluded", F.md5("content").alias("content_md5"))


@query("attach_meta", duck("""
SELECT r.full_name, r.html_url, count(*) AS n_files FROM tree_ok t JOIN repos r ON t.repo_id = r.repo_id
GROUP BY r.full_name, r.html_url"""))
def _attach_meta(spark, sf):
    recs = jsonl.read_records(spark, _write_dataset(spark, sf))
    flat = jsonl.flatten_tree(recs).groupBy("full_name").agg(F.count(F.lit(1)).alias("n_files"))
    meta = repos(spark, sf).select("full_name", "html_url")
    return jsonl.attach_meta(flat, meta)


@query("stream_ingest", duck(README_GATE + """
SELECT r.full_name, count(*) AS n_files FROM tree_ok t JOIN repos r ON t.repo_id = r.repo_id
WHERE t.repo_id IN (SELECT repo_id FROM rgate WHERE reason = 'ok') GROUP BY r.full_name"""))
def _stream_ingest(spark, sf):
    """ST1: the records of all repositories, gated or not, as a file stream, run
    twice (the rerun adds nothing); the stream's gates choose."""
    src = _run_dir(spark, "records")
    with scratch(spark):
        jsonl.write_dataset(jsonl.dataset_records(tree(spark, sf), readmes(spark, sf), setups(spark, sf), repos(spark, sf)), src, compression="gzip")
    run = _run_dir(spark, "ingest")
    sink, ckpt = run + "/sink", run + "/checkpoint"
    for _ in range(2):
        ST.run_ingest(spark, src, sink, ckpt, detector=language_detector(spark, sf))
    return spark.read.parquet(sink).groupBy("full_name").agg(F.count(F.lit(1)).alias("n_files"))


@query("stream_requests", duck(_HORDER + "," + _RANDOM_FIRST + "," + _single_duck("random_file", False, "rf_first") + RESPONSES))
def _stream_requests(spark, sf):
    """ST2: request files streamed into responses."""
    from reposcope.functions import text as T
    run = _run_dir(spark, "requests")
    reqs = readmes(spark, sf).select("repo_id", T.truncate_words("content", 0).alias("prompt"),
                                     F.lit("echo").alias("model"))
    reqs.write.json(run + "/in")
    ctx = CX.ctx_random_file(tree(spark, sf), repos(spark, sf), 512)
    ST.run_requests(spark, run + "/in", run + "/sink", run + "/checkpoint", ctx)
    return response_columns(spark.read.parquet(run + "/sink"))


_SCANNED = """
SELECT r.name AS repo, f.path_str,
       f.excluded OR coalesce(regexp_matches(left(f.content, 1024), '[\\x00-\\x06\\x0B\\x0E-\\x1A\\x1C-\\x1F\\x7F]'), false) AS excluded,
       md5(CASE WHEN f.excluded THEN NULL ELSE f.content END) AS content_md5
FROM files f JOIN repos r ON f.repo_id = r.repo_id"""


@query("scan_files", duck(_SCANNED))
def _scan_files(spark, sf):
    """S1 (+P1-P4): the derived corpus written as a real directory tree by the
    executors, then scanned with the binaryFile source."""
    from reposcope.sources import scan
    from reposcope.plans.catalog import raw_files
    root = _run_dir(spark, "tree")
    rows = raw_files(spark, sf).join(repos(spark, sf).select("repo_id", F.col("name").alias("repo")), "repo_id")
    scan.write_file_tree(rows, root)
    got = scan.scan_files(spark, root)
    return got.select("repo", "path_str", "excluded", F.md5("content").alias("content_md5"))


@query("scan_archives", duck(_SCANNED.replace("r.name AS repo", "r.full_name AS repo").replace(
    "AS content_md5", "AS content_md5, 'ok' AS status")))
def _scan_archives(spark, sf):
    """One zip per repository written by the executors, then unpacked in
    Arrow batches; archive status per repository."""
    from reposcope.sources import scan
    from reposcope.plans.catalog import raw_files
    root = _run_dir(spark, "archives")
    r = repos(spark, sf).select("repo_id", F.split("full_name", "/")[0].alias("user"), F.col("name").alias("repo"))
    scan.write_archives(raw_files(spark, sf).join(r, "repo_id"), root)
    files, status = scan.scan_archives(spark, root)
    return files.join(status.select(F.concat_ws("/", "user", "repo").alias("repo"), "status"), "repo").select(
        "repo", "path_str", "excluded", F.md5("content").alias("content_md5"), "status")
