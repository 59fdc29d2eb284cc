"""Predictions, generation plug-in and HTML reports."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.functions import text as T
from reposcope.operators import filters as FL

PAGE_STYLE = (
    "body{font:15px/1.5 sans-serif;margin:0 auto;max-width:70em}"
    "article{border:1px solid #ccc;border-radius:6px;margin:1em 0;padding:0 1em}"
    "mark{background:#e8eefc}dt{font-weight:bold}"
)


def echo_generator(context, input_text, continuation_tokens: int | None = None):
    """Text generator for runs without a model (U2 plug-in point): continues the
    prompt with the context, or with its first ``continuation_tokens``. A real
    model is plugged in with ``generate_with``."""
    cont = context if continuation_tokens is None else T.truncate_tokens(context, continuation_tokens)
    full = F.when(F.length(input_text) > 0, F.concat(input_text, F.lit(" "), cont)).otherwise(cont)
    return full


def generate_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], out_col: str = "result") -> DataFrame:
    """Run a user generator ``fn(batch[context, input_text]) -> texts`` over
    Arrow batches (one model load per Python worker, not per row)."""
    schema = df.schema.add(out_col, "string")

    def run(batches):
        for b in batches:
            b = b.copy()
            b[out_col] = fn(b)
            yield b
    return df.mapInPandas(run, schema=schema)


def predictions(contexts: DataFrame, readmes: DataFrame, repos: DataFrame, input_tokens: int = 0,
                system: str = "echo", generate: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Prediction rows: reference = README, input_text = its first
    ``input_tokens`` word tokens, result = generated text (starts with the
    input). ``generate`` is a model as ``generate_with`` takes it."""
    j = (repos.select("repo_id", "full_name", "html_url", "description")
         .join(contexts.select("repo_id", "context"), "repo_id")
         .join(readmes.select("repo_id", F.col("content").alias("reference")), "repo_id"))
    j = j.withColumn("input_text", T.truncate_words("reference", input_tokens))
    if generate is None:
        j = j.withColumn("generated", echo_generator(F.col("context"), F.col("input_text")))
    else:
        j = generate_with(j, generate, "generated")
    gen = F.col("generated")
    diff = F.substring(gen, F.length("input_text") + 1, 1 << 30)
    return j.select("repo_id", "full_name", "html_url", "description", "input_text", "reference", "context",
                    FL.postprocess(gen).alias("result"), FL.postprocess(diff).alias("diff"),
                    F.lit(system).alias("system"))


def edit_records(pred: DataFrame) -> DataFrame:
    """P15 + P16: right-trimmed readme/diff and the insertion edit."""
    e = FL.edit_record("result", "diff")
    return pred.select("full_name", e.alias("edit"))


def _checked_rest(result, input_text):
    ok = F.substring(result, 1, F.length(input_text)) == input_text
    return F.when(ok, F.substring(result, F.length(input_text) + 1, 1 << 30)).otherwise(
        F.raise_error(F.lit("result does not start with the input text")))


def _page(title: str, *parts):
    """A page: the repository as heading, its description as a definition, then the parts."""
    esc = T.html_escape
    return F.concat(
        F.lit(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>{PAGE_STYLE}</style></head><body><header><h1>'),
        esc(F.col("full_name")), F.lit("</h1><dl><dt>Repository</dt><dd>"), esc(F.coalesce("html_url", F.lit(""))),
        F.lit("</dd><dt>About</dt><dd>"), esc(F.coalesce("description", F.lit(""))), F.lit("</dd></dl></header><main>"),
        *parts, F.lit("</main></body></html>"))


def _article(kind: str, caption, body):
    return F.concat(F.lit(f'<article class="{kind}"><h2>'), caption, F.lit("</h2><p>"), body, F.lit("</p></article>"))


def _generated_text():
    """The prompt marked, then what was generated after it."""
    rest = _checked_rest(F.col("result"), F.col("input_text"))
    return F.concat(F.lit("<mark>"), T.html_escape(F.col("input_text")), F.lit("</mark>"), T.html_escape(rest))


def report_html(pred: DataFrame, title: str = "Readme generation") -> DataFrame:
    """V1: one HTML document per prediction row, named after the repository."""
    esc = T.html_escape
    html = _page(title,
                 _article("output", F.lit("Written by the model"), _generated_text()),
                 _article("truth", F.lit("Readme of the repository"), esc(F.col("reference"))),
                 _article("input", F.lit("What the model was given"), esc(F.col("context"))))
    return pred.select(F.concat(F.translate("full_name", "/", "."), F.lit(".html")).alias("file_name"),
                       html.alias("html"))


def align_systems(preds: DataFrame, systems: list[str]) -> DataFrame:
    """N-way alignment by repository key (instead of positional zip);
    a repository missing from any system is an error."""
    n = len(systems)
    agg = preds.groupBy("full_name").agg(F.count_distinct("system").alias("n_systems"))
    return agg.select("full_name", F.when(F.col("n_systems") == n, F.col("n_systems")).otherwise(
        F.raise_error(F.concat(F.lit("repository missing from a system: "), F.col("full_name")))).alias("n_systems"))


def ab_report(preds: DataFrame, systems: list[str], seed: int = P.SHUFFLE_SEED,
              title: str = "Readme comparison") -> tuple[DataFrame, DataFrame]:
    """V2 (+D5): side-by-side blind HTML per repository and the mapping
    system -> shown position. Only the few system rows of one repository are
    collected together (bounded by the number of systems)."""
    from reposcope.operators.split import ab_blind
    aligned = align_systems(preds, systems)
    p = preds.join(aligned, "full_name")
    p = ab_blind(p, "full_name", "system", seed)
    part = _article("candidate", F.concat(F.lit("Candidate "), F.col("position").cast("string")), _generated_text())
    s = p.select("repo_id", "full_name", "html_url", "description", "reference", "position", part.alias("part"))
    per = s.groupBy("repo_id", "full_name").agg(
        F.first("html_url").alias("html_url"), F.first("description").alias("description"),
        F.first("reference").alias("reference"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "part"))),
                                 lambda x: x["part"]), "").alias("parts"))
    html = _page(title, F.col("parts"), _article("truth", F.lit("Readme of the repository"), T.html_escape(F.col("reference"))))
    rid = F.col("repo_id").cast("string")
    docs = per.select(F.concat(F.when(F.length(rid) >= 4, rid).otherwise(F.lpad(rid, 4, "0")), F.lit("_"),
                               F.translate("full_name", "/", "."), F.lit(".html")).alias("file_name"),
                      html.alias("html"))
    mappings = p.select("full_name", "system", "position")
    return docs, mappings


def responses(requests: DataFrame, contexts: DataFrame, model: str = "echo",
              generate: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """Request rows -> response rows (id, model, choices[text, edits, index]).
    A request's own ``model`` is echoed back where it names one; ``generate``
    is a model as ``generate_with`` takes it (its input_text is the prompt)."""
    j = requests.join(contexts.select("repo_id", "context"), "repo_id").withColumn("input_text", F.col("prompt"))
    if generate is None:
        j = j.withColumn("generated", echo_generator(F.col("context"), F.col("prompt")))
    else:
        j = generate_with(j, generate, "generated")
    gen = F.col("generated")
    named = F.coalesce(F.col("model"), F.lit(model)) if "model" in requests.columns else F.lit(model)
    readme = FL.postprocess(gen)
    diff = FL.postprocess(F.substring(gen, F.length("prompt") + 1, 1 << 30))
    choice = F.struct(readme.alias("text"), F.array(FL.edit_record(readme, diff)).alias("edits"),
                      F.lit(0).alias("index"), F.lit(None).cast("double").alias("logprobs"))
    return j.select(F.sha2(F.concat_ws(":", F.col("repo_id").cast("string"), F.col("prompt")), 256).alias("id"),
                    named.alias("model"), F.array(choice).alias("choices"))


def write_report(metrics: DataFrame, path: str) -> None:
    """Metric report as JSON (a single small row: one output file)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """Prediction rows as JSON lines (one folder per system)."""
    preds.write.mode("errorifexists").json(path)


def read_predictions(spark, paths: list[str]) -> DataFrame:
    """Read one or several prediction JSONL folders; the system is the
    folder name of each row's source file."""
    df = spark.read.json(paths)
    return df.withColumn("system", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))
