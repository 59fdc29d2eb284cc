"""Token-budgeted context assembly per repository.

Inputs are the flat ``tree`` files (README and setup.py already removed).
The per-repository text is never assembled from the whole repository: a
running token sum (``segments.running_before``, split over tasks) keeps only
the files that start inside the budget, so the collected text per repository
is bounded by the budget plus one file (files are < 100 kB by the size rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.functions import text as T
from reposcope.operators.segments import running_before
from reposcope.session import merged


def prompt_parts(kind: str, project_name: Column | None, use_prompt: bool,
                 names: Column | None = None) -> tuple[Column, Column]:
    """(prefix, suffix) columns for a creator; wording is fixed by the source."""
    if not use_prompt:
        if kind == "entrypoint":
            return F.lit(""), F.concat(F.lit(P.FILE_SEPARATOR), names)
        return F.lit(""), F.lit("")
    called = (F.when(project_name.isNotNull(), F.concat(F.lit(' called "'), project_name, F.lit('"')))
              .otherwise(F.lit("")))
    head = {"all_data": P.PROMPT_ALL_DATA, "entrypoint": P.PROMPT_ENTRYPOINT,
            "random_file": P.PROMPT_RANDOM_FILE, "file_names": P.PROMPT_FILE_NAMES_HEAD}[kind]
    tail = P.PROMPT_FILE_NAMES_TAIL if kind == "file_names" else ""
    prefix = F.concat(F.lit(head), called, F.lit(tail), F.lit(P.PROMPT_OPEN))
    suffix = F.lit(P.PROMPT_SUFFIX)
    if kind == "entrypoint":
        suffix = F.when(F.length(names) > 0, F.concat(F.lit(P.PROMPT_NAMES), names, F.lit(P.PROMPT_SUFFIX))) \
            .otherwise(F.lit(P.PROMPT_SUFFIX))
    return prefix, suffix


def hash_order(tree: DataFrame) -> DataFrame:
    """L1: deterministic pseudo-random file order per repository:
    key = sha256(repo_seed || path). The seed depends only on the set of file
    names (bit_xor of 60-bit md5 prefixes: a partial aggregate, nothing is
    collected per repository, so a huge repository costs no memory)."""
    name_bits = F.conv(F.substring(F.md5("name"), 1, 15), 16, 10).cast("bigint")
    seed = tree.groupBy("repo_id").agg(F.md5(F.bit_xor(name_bits).cast("string")).alias("_seed"))
    return tree.join(merged(seed), "repo_id").withColumn(
        "hkey", F.sha2(F.concat("_seed", "path_str"), 256)).drop("_seed")


def order_col(order: str) -> str:
    return "hkey" if order == "hash" else "ord"


def _budget(prefix: Column, suffix: Column, max_tokens: int, tokenizer: T.Tokenizer = T.DEFAULT_TOKENIZER) -> Column:
    used = T.token_count(prefix, tokenizer) + T.token_count(suffix, tokenizer)
    return F.when(used < max_tokens, F.lit(max_tokens) - used).otherwise(
        F.raise_error(F.lit("prompt does not fit into the token budget")))


def context_budget(model_max: int, generation_max: int, slack: int = 4) -> int:
    """Tokens left for the context: the model's maximum less what it may
    write and a slack. Not to leave any is an error."""
    left = model_max - generation_max - slack
    if left <= 0:
        raise ValueError(f"a model of {model_max} tokens has no room for a context beside {generation_max} + {slack}")
    return left


def sample_names(tree: DataFrame, n: int = P.N_FILE_NAMES, order: str = "hash") -> DataFrame:
    """First ``n`` file names per repository in file order, space-joined.
    Rank filter first (group-limit pushdown), then a bounded collect."""
    t = hash_order(tree) if order == "hash" else tree
    w = Window.partitionBy("repo_id").orderBy(order_col(order))
    top = t.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.groupBy("repo_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "name"))), lambda s: s["name"]),
                     " ").alias("names"))


def budget_concat(tree: DataFrame, budget: int, sep: str = P.FILE_SEPARATOR,
                  order: str = "hash", tokenizer: T.Tokenizer = T.DEFAULT_TOKENIZER) -> DataFrame:
    """Non-excluded files (stripped) joined by ``sep`` in file order,
    keeping only files that start inside the token budget (bounded collect);
    callers truncate the joined text exactly."""
    return budget_concat_with_budget(tree.withColumn("_budget", F.lit(budget)), order, sep, tokenizer)


def ctx_all_data(tree: DataFrame, repos: DataFrame, max_tokens: int, use_prompt: bool = False,
                 order: str = "hash", tokenizer: T.Tokenizer = T.DEFAULT_TOKENIZER) -> DataFrame:
    """All files, budget-concatenated."""
    r = repos.select("repo_id", F.col("name").alias("project_name"))
    prefix, suffix = prompt_parts("all_data", F.col("project_name"), use_prompt)
    r = r.select("repo_id", prefix.alias("_pre"), suffix.alias("_suf"))
    r = r.withColumn("_budget", _budget(F.col("_pre"), F.col("_suf"), max_tokens, tokenizer))
    t = tree.join(merged(r.select("repo_id", "_budget")), "repo_id")
    body = budget_concat_with_budget(t, order, tokenizer=tokenizer)
    j = r.join(merged(body), "repo_id", "left")
    text = T.truncate_tokens(F.coalesce("body", F.lit("")), F.col("_budget"), tokenizer)
    return j.select("repo_id", F.concat("_pre", text, "_suf").alias("context"))


def _within_budget(units: DataFrame, okey: str) -> DataFrame:
    """Rows (repo_id, path_str, order key, _budget, _u) that start inside the budget of their repository."""
    return running_before(units, "repo_id", okey, "_u").where(F.col("_before") < F.col("_budget"))


def budget_concat_with_budget(t: DataFrame, order: str, sep: str = P.FILE_SEPARATOR,
                              tokenizer: T.Tokenizer = T.DEFAULT_TOKENIZER) -> DataFrame:
    """``budget_concat`` where the budget is a per-repository column ``_budget``.
    The running sum sees names and counts only; texts are joined for the files that are kept."""
    okey = order_col(order)
    txt = T.strip_ws("content")
    counts = t.select("repo_id", "path_str", "name", "ord", "excluded", "_budget", (T.token_count(txt, tokenizer) + T.token_count(F.lit(sep), tokenizer)).alias("_u"))
    counts = hash_order(counts) if order == "hash" else counts
    kept = _within_budget(counts.where(~F.col("excluded")).select("repo_id", "path_str", okey, "_budget", "_u"), okey)
    texts = kept.select("repo_id", "path_str", okey).join(merged(t.select("repo_id", "path_str", txt.alias("_txt"))), ["repo_id", "path_str"])
    return texts.groupBy("repo_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(okey, "_txt"))),
                                 lambda s: s["_txt"]), sep).alias("body"))


def _single_file_ctx(chosen: DataFrame, repos: DataFrame, kind: str, max_tokens: int,
                     use_prompt: bool, names: DataFrame | None = None,
                     tokenizer: T.Tokenizer = T.DEFAULT_TOKENIZER) -> DataFrame:
    """Cleansed single file + prompt, truncated to the remaining budget."""
    r = repos.select("repo_id", F.col("name").alias("project_name"))
    if names is not None:
        r = r.join(merged(names), "repo_id", "left").withColumn("names", F.coalesce("names", F.lit("")))
    prefix, suffix = prompt_parts(kind, F.col("project_name"), use_prompt,
                                  F.col("names") if names is not None else None)
    j = chosen.join(merged(r), "repo_id")
    j = j.select("repo_id", T.cleanse_file("content").alias("_c"), prefix.alias("_pre"), suffix.alias("_suf"))
    b = _budget(F.col("_pre"), F.col("_suf"), max_tokens, tokenizer)
    return j.select("repo_id", F.concat("_pre", T.truncate_tokens("_c", b, tokenizer), "_suf").alias("context"))


def ctx_random_file(tree: DataFrame, repos: DataFrame, max_tokens: int, use_prompt: bool = False,
                    order: str = "hash", tokenizer: T.Tokenizer = T.DEFAULT_TOKENIZER) -> DataFrame:
    """First non-excluded Python file in file order, cleansed."""
    t = hash_order(tree) if order == "hash" else tree
    py = t.where(~F.col("excluded") & (T.python_base_name("name") != ""))
    w = Window.partitionBy("repo_id").orderBy(order_col(order))
    first = py.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return _single_file_ctx(first, repos, "random_file", max_tokens, use_prompt, tokenizer=tokenizer)


def ctx_entrypoint(tree: DataFrame, repos: DataFrame, scores: DataFrame, max_tokens: int,
                   use_prompt: bool = False, order: str = "hash",
                   tokenizer: T.Tokenizer = T.DEFAULT_TOKENIZER) -> DataFrame:
    """Cleansed best-scored file (ties: traversal order) plus up to 10
    file names. ``scores``: (repo_id, path_str, score)."""
    s = scores.join(merged(tree.select("repo_id", "path_str", "ord", "content")), ["repo_id", "path_str"])
    w = Window.partitionBy("repo_id").orderBy(F.col("score").desc(), "ord")
    best = s.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    names = sample_names(tree, order=order)
    return _single_file_ctx(best, repos, "entrypoint", max_tokens, use_prompt, names, tokenizer)


def ctx_file_names(tree: DataFrame, repos: DataFrame, max_tokens: int, use_prompt: bool = False,
                   order: str = "hash", tokenizer: T.Tokenizer = T.DEFAULT_TOKENIZER) -> DataFrame:
    """C4: all file names in file order, space-joined, truncated. Names are
    budget-cut the same way as file bodies (bounded collect)."""
    t = hash_order(tree) if order == "hash" else tree
    r = repos.select("repo_id", F.col("name").alias("project_name"))
    prefix, suffix = prompt_parts("file_names", F.col("project_name"), use_prompt)
    r = r.select("repo_id", prefix.alias("_pre"), suffix.alias("_suf"))
    r = r.withColumn("_budget", _budget(F.col("_pre"), F.col("_suf"), max_tokens, tokenizer))
    units = t.join(merged(r.select("repo_id", "_budget")), "repo_id").select("repo_id", "name", order_col(order), "_budget", T.token_count("name", tokenizer).alias("_u"))
    body = _within_budget(units, order_col(order)).groupBy("repo_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col(order), "name"))),
                                 lambda s: s["name"]), " ").alias("body"))
    j = r.join(merged(body), "repo_id", "left")
    return j.select("repo_id", F.concat("_pre", T.truncate_tokens(F.coalesce("body", F.lit("")), F.col("_budget"), tokenizer),
                                        "_suf").alias("context"))


def ctx_dummy(repos: DataFrame) -> DataFrame:
    """Empty context."""
    return repos.select("repo_id", F.lit("").alias("context"))


def ctx_fallback(tree: DataFrame, repos: DataFrame, scores: DataFrame, max_tokens: int,
                 use_prompt: bool = False, order: str = "hash",
                 tokenizer: T.Tokenizer = T.DEFAULT_TOKENIZER) -> DataFrame:
    """Entrypoint -> random_file -> file_names, with the source used. Which
    of them a repository gets is decided on names and flags; each context is
    built for the repositories that take it."""
    python = ~F.col("excluded") & (T.python_base_name("name") != "")
    scored = scores.select("repo_id").join(merged(tree.select("repo_id").distinct()), "repo_id", "left_semi").distinct()
    source = (repos.select("repo_id").join(merged(scored.withColumn("_e", F.lit(True))), "repo_id", "left")
              .join(merged(tree.where(python).select("repo_id").distinct().withColumn("_r", F.lit(True))), "repo_id", "left")
              .select("repo_id", F.when(F.col("_e"), "entrypoint").when(F.col("_r"), "random_file").otherwise("file_names").alias("source")))

    def part(kind: str, build) -> DataFrame:
        chosen = source.where(F.col("source") == kind)
        of = lambda df: df.join(merged(chosen.select("repo_id")), "repo_id", "left_semi")
        return chosen.join(merged(build(of(tree), of(repos))), "repo_id", "left").select("repo_id", "context", "source")

    return (part("entrypoint", lambda t, r: ctx_entrypoint(t, r, scores, max_tokens, use_prompt, order, tokenizer))
            .unionByName(part("random_file", lambda t, r: ctx_random_file(t, r, max_tokens, use_prompt, order, tokenizer)))
            .unionByName(part("file_names", lambda t, r: ctx_file_names(t, r, max_tokens, use_prompt, order, tokenizer))))


CREATORS = {
    "all_data": lambda tree, repos, max_tokens, scores=None, **o: ctx_all_data(tree, repos, max_tokens, **o),
    "entrypoint": lambda tree, repos, max_tokens, scores=None, **o: ctx_entrypoint(tree, repos, scores, max_tokens, **o),
    "random_file": lambda tree, repos, max_tokens, scores=None, **o: ctx_random_file(tree, repos, max_tokens, **o),
    "file_names": lambda tree, repos, max_tokens, scores=None, **o: ctx_file_names(tree, repos, max_tokens, **o),
    "dummy": lambda tree, repos, max_tokens, scores=None, **o: ctx_dummy(repos),
    "fallback": lambda tree, repos, max_tokens, scores=None, **o: ctx_fallback(tree, repos, scores, max_tokens, **o),
}
"""U4: context creators by name, all called as (tree, repos, max_tokens, scores=...,
use_prompt=..., order=..., tokenizer=...) -> (repo_id, context, ...)."""


def create_context(name: str, tree: DataFrame, repos: DataFrame, max_tokens: int, **options) -> DataFrame:
    if name not in CREATORS:
        raise ValueError(f"no context creator {name!r}; there are {sorted(CREATORS)}")
    return CREATORS[name](tree, repos, max_tokens, **options)


def training_pairs(contexts: DataFrame, readmes: DataFrame, max_source_tokens: int,
                   max_target_tokens: int, source_prefix: str = "",
                   tokenizer: T.Tokenizer = T.DEFAULT_TOKENIZER) -> DataFrame:
    """(context, reference) per repository; empty sides dropped, source
    prefix added, both sides truncated to their token limits (``padded`` gives
    arrays of a fixed length)."""
    j = contexts.join(merged(readmes.select("repo_id", F.col("content").alias("reference"))), "repo_id")
    j = j.where((F.length("context") > 0) & (F.length("reference") > 0))
    src = T.truncate_tokens(F.concat(F.lit(source_prefix), F.col("context")), max_source_tokens, tokenizer)
    tgt = T.truncate_tokens("reference", max_target_tokens, tokenizer)
    return j.select("repo_id", src.alias("source"), tgt.alias("target"))


def padded(tokens: Column, length: int, pad, ignore=None) -> Column:
    """A token array cut or filled to ``length``; as labels, padding is ``ignore``."""
    fill = F.lit(pad if ignore is None else ignore)
    return F.slice(F.concat(tokens, F.array_repeat(fill, length)), 1, length)
