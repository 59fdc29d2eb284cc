"""Work on tables that grow: no join sends a side whole through the driver, texts are read once."""

import pytest
from pyspark.sql import DataFrameWriter

from reposcope.operators import graph as G
from reposcope.operators import metrics as M
from reposcope.operators import sentences as SE
from reposcope.plans import registry
from reposcope.session import stored
from reposcope.sources import jsonl
from reposcope.streaming import ingest


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_degrees_of_a_small_file_are_merged(spark):
    rows = [(1, "a", "b", 1, 1), (1, "b", "a", 1, 1), (1, "c", "a", 1, 1)]
    edges = stored(spark.createDataFrame(rows, "repo_id bigint, src string, dst string, src_depth int, dst_depth int"), "edges")
    got = G.graph_degree(G.prune_two_way(edges))
    assert "Broadcast" not in _plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, "a", 2, 1), (1, "b", 1, 1), (1, "c", 0, 1)]


@pytest.fixture(scope="module")
def corpus_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("joins"))
    spark.range(40).selectExpr("id AS doc_id", "concat('Some words of text ', id) AS text").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["assemble_features", "best_file", "ctx_entrypoint", "ctx_fallback"])
def test_features_and_what_reads_them_are_merged(spark, corpus_dir, name):
    assert "Broadcast" not in _plan(registry.all_queries()[name][0](spark, corpus_dir))


def test_ngrams_of_both_sides_are_counted_without_a_join(spark):
    rows = [("a", ["x", "x", "y"], ["x", "x", "x"]), ("a", ["z"], ["y"]), ("b", [], ["x"]), (None, ["x"], ["x"])]
    got = M.clipped_matches(spark.createDataFrame(rows, "k string, p array<string>, r array<string>"), "k", "p", "r", [1, 2])
    assert "Join" not in _plan(got)
    assert sorted(map(tuple, got.collect())) == [("a", 1, 3), ("a", 2, 1)]


def test_bigram_counts_are_stored_once(spark):
    docs = spark.createDataFrame([("one two one",), ("alone",), ("",), (None,)], "text string")
    big, ctx, vocab = M.train_bigram_lm(docs)
    assert "regexp_extract_all" not in _plan(big) + _plan(ctx)
    assert sorted(map(tuple, big.collect())) == [("one", "two", 1), ("two", "one", 1)]
    assert sorted(map(tuple, ctx.collect())) == [("one", 1), ("two", 1)] and vocab == 4


def test_context_counts_are_merged(spark):
    big, ctx, vocab = M.train_bigram_lm(spark.createDataFrame([("one two one",)], "text string"))
    docs = spark.createDataFrame([(1, "two one")], "id int, text string")
    assert "Broadcast" not in _plan(M.token_logprobs(docs, "id", "text", big, ctx, vocab))


def test_trigrams_are_counted_within_their_row(spark):
    docs = spark.createDataFrame([("aaaa", "en"), ("bbb", "fr")], "text string, lang string")
    counted = docs.select(M._counted(M.char_trigrams("text")).alias("c")).collect()
    assert [{x["gram"]: x["k"] for x in r["c"]} for r in counted] == [{" aa": 1, "aaa": 2, "aa ": 1}, {" bb": 1, "bbb": 1, "bb ": 1}]
    texts = spark.createDataFrame([(1, "aaa"), (2, "bb"), (3, ""), (3, "bbb"), (4, None)], "id int, text string")
    got = M.detect_language(texts, "id", "text", *M.train_language_model(docs))
    assert "partial_count" not in _plan(got.select("pred_lang", "id")).split("log_num")[0]
    assert {r["id"]: r["pred_lang"] for r in got.collect()} == {1: "en", 2: "fr", 3: "fr", 4: "none"}


def test_words_of_a_text_are_cut_once(spark):
    docs = spark.createDataFrame([("Dr. Who came. He left",), ("",), (None,)], "text string")
    for counts in (SE.word_counts(docs), SE.starter_counts(docs, ["dr"])):
        assert "size(" not in _plan(counts)
    assert ("who", 1, 0) in set(map(tuple, SE.starter_counts(docs, ["dr"]).collect()))
    assert ("he", 1, 1) in set(map(tuple, SE.starter_counts(docs, ["dr"]).collect()))


def test_scores_come_from_stored_counts(spark):
    docs = spark.createDataFrame([("Dr. Who met Dr. No. He left. Then he came. He is Dr. Who.",)] * 3, "text string")
    for scored in (SE.abbreviations(SE.word_counts(docs)), SE.starters(SE.starter_counts(docs, ["dr"]))):
        assert "Generate" not in _plan(scored) and "FileScan parquet" in _plan(scored)


@pytest.mark.parametrize("name", ["ctx_entrypoint_ranked", "feature_matrix", "group_sizes", "label_model_em", "label_proba", "majority_vote",
                                  "nonabstain_ratio", "rank_files", "train_ranker", "train_ranker_linear", "votes"])
def test_queries_over_features_broadcast_nothing(spark, corpus_dir, name):
    assert "Broadcast" not in _plan(registry.all_queries()[name][0](spark, corpus_dir))


@pytest.mark.parametrize("name, steps", [("graph_degree", 1), ("assemble_features", 8), ("train_ranker", 20)])
def test_steps_before_the_last_broadcast_offsets_alone(spark, corpus_dir, monkeypatch, name, steps):
    """The tables that are written or checkpointed on the way: their joins are merged too, but for
    that of ``global_rank`` with a row per partition."""
    registry.all_queries()["votes"][0](spark, corpus_dir)
    plans, write, cut = [], DataFrameWriter.parquet, type(spark.range(0)).checkpoint
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plans.append(_plan(self._df)), write(self, *a, **b))[1])
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda self, *a, **b: (plans.append(_plan(self)), cut(self, *a, **b))[1])
    registry.all_queries()[name][0](spark, corpus_dir)
    assert len(plans) >= steps and any("SortMergeJoin" in p for p in plans)
    assert [x for p in plans for x in p.splitlines() if "Broadcast" in x and "Join" in x and "_pid" not in x] == []


def test_trigrams_of_the_training_texts_are_cut_once(spark):
    docs = spark.createDataFrame([("aaa", "en"), ("bb", "fr"), ("", "de"), (None, "en")], "text string, lang string")
    counts, lang = M.train_language_model(docs)
    assert "regexp_extract_all" not in _plan(counts) + _plan(lang)
    assert sorted((r["lang"], r["gram"], round(r["log_num"], 4)) for r in counts.collect()) == [
        ("en", " aa", 0.6931), ("en", "aa ", 0.6931), ("en", "aaa", 0.6931), ("fr", " bb", 0.6931), ("fr", "bb ", 0.6931)]


RECORD_TREE = [(1, 0, ["src", "a", "x.py"], "x.py", False, "x = 1"), (1, 1, ["src", "b.py"], "b.py", False, None), (1, 2, ["c.py"], "c.py", False, "")]


def _nested(spark):
    rows = spark.createDataFrame(RECORD_TREE, "repo_id long, ord int, path array<string>, name string, excluded boolean, content string")
    return jsonl.nest_tree(rows)


def test_files_are_nested_from_one_stored_table_by_level(spark):
    nested = _nested(spark)
    assert "PartitionFilters: [isnotnull(level" in _plan(nested)
    assert nested.collect()[0]["tree_json"] == (
        '{"name":"repo","children":[{"name":"src","children":[{"name":"a","children":[{"name":"x.py","excluded":false,"content":"x = 1"}]},'
        '{"name":"b.py","excluded":false}]},{"name":"c.py","excluded":false,"content":""}]}')


def test_no_files_make_no_tree(spark):
    assert jsonl.nest_tree(spark.createDataFrame([], "repo_id long, ord int, path array<string>, name string, excluded boolean, content string")).collect() == []


def test_records_are_judged_from_a_stored_table(spark):
    line = '{"repo":%s,"references":[],"setuppy":null,"removed_files":[],"meta":{"full_name":"u/r"}}' % _nested(spark).collect()[0]["tree_json"]
    lines = spark.createDataFrame([(line,), (line,), ('{"repo":{"name":"repo","children":[]},"meta":{"full_name":"u/e"}}',), ("no record",), (None,)], "value string")
    got = ingest.judged(lines)
    assert "ExistingRDD" not in _plan(got)
    assert sorted((r["full_name"], r["reason"]) for r in got.collect()) == [("u/e", "no_files"), ("u/r", "ok")]
    recs = spark.createDataFrame([(line,)], "value string").selectExpr(f"from_json(value, '{jsonl.RECORD_SCHEMA}') AS r").select("r.*")
    flat = jsonl.flatten_tree(recs, content=False)
    assert "content" not in flat.columns and [(r["path_str"], r["ord"]) for r in flat.orderBy("ord").collect()] == [("src/a/x.py", 0), ("src/b.py", 1), ("c.py", 2)]
