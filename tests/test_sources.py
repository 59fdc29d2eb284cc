"""Sources on bad or unusual input, gates, ingest of repeats, ranker weights."""

import io
import json
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from reposcope.functions import text as T
from reposcope.operators import filters as FL
from reposcope.operators import rank as RK
from reposcope.operators import split as SP
from reposcope.sources import jsonl, scan
from reposcope.streaming import ingest as ST


def test_scan_skips_links_and_ignored_folders(spark, tmp_path):
    top = tmp_path / "root" / "r1"
    for folder in ("pkg", ".git", "build", "venv/lib"):
        (top / folder).mkdir(parents=True)
    (top / "pkg" / "__init__.py").write_text("a = 1")
    (top / ".git" / "config").write_text("x")
    (top / "build" / "b.py").write_text("x")
    (top / "venv" / "lib" / "c.py").write_text("x")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "secret.py").write_text("x")
    os.symlink(tmp_path / "outside", top / "out")
    os.symlink(top, top / "pkg" / "loop")
    got = scan.scan_files(spark, f"file://{tmp_path}/root").collect()
    assert [(r.repo, r.path_str, r.content) for r in got] == [("r1", "pkg/__init__.py", "a = 1")]


def _zip(files, damage=None):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in files:
            z.writestr(name, text)
    raw = buf.getvalue()
    return raw.replace(damage, b"#" * len(damage), 1) if damage else raw


def test_an_archive_counts_as_a_whole(spark, tmp_path):
    for user, raw in (("good", _zip([("repo/a.py", "x = 1"), ("repo/b.py", "y = 2"), ("other/c.py", "z")])),
                      ("torn", _zip([("repo/a.py", "x = 1"), ("repo/b.py", "second member")], b"second member")),
                      ("none", b"no archive"), ("bare", _zip([]))):
        (tmp_path / user / "r").mkdir(parents=True)
        (tmp_path / user / "r" / "repo.zip").write_bytes(raw)
    files, status = scan.scan_archives(spark, f"file://{tmp_path}")
    assert {(r.user, r.status) for r in status.collect()} == {("good", "ok"), ("torn", "bad_zip"), ("none", "bad_zip"), ("bare", "ok")}
    assert sorted((r.repo, r.path_str) for r in files.collect()) == [("good/r", "a.py"), ("good/r", "b.py")]


def _record(name, tree):
    return json.dumps({"repo": json.dumps(tree) if isinstance(tree, str) else tree, "references": [], "setuppy": None, "removed_files": [],
                       "meta": {"full_name": name, "name": name, "created_at": "2020-01-01", "html_url": "", "description": None}})


def _leaf(name):
    return {"name": name, "excluded": False, "content": f"# {name}"}


def test_deep_and_large_trees_are_whole(spark, tmp_path):
    deep = _leaf("end.py")
    for level in range(80):
        deep = {"name": f"d{level}", "children": [deep]}
    wide = {"name": "repo", "children": [_leaf(f"f{i}.py") for i in range(1500)]}
    (tmp_path / "a.json").write_text(_record("deep/r", {"name": "repo", "children": [deep]}) + "\n" + _record("wide/r", wide))
    got = jsonl.flatten_tree(jsonl.read_records(spark, str(tmp_path))).groupBy("full_name").agg(
        F.count("*").alias("n"), F.max(F.size("path")).alias("depth")).collect()
    assert {(r.full_name, r.n, r.depth) for r in got} == {("deep/r", 1, 81), ("wide/r", 1500, 1)}


def test_gate_has_a_row_for_every_repository(spark):
    files = spark.createDataFrame([(1, "a.py", False), (2, "a.txt", False)] + [(3, f"f{i}.py", False) for i in range(1001)],
                                  "repo_id long, name string, excluded boolean")
    repos = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "repo_id long")
    got = {r.repo_id: r.reason for r in FL.repo_gate(files, repos=repos).collect()}
    assert got == {1: "ok", 2: "no_python_file", 3: "too_many_files", 4: "no_files"}


def test_ingest_takes_a_repository_once(spark, tmp_path):
    tree = {"name": "repo", "children": [_leaf("a.py"), _leaf("b.py")]}
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.json").write_text("\n".join([_record("u/a", tree), _record("u/a", tree), _record("u/b", tree)]))
    run = lambda: ST.run_ingest(spark, str(src), f"{tmp_path}/sink", f"{tmp_path}/ckpt")
    run()
    (src / "two.json").write_text("\n".join([_record("u/b", tree), _record("u/c", tree), "not json"]))
    run()
    run()
    got = spark.read.parquet(f"{tmp_path}/sink").groupBy("full_name").count().collect()
    assert {(r.full_name, r["count"]) for r in got} == {("u/a", 2), ("u/b", 2), ("u/c", 2)}
    # a batch that is replayed replaces its own output
    ST.store_batch(spark.createDataFrame([("u/c", _record("u/c", tree))], ST.GATED_SCHEMA), 1, f"{tmp_path}/sink")
    assert spark.read.parquet(f"{tmp_path}/sink").count() == 6


def test_unreadable_dates_are_errors(spark):
    repos = spark.createDataFrame([("a", "2021-01-01T00:00:00Z"), ("b", "soon")], "full_name string, created_at string")
    assert [r.split for r in SP.temporal_split(repos.where("full_name = 'a'")).collect()] == ["heldout"]
    with pytest.raises(Exception, match="date cannot be read: soon"):
        SP.temporal_split(repos).collect()


def test_ranker_weighs_repositories_by_their_pairs(spark):
    """Two repositories of unequal size and slope, against least squares over all pairs."""
    rnd = random.Random(3)
    rows = [(repo, float(x := rnd.random()), slope * x + rnd.gauss(0, 0.01)) for repo, n, slope in ((1, 4, 1.0), (2, 40, 3.0)) for _ in range(n)]
    df = spark.createDataFrame(rows, "repo_id long, level double, target double")
    model = RK.fit_pairwise_ranker(df, ["level"], "target", reg=0.0)
    pairs = [(a[1] - b[1], a[2] - b[2]) for a in rows for b in rows if a[0] == b[0]]
    dx, dy = map(np.array, zip(*pairs))
    assert abs(model.coefficients[0] - (dx @ dy) / (dx @ dx)) < 1e-3


def test_truncations_are_prefixes(spark):
    df = spark.createDataFrame([("one two  three\nfour",)], "t string")
    got = df.select(T.truncate_tokens("t", 2).alias("a"), T.truncate_words("t", 0).alias("b")).first()
    assert "one two  three\nfour".startswith(got.a) and got.b == ""


def test_sidecars_are_read_and_appended(spark, tmp_path):
    for user, repo, meta, removed in (("u", "a", '{"name": "a", "html_url": "h"}', '["x.py"]'), ("u", "b", "no json", "[]"), ("v", "c", '{"name": "c"}', "broken")):
        for top, name, text in (("results", "meta.json", meta), ("trees", "removed_files.json", removed)):
            (tmp_path / top / user / repo).mkdir(parents=True)
            (tmp_path / top / user / repo / name).write_text(text)
    meta = {r.full_name: (r.name, r.html_url) for r in jsonl.read_meta(spark, str(tmp_path)).collect()}
    assert meta["u/a"] == ("a", "h") and meta["v/c"] == ("c", None) and meta.get("u/b", (None, None)) == (None, None)
    removed = jsonl.read_removed(spark, f"{tmp_path}/trees")
    assert {r.full_name: r.removed_files for r in removed.collect()} == {"u/a": ["x.py"], "u/b": [], "v/c": []}
    tree = spark.createDataFrame([(i, ["m.py"], "m.py", False, "x", 0) for i in (1, 2)], "repo_id long, path array<string>, name string, excluded boolean, content string, ord int")
    one = spark.createDataFrame([(1, "setup.py", False, "s")], "repo_id long, name string, excluded boolean, content string")
    repos = spark.createDataFrame([(1, "u/a", "a"), (2, "v/c", "c")], "repo_id long, full_name string, name string").selectExpr(
        "*", "date'2020-01-01' as created_at", "'' as html_url", "'' as description")
    earlier = repos.join(removed, "full_name").select("repo_id", "removed_files")
    lines = [json.loads(r.value) for r in jsonl.dataset_records(tree, one.limit(0), one, repos, earlier).collect()]
    assert {x["meta"]["full_name"]: x["removed_files"] for x in lines} == {"u/a": ["x.py", "setup.py"], "v/c": []}
