"""Splits, JSONL round trip, streaming ingest and scans."""

import io
import json
import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from reposcope.operators import split as SP
from reposcope.sources import jsonl, scan
from reposcope.streaming import ingest as ST


def test_dev_test_split_counts(spark):
    rows = [(f"u/r{i}", f"2020-{1 + i % 12:02d}-15") for i in range(200)]
    df = spark.createDataFrame(rows, "full_name string, created_at string").withColumn(
        "created_at", F.to_date("created_at"))
    out = SP.dev_test_split(df).collect()
    held = [r for r in rows if r[1] > "2020-06-12"]
    n_dev = int(len(held) * 0.3 + 1)
    splits = {r.full_name: r.split for r in out}
    assert len(splits) == 200
    assert sum(1 for s in splits.values() if s == "dev") == n_dev
    assert sum(1 for s in splits.values() if s == "test") == len(held) - n_dev


def test_global_rank_is_dense(spark):
    df = spark.range(0, 5000).withColumn("k", F.md5(F.col("id").cast("string"))).repartition(7)
    ranks = sorted(r.pos for r in SP.global_rank(df, "k").collect())
    assert ranks == list(range(1, 5001))


def _tree(spark):
    rows = [(1, 0, ["main.py"], "main.py", False, "import foo.bar"),
            (1, 1, ["foo", "__init__.py"], "__init__.py", False, ""),
            (1, 2, ["foo", "bar.py"], "bar.py", False, "x = 1"),
            (1, 3, ["data", "blob.bin"], "blob.bin", True, None),
            (2, 0, ["a.py"], "a.py", False, "print('hi')")]
    return spark.createDataFrame(rows, "repo_id long, ord int, path array<string>, name string, excluded boolean, content string")


def test_jsonl_round_trip(spark):
    t = _tree(spark)
    repos = spark.createDataFrame([(1, "u/one", "one", "2020-01-01", "h1", None), (2, "u/two", "two", "2020-02-01", "h2", "d")],
                                  "repo_id long, full_name string, name string, created_at string, html_url string, description string")
    readmes = spark.createDataFrame([(1, "README.md", False, "# one")], "repo_id long, name string, excluded boolean, content string")
    setups = spark.createDataFrame([], "repo_id long, name string, excluded boolean, content string")
    path = tempfile.mkdtemp(prefix="rs-jsonl-") + "/ds"
    jsonl.write_dataset(jsonl.dataset_records(t, readmes, setups, repos), path)
    flat = jsonl.flatten_tree(jsonl.read_records(spark, path))
    got = sorted((r.full_name, r.path_str, r.excluded, r.content) for r in flat.collect())
    assert got == sorted([("u/one", "main.py", False, "import foo.bar"), ("u/one", "foo/__init__.py", False, ""),
                          ("u/one", "foo/bar.py", False, "x = 1"), ("u/one", "data/blob.bin", True, None),
                          ("u/two", "a.py", False, "print('hi')")])


def test_stream_rerun_adds_nothing(spark):
    t = _tree(spark)
    repos = spark.createDataFrame([(1, "u/one", "one", "2020-01-01", "h1", None), (2, "u/two", "two", "2020-02-01", "h2", "d")],
                                  "repo_id long, full_name string, name string, created_at string, html_url string, description string")
    empty = spark.createDataFrame([], "repo_id long, name string, excluded boolean, content string")
    base = tempfile.mkdtemp(prefix="rs-stream-")
    jsonl.write_dataset(jsonl.dataset_records(t, empty, empty, repos).repartition(2), base + "/src")
    ST.run_ingest(spark, base + "/src", base + "/sink", base + "/ckpt")
    n1 = spark.read.parquet(base + "/sink").count()
    ST.run_ingest(spark, base + "/src", base + "/sink", base + "/ckpt")
    n2 = spark.read.parquet(base + "/sink").count()
    assert n1 == n2 == 5


def _record(name, files, readme=("README.md", False, "word " * 2000), tag=""):
    kids = [{"name": n, "excluded": x, "content": None if x else tag + "pass"} for n, x in files]
    ref = [json.dumps(dict(zip(("name", "excluded", "content"), readme)))] if readme else []
    refs = ",".join(ref)
    tree = json.dumps({"name": "repo", "children": kids})
    return f'{{"repo":{tree},"references":[{refs}],"setuppy":null,"removed_files":[],"meta":{json.dumps({"full_name": name, "name": name})}}}'


def _put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("".join(x + "\n" for x in lines))


def test_ingest_gates_repeats_and_replays(spark):
    base = tempfile.mkdtemp(prefix="rs-ingest-")
    src, sink, ckpt = (f"{base}/{x}" for x in ("src", "sink", "ckpt"))
    detector = lambda raw: raw.select("repo_id", F.when(F.col("raw").contains("mot"), "fr").otherwise("en").alias("pred_lang"))
    py = [("main.py", False), ("b.txt", False)]
    _put(src, "1.json", [
        _record("u/good", py), _record("u/good", py), _record("u/good", py, tag="x"), _record("u/nopython", [("a.txt", False)]), _record("u/empty", []),
        _record("u/excluded", [("main.py", True)]), _record("u/noreadme", py, None), _record("u/short", py, ("README.md", False, "few")),
        _record("u/french", py, ("README.md", False, "mot " * 2000)), _record("u/rst", py, ("README.rst", False, "word " * 2000)), "no json", "{}"])
    run = lambda: ST.run_ingest(spark, src, sink, ckpt, detector=detector)
    stored = lambda: sorted((r.full_name, r.path_str) for r in spark.read.parquet(sink).collect())
    work = run()
    assert stored() == [("u/good", "b.txt"), ("u/good", "main.py")]
    rejected = {(r.full_name, r.reason) for r in spark.read.parquet(f"{work}/rejected").collect()}
    assert rejected == {("u/nopython", "no_python_file"), ("u/empty", "no_files"), ("u/excluded", "no_python_file"), ("u/noreadme", "missing"),
                        ("u/short", "too_short"), ("u/french", "not_english"), ("u/rst", "not_markdown")}
    run()
    assert len(stored()) == 2
    # a late repeat adds nothing; a repository that was rejected before may come again and pass
    _put(src, "2.json", [_record("u/good", py, tag="late"), _record("u/short", py), _record("u/new", py)])
    run()
    want = sorted((n, p) for n in ("u/good", "u/short", "u/new") for p in ("main.py", "b.txt"))
    assert stored() == want
    # the last batches of both streams are replayed, as after a failure between output and commit
    for stream in ("gate", "store"):
        commits = f"{ckpt}/{stream}/commits"
        last = max(int(x) for x in os.listdir(commits) if x.isdigit())
        for name in (str(last), f".{last}.crc"):
            if os.path.exists(f"{commits}/{name}"):
                os.remove(f"{commits}/{name}")
    run()
    assert stored() == want


def test_scan_files(spark):
    root = tempfile.mkdtemp(prefix="rs-scan-")
    files = {"r1/main.py": b"print(1)\n", "r1/pkg/__init__.py": b"", "r1/pkg/__pycache__/x.pyc": b"\x00\x01",
             "r1/big.txt": b"a" * 100001,
             "r1/bin.dat": b"\x00\x01\x02abc", "r1/bad.txt": b"ok\xffok"}
    for rel, data in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "wb") as f:
            f.write(data)
    got = {(r.repo, r.path_str): (r.excluded, r.content) for r in scan.scan_files(spark, root).collect()}
    assert ("r1", "pkg/__pycache__/x.pyc") not in got
    assert got[("r1", "main.py")] == (False, "print(1)\n")
    assert got[("r1", "pkg/__init__.py")] == (False, "")
    assert got[("r1", "big.txt")] == (True, None)
    assert got[("r1", "bin.dat")] == (True, None)
    assert got[("r1", "bad.txt")] == (False, "okok")


def test_scan_in_small_splits(spark):
    """Folders are listed by tasks, level by level, and files read in splits by bytes, hidden and odd names included."""
    root = tempfile.mkdtemp(prefix="rs-splits-")
    want = {}
    for repo in range(5):
        for i in range(1 + 30 * (repo == 2)):
            rel = f"d{i % 3}/e é/_f{i}.py"
            os.makedirs(os.path.dirname(f"{root}/r{repo}/{rel}"), exist_ok=True)
            want[f"r{repo}", rel] = f"x = {i}\n" * (i + 1)
            with open(f"{root}/r{repo}/{rel}", "w") as f:
                f.write(want[f"r{repo}", rel])
    os.makedirs(f"{root}/empty/a/b")
    os.symlink(f"{root}/r2", f"{root}/r1/link")
    listing = scan.list_files(spark, root)
    splits = scan.in_splits(listing, 5 * scan.LEAST_BYTES)
    sizes = [r["n"] for r in splits.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == len(want) == listing.count() and max(sizes) <= 6 and len(sizes) >= 6
    assert {(r.repo, r.path_str): r.content for r in scan.scan_files(spark, root).collect()} == want
    nothing = tempfile.mkdtemp(prefix="rs-nothing-")
    assert scan.scan_files(spark, nothing).count() == 0


def test_pages_are_files_with_a_mapping(spark):
    from reposcope.sources import pages
    folder = tempfile.mkdtemp(prefix="rs-pages-") + "/out"
    docs = spark.createDataFrame([(i, f"page{i}.html", f"<p>é{i}</p>\n" * i) for i in range(20)], "id long, file_name string, html string").repartition(4)
    pages.write_pages(docs, folder)
    assert {(r.file_name, r.html) for r in pages.read_pages(spark, folder).collect()} == {(r.file_name, r.html) for r in docs.collect() if r.html}
    mapping = spark.read.schema("id long, file_name string").json(f"{folder}/mapping-*.jsonl")
    assert sorted((r.id, r.file_name) for r in mapping.collect()) == [(i, f"page{i}.html") for i in range(20)]
    with open(f"{folder}/_SUCCESS") as f:
        assert json.load(f) == {"n_files": 20, "n_bytes": sum(len(r.html.encode()) for r in docs.collect())}
    for bad in (docs, docs.withColumn("file_name", F.lit("../x.html"))):
        try:
            pages.write_pages(bad, folder if bad is docs else folder + "2")
            raise AssertionError("accepted")
        except Exception as e:
            assert "accepted" not in str(e)
    assert not os.path.exists(f"{folder}2/_SUCCESS")
    # written again over a half-written folder, as after a failure
    os.remove(f"{folder}/_SUCCESS")
    pages.write_pages(docs, folder, "overwrite")
    assert pages.read_pages(spark, folder).count() == 19 and os.path.exists(f"{folder}/page0.html")  # an empty page is a file without a row


def test_scan_archives(spark):
    root = tempfile.mkdtemp(prefix="rs-zip-")
    os.makedirs(os.path.join(root, "u", "good"))
    os.makedirs(os.path.join(root, "u", "bad"))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("repo/main.py", "print(1)")
        z.writestr("repo/pkg/mod.py", "x = 2")
        z.writestr("other/skip.py", "y")
    with open(os.path.join(root, "u", "good", "repo.zip"), "wb") as f:
        f.write(buf.getvalue())
    with open(os.path.join(root, "u", "bad", "repo.zip"), "wb") as f:
        f.write(b"not a zip")
    files, status = scan.scan_archives(spark, root)
    assert {(r.repo, r.path_str) for r in files.collect()} == {("u/good", "main.py"), ("u/good", "pkg/mod.py")}
    assert {(r.repo, r.status) for r in status.collect()} == {("good", "ok"), ("bad", "bad_zip")}


def test_temporal_split_parses_iso_strings(spark):
    df = spark.createDataFrame([("a", "2020-06-12T00:00:00Z"), ("b", "2020-06-13T10:00:00Z"), ("c", "2019-01-01")],
                               "full_name string, created_at string")
    got = {r.full_name: r.split for r in SP.temporal_split(df).collect()}
    assert got == {"a": "train", "b": "heldout", "c": "train"}


def test_duplicate_paths_raise(spark):
    import pytest
    df = spark.createDataFrame([("r", "a.py"), ("r", "a.py")], "full_name string, path_str string")
    with pytest.raises(Exception):
        jsonl.assert_unique_paths(df).collect()


def _kept(spark, *names):
    from reposcope.session import ensure_checkpoint_dir
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(top) if x.startswith(names)}


def test_scratch_tables_go_with_their_block(spark):
    from reposcope.session import discard, scratch, stored
    df = spark.range(5).selectExpr("id", "id % 2 AS part")
    with scratch(spark):
        stays = stored(df, "outer")
        with scratch(spark):
            stored(df, "inner")
            assert _kept(spark, "inner-")
        assert not _kept(spark, "inner-") and stays.count() == 5
    assert not _kept(spark, "outer-")
    cut = stored(df, "cut", "part")
    discard(cut, "part=1")
    assert cut.where("part = 0").count() == 3
    discard(cut)
    assert not _kept(spark, "cut-")


def test_ingest_leaves_no_tables_of_its_batches(spark):
    names = ("records-", "level-", "judged-", "items-", "folders-")
    base, before = tempfile.mkdtemp(prefix="rs-disk-"), _kept(spark, *names)
    py = [("main.py", False), ("b.txt", False)]
    _put(f"{base}/src", "1.json", [_record("u/good", py), _record("u/good", py), _record("u/other", py), _record("u/empty", [])])
    for _ in range(2):
        work = ST.run_ingest(spark, f"{base}/src", f"{base}/sink", f"{base}/ckpt")
    assert _kept(spark, *names) == before and sorted(x for x in os.listdir(work)) == ["gated", "rejected"]
    assert spark.read.parquet(f"{base}/sink").count() == 4
    assert sorted(r.full_name for r in spark.read.parquet(f"{work}/gated").collect()) == ["u/good", "u/other"]  # of equal records one


def test_trees_lose_their_texts_alone(spark):
    texts = ["x = 1", '"content":"a"', "\\", "\\\\\"", 'say "content":"', '{"content":"x","children":[]}', "", "a\nb\t\u2028é", "\\" * 50_000 + '"' * 50_000, None]
    kids = [{"name": f"f{i}.py", "excluded": i % 3 == 0, "content": t} for i, t in enumerate(texts)]
    kids.append({"name": "content", "children": [{"name": '"content":"y"', "excluded": False, "content": "z"}, {"name": "none", "excluded": True}]})
    line = json.dumps({"repo": {"name": "repo", "children": kids}, "references": [], "setuppy": None, "removed_files": [], "meta": {"full_name": "u/r"}}, indent=None)
    recs = spark.createDataFrame([(line,)], "value string").select(F.from_json("value", jsonl.RECORD_SCHEMA).alias("r")).select("r.*")
    slim = recs.withColumn("repo", jsonl.without_texts("repo"))
    assert len(slim.first()["repo"]) < 1000 and '"z"' not in slim.first()["repo"]
    paths = lambda df: sorted(df.select("path_str", "excluded", "ord").collect())
    assert paths(jsonl.flatten_tree(slim, content=False)) == paths(jsonl.flatten_tree(recs, content=False)) == paths(jsonl.flatten_tree(recs))
    assert {r.content for r in jsonl.flatten_tree(slim).collect()} == {None}
