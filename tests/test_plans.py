"""Plan shape guards: filters reach the Parquet scan, unused columns are pruned."""

import contextlib
import io

import __spark_entry__ as entry


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_python_files_prunes_content_and_pushes_filters(spark):
    plan = _plan(entry.queries()["python_files"](spark, "/root/testdata/sf0.001"))
    scans = [ln for ln in plan.splitlines() if ln.startswith("ReadSchema")]
    assert scans and all("content" not in ln for ln in scans)
    assert "PushedFilters" in plan and "excluded" in plan.split("PushedFilters", 1)[1].splitlines()[0]


def test_import_resolution_has_no_window_and_no_loop_join(spark):
    from reposcope.operators import resolve as R
    mods = spark.createDataFrame([(1, ["a", "b"])], "repo_id long, module array<string>")
    imps = spark.createDataFrame([(1, ["a", "b"], ["a"])], "repo_id long, module array<string>, imp array<string>")
    plan = _plan(R.resolve_all_roots(mods, imps))
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    edges, best = R.import_edges(mods, imps)
    assert all("Window" not in _plan(df) for df in (edges, best))


def test_path_mentions_carry_no_readme(spark):
    from reposcope.operators import extract as X
    files = spark.createDataFrame([(1, "a.py")], "repo_id long, path_str string")
    readmes = spark.createDataFrame([(1, "see a.py")], "repo_id long, content string")
    plan = _plan(X.path_mentions(files, readmes))
    semi = [x for x in plan.splitlines() if "LeftSemi" in x or "Left semi" in x.lower() or "leftsemi" in x.lower()]
    assert semi and "contains(" not in plan.lower()
