"""Class, entry-point, module-exec and file-name extraction (cases F2, F8, F9)."""

from pyspark.sql import functions as F

from reposcope.functions import text as T
from reposcope.operators import extract as X


def _classes(spark, text):
    df = spark.createDataFrame([(1, "f.py", text)], "repo_id long, path_str string, content string")
    return sorted((r.cls, tuple(sorted(r.bases))) for r in X.extract_classes(df).collect())


def test_extract_class(spark):
    text = ("class Ship:\n    class Mast(Wood, parts.Tall):\n        pass\n"
            "class Sail(\n        Cloth,\n        metaclass=Meta):\n    pass\n"
            "class Empty():\n    pass\nclassless = 1\n")
    got = dict(_classes(spark, text))
    assert set(got) == {"Ship", "Mast", "Sail", "Empty"}
    assert got["Ship"] == got["Empty"] == ()
    assert set(got["Mast"]) >= {"Wood"} and "Cloth" in got["Sail"]
    assert _classes(spark, "") == [] and _classes(spark, "subclass Foo\n") == []


def _entry_modules(spark, text):
    df = spark.createDataFrame([(text,)], "content string")
    return sorted(".".join(m) for m in df.select(X.setup_entrypoint_modules(F.col("content"))).first()[0])


def test_setup_entrypoints(spark):
    groups = ('from setuptools import setup\nsetup(name="harbour", entry_points={"console_scripts": ["dock = harbour.dock:main",  # opens\n'
              '  "crane=harbour.tools.crane:lift"], "gui_scripts": ["map = harbour.chart:show"]}, zip_safe=False)')
    assert _entry_modules(spark, groups) == ["harbour.chart", "harbour.dock", "harbour.tools.crane"]
    assert _entry_modules(spark, "setup(name='harbour', packages=['harbour.dock'])") == []


def test_setup_entrypoints_without_quotes(spark):
    """Members may be plain, quoted or mixed; comments and mappings are none."""
    plain = "entry_points = {console_scripts: [dock = harbour.dock:main, crane=harbour.crane:lift], other: [ map =\n harbour.chart:show ]}"
    assert _entry_modules(spark, plain) == ["harbour.chart", "harbour.crane", "harbour.dock"]
    mixed = """entry_points={'a': ["one = p.one:f", two = p.two:g,  # three = p.three:h
        'four = p.four:i', five: p.five, six = p.six: j, seven = p.seven:k],
        # eight = p.eight:l
        'b': []}"""
    assert _entry_modules(spark, mixed) == ["p.four", "p.one", "p.seven", "p.two"]


def test_module_exec(spark):
    df = spark.createDataFrame([("first python3 -m harbour.dock --open, then python  -m crane -x",)], "content string")
    got = {".".join(m) for m in df.select(X.module_exec_mentions(F.col("content"))).first()[0]}
    assert got == {"harbour.dock", "crane"}


def test_python_file_names(spark):
    df = spark.createDataFrame([("dock.py",), ("dry_dock2.pyx",), ("dock.py.bak",), ("dry-dock.py",)], "name string")
    got = [r[0] for r in df.select(T.python_base_name("name")).collect()]
    assert got == ["dock", "dry_dock2", "", ""]


def test_inheritance_counts(spark):
    rows = [(1, "a.py", "class Base:\n    pass\n"), (1, "b.py", "class X(Base):\n    pass\nclass Y(Base, Z):\n    pass\n"),
            (1, "c.py", "class Z(Base):\n    pass\n")]
    df = spark.createDataFrame(rows, "repo_id long, path_str string, content string")
    got = {r.path_str: r.num_inherited for r in X.inheritance_counts(df).collect()}
    assert got == {"a.py": 3, "b.py": 0, "c.py": 1}


def test_module_exec_at_end_of_text(spark):
    df = spark.createDataFrame([("run python -m pkg.cli",)], "content string")
    assert [tuple(m) for m in df.select(X.module_exec_mentions(F.col("content"))).first()[0]] == [("pkg", "cli")]
    assert df.select(X.module_exec_mentions(F.col("content"), compat=True)).first()[0] == []
