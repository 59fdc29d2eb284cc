"""Table-generating extraction (X1-X8, T13) and per-file content/name features.

All extraction is ``regexp_extract_all`` + higher-order array functions inside
whole-stage codegen; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.functions import text as T
from reposcope.operators import filters as FL
from reposcope.session import merged


def _module_parts(from_col: Column, item: Column, compat: bool = False) -> Column:
    """from-part + item split on '.'; a from-part made only of dots means that
    many levels up (one '' per dot). ``compat`` keeps the source's splitting
    (``'..'`` gives three empty parts; a trailing space stays in the part)."""
    if compat:
        from_parts = (F.when(from_col == "", F.array().cast("array<string>"))
                      .when(from_col == ".", F.array(F.lit("")))
                      .otherwise(F.split(from_col, r"\.")))
        return F.concat(from_parts, F.split(item, r"\."))
    f = F.trim(from_col)
    from_parts = (F.when(f == "", F.array().cast("array<string>"))
                  .when(f.rlike(r"^\.+$"), F.array_repeat(F.lit(""), F.length(f)))
                  .otherwise(F.split(f, r"\.")))
    return F.concat(from_parts, F.split(item, r"\."))


def import_arrays(content: Column, compat: bool = False) -> Column:
    """X1 for one text: ARRAY<ARRAY<STRING>> of imported module paths (not
    yet distinct). Aliases (``a as b``) are dropped unless ``compat``."""
    g_from = F.regexp_extract_all(content, F.lit(P.IMPORT_JAVA), 1)
    g_par = F.regexp_extract_all(content, F.lit(P.IMPORT_JAVA), 2)
    g_plain = F.regexp_extract_all(content, F.lit(P.IMPORT_JAVA), 3)
    z = F.arrays_zip(g_from.alias("f"), g_par.alias("p"), g_plain.alias("l"))

    def per_stmt(m):
        lst = F.when(m["p"] != "", m["p"]).otherwise(m["l"])
        lst = F.regexp_replace(lst, P.IMPORT_LIST_NOISE, " ")
        if compat:
            items = F.transform(F.split(lst, ","), lambda s: F.trim(s))
        else:
            items = F.transform(F.split(lst, ","), lambda s: F.regexp_replace(F.trim(s), r" +as +.*$", ""))
        items = F.filter(items, lambda s: s != "")
        return F.transform(items, lambda s: _module_parts(m["f"], s, compat))

    return F.flatten(F.transform(z, per_stmt))


def file_signals(pyfiles: DataFrame) -> DataFrame:
    """All that feature assembly takes from the text of a Python file, in one
    pass and without the text: ``imports``, ``classes`` and the X7 columns. The
    extractors below read these columns where a table has them."""
    imports = F.array_distinct(import_arrays(F.col("content"))).alias("imports")
    return pyfiles.select("repo_id", "path", "path_str", "name", "ord", "module", imports,
                          class_arrays(F.col("content")).alias("classes"), *_content_columns())


def extract_imports(pyfiles: DataFrame) -> DataFrame:
    """(repo_id, path_str, module, imp) with distinct imports per file.
    ``pyfiles`` must carry ``module`` (see ``modules``)."""
    found = F.col("imports") if "imports" in pyfiles.columns else F.array_distinct(import_arrays(F.col("content")))
    return pyfiles.select("repo_id", "path_str", "module", F.explode(found).alias("imp"))


def class_arrays(content: Column) -> Column:
    """X2 for one text: ARRAY<STRUCT<c, b>> of class names and raw base lists."""
    return F.arrays_zip(F.regexp_extract_all(content, F.lit(P.CLASS_RE), 1).alias("c"),
                        F.regexp_extract_all(content, F.lit(P.CLASS_RE), 2).alias("b"))


def modules(files: DataFrame) -> DataFrame:
    """P6 + P12: Python files with their module path."""
    return FL.python_files(files).withColumn("module", FL.module_of("path", "base"))


def extract_classes(pyfiles: DataFrame) -> DataFrame:
    """(repo_id, path_str, cls_idx, cls, bases ARRAY<STRING> distinct)."""
    z = F.col("classes") if "classes" in pyfiles.columns else class_arrays(F.col("content"))
    df = pyfiles.select("repo_id", "path_str", F.posexplode(z).alias("cls_idx", "m"))
    base_list = F.transform(F.split(F.regexp_replace(F.col("m.b"), P.CLASS_BASE_NOISE, " "), ","), lambda s: F.trim(s))
    return df.select("repo_id", "path_str", "cls_idx", F.col("m.c").alias("cls"),
                     F.array_distinct(F.filter(base_list, lambda s: s != "")).alias("bases"))


def inheritance_counts(pyfiles: DataFrame) -> DataFrame:
    """For every base-class mention, +1 to each file of the repo defining a
    class of that name. (repo_id, path_str, num_inherited) for every Python file."""
    classes = extract_classes(pyfiles)
    defs = classes.select("repo_id", "cls", F.col("path_str").alias("def_path")).distinct()
    mentions = classes.select("repo_id", F.explode("bases").alias("cls"))
    hits = (mentions.join(merged(defs), ["repo_id", "cls"])
            .groupBy("repo_id", "def_path").agg(F.count(F.lit(1)).alias("num_inherited")))
    return (pyfiles.select("repo_id", "path_str")
            .join(merged(hits.withColumnRenamed("def_path", "path_str")), ["repo_id", "path_str"], "left")
            .select("repo_id", "path_str", F.coalesce("num_inherited", F.lit(0)).cast("bigint").alias("num_inherited")))


def setup_entrypoint_modules(content: Column) -> Column:
    """ARRAY<ARRAY<STRING>> of modules named by ``entry_points`` list
    members of the form 'name = mod.path:func' (exactly one '=' and one ':'),
    quoted or not."""
    dicts = F.regexp_extract_all(content, F.lit(P.ENTRY_POINTS_RE), 1)

    def lists_of(d):
        return F.regexp_extract_all(d, F.lit(P.LIST_RE), 1)

    def members_of(lst):
        double, single, plain = (F.regexp_extract_all(lst, F.lit(P.MEMBER_RE), k) for k in (1, 2, 3))
        # a plain member with a colon before a blank is a mapping, no string
        plain = F.transform(plain, lambda m: F.when(m.rlike(r":(?:\s|$)"), "").otherwise(F.regexp_replace(m, r"\s+", " ")))
        return F.transform(F.arrays_zip(double.alias("a"), single.alias("b"), plain.alias("c")),
                           lambda m: F.concat(m["a"], m["b"], m["c"]))

    members = F.flatten(F.transform(F.flatten(F.transform(dicts, lists_of)), members_of))
    eq = F.transform(members, lambda s: F.split(F.trim(s), "="))
    ok = F.filter(eq, lambda parts: F.size(parts) == 2)
    rhs = F.transform(ok, lambda parts: F.split(F.trim(parts[1]), ":"))
    ok2 = F.filter(rhs, lambda parts: F.size(parts) == 2)
    return F.array_distinct(F.transform(ok2, lambda parts: F.transform(F.split(parts[0], r"\."), lambda s: F.trim(s))))


def module_exec_mentions(content: Column, compat: bool = False) -> Column:
    """``python[23] -m pkg.mod`` module paths; ``compat`` requires a
    trailing blank as the source does (a mention ending the text is missed)."""
    pat = P.MODULE_EXEC_COMPAT_RE if compat else P.MODULE_EXEC_RE
    mods = F.regexp_extract_all(content, F.lit(pat), 1)
    return F.array_distinct(F.transform(mods, lambda m: F.split(m, r"\.")))


def code_blocks(content: Column) -> Column:
    """ARRAY<STRUCT<lang, body>> of fenced code blocks."""
    langs = F.regexp_extract_all(content, F.lit(P.CODE_FENCE_RE), 1)
    bodies = F.regexp_extract_all(content, F.lit(P.CODE_FENCE_RE), 2)
    return F.arrays_zip(langs.alias("lang"), bodies.alias("body"))


def readme_imports(content: Column) -> Column:
    """Imports inside untyped or ``python`` code blocks."""
    blocks = F.filter(code_blocks(content), lambda b: (b["lang"] == "") | (b["lang"] == "python"))
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: import_arrays(b["body"]))))


def content_features(pyfiles: DataFrame) -> DataFrame:
    """Main-func / argument-parser / web-framework words, chars, too short."""
    if "content_chars" in pyfiles.columns:
        return pyfiles.select("repo_id", "path_str", *CONTENT_COLUMNS)
    return pyfiles.select("repo_id", "path_str", *_content_columns())


CONTENT_COLUMNS = ("contains_main_func", "contains_argument_parser", "contains_web_framework", "content_chars", "too_short")


def _content_columns() -> list[Column]:
    c = F.col("content")
    cols = [T.word_match(c, P.MAIN_FUNC_WORDS), T.word_match(c, P.ARGUMENT_PARSER_WORDS), T.word_match(c, P.WEB_FRAMEWORK_WORDS),
            F.length(c).cast("bigint"), F.length(c) < P.TOO_SHORT_CHARS]
    return [x.alias(n) for x, n in zip(cols, CONTENT_COLUMNS)]


def filename_features(pyfiles: DataFrame, repos: DataFrame) -> DataFrame:
    """Name-based features. The repo name is lower-cased as well before the
    comparison (the source compares a lower-cased stem with the raw name)."""
    fn = F.lower(F.col("name"))
    df = pyfiles.join(merged(repos.select("repo_id", F.col("name").alias("repo_name"))), "repo_id", "left")
    return df.select(
        "repo_id", "path_str",
        fn.contains("main").alias("has_main_in_filename"),
        fn.isin(*P.MAIN_ISH_NAMES).alias("is_main_ish_names"),
        (fn == "__init__.py").alias("is_module"),
        fn.startswith("test_").alias("is_test_ish_name"),
        F.coalesce(F.split(fn, r"\.")[0] == F.lower(F.col("repo_name")), F.lit(False)).alias("has_same_name_as_repo"),
        (F.size("path") - 1).cast("bigint").alias("level"))


def path_mentions(pyfiles: DataFrame, readmes: DataFrame) -> DataFrame:
    """Python files whose '/'-joined path occurs in the README text.

    A path ends where ``.py``, ``.pyc`` or ``.pyx`` does, so the only substrings
    that can be one end there and have the length of a path of the repository.
    Those are joined on (repo_id, path): the README is read once, whatever the
    number of files, and is copied to none."""
    lengths = pyfiles.groupBy("repo_id").agg(F.collect_set(F.length("path_str")).alias("lengths"))
    r = readmes.select("repo_id", F.split("content", "").alias("c")).join(merged(lengths), "repo_id")
    at = lambda i: F.get(F.col("c"), i)
    ends = F.filter(F.sequence(F.lit(3), F.greatest(F.size("c"), F.lit(3))),
                    lambda e: (at(e - 1) == "y") & (at(e - 2) == "p") & (at(e - 3) == "."))
    ends = F.flatten(F.transform(ends, lambda e: F.when(at(e).isin("c", "x"), F.array(e, e + 1)).otherwise(F.array(e))))
    pieces = F.flatten(F.transform(ends, lambda e: F.transform(
        F.filter("lengths", lambda n: n <= e), lambda n: F.array_join(F.slice("c", e - n + 1, n), ""))))
    found = r.select("repo_id", F.explode(F.array_distinct(pieces)).alias("path_str"))
    return pyfiles.select("repo_id", "path_str").join(merged(found), ["repo_id", "path_str"], "left_semi")
