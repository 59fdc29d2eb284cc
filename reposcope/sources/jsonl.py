"""Repository dataset records as JSON lines.

A record is ``{repo: Directory, references: [File], setuppy: File|null,
removed_files: [str], meta: {...}}`` where Directory is a recursive
``{name, children: [File | Directory]}`` and File ``{name, excluded, content}``.

Spark has no recursive struct type, so both directions work level by level:
writing nests one directory level per ``groupBy`` (bottom-up); reading parses
children as raw JSON strings and flattens one level per round (top-down).
The number of rounds is the tree depth, not the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.session import discard, stored

FILE_JSON = "struct<name:string, excluded:boolean, content:string, children:array<string>>"
#: a file's text in a tree as Spark writes it; within a JSON string the quotes would be escaped
CONTENT = r'"content":"(?:[^"\\]++|\\.)*+"'
RECORD_SCHEMA = ("struct<repo:string, references:array<string>, setuppy:string, removed_files:array<string>, "
                 "meta:struct<full_name:string, name:string, created_at:string, html_url:string, description:string>>")


def _file_json(name, excluded, content):
    return F.to_json(F.struct(name.alias("name"), excluded.alias("excluded"), content.alias("content")))


def _dir_json(name, children_json):
    head = F.to_json(F.struct(name.alias("name")))
    return F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"children":['), children_json, F.lit("]}"))


def nest_tree(tree: DataFrame) -> DataFrame:
    """(repo_id, path, name, excluded, content, ord) -> (repo_id, tree_json).
    Children keep traversal order (smallest ``ord`` below them). The files are
    stored once, by level; a round reads its own and the folders from below, and
    both go when it has stored its folders."""
    files = stored(tree.select("repo_id", F.slice("path", 1, F.size("path") - 1).alias("parent"),
                               _file_json(F.col("name"), F.col("excluded"), F.col("content")).alias("json"),
                               F.col("ord").alias("okey"), (F.size("path") - 1).alias("level")), "items", "level")
    at = lambda level: files.where(F.col("level") == level).drop("level")
    depth = files.agg(F.max("level")).first()[0] or 0
    items, below = at(depth), None
    for level in range(depth, 0, -1):
        dirs = items.groupBy("repo_id", "parent").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("okey", "json"))), lambda s: s["json"]),
                         ",").alias("children"),
            F.min("okey").alias("okey"))
        up = dirs.select("repo_id", F.slice("parent", 1, F.lit(level - 1)).alias("parent"),
                         _dir_json(F.element_at("parent", -1), F.col("children")).alias("json"), "okey")
        folders = stored(up, "folders")
        # what this round has read is in the folders
        discard(files, f"level={level}")
        if below is not None:
            discard(below)
        items, below = at(level - 1).unionByName(folders), folders
    root = items.groupBy("repo_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("okey", "json"))), lambda s: s["json"]),
                     ",").alias("children"))
    return root.select("repo_id", _dir_json(F.lit("repo"), F.col("children")).alias("tree_json"))


def dataset_records(tree: DataFrame, readmes: DataFrame, setups: DataFrame, repos: DataFrame,
                    removed_files: DataFrame | None = None) -> DataFrame:
    """S5 + P17: one JSON line per repository. ``removed_files`` (repo_id,
    removed_files) is what earlier steps took out, as ``read_removed`` gives it;
    ``setup.py`` is appended when it was taken out here."""
    nested = nest_tree(tree)
    rd = readmes.select("repo_id", _file_json(F.col("name"), F.col("excluded"), F.col("content")).alias("readme"))
    st = setups.select("repo_id", _file_json(F.col("name"), F.col("excluded"), F.col("content")).alias("setup"))
    j = repos.join(nested, "repo_id").join(rd, "repo_id", "left").join(st, "repo_id", "left")
    none = F.array().cast("array<string>")
    removed = F.when(F.col("setup").isNotNull(), F.array(F.lit("setup.py"))).otherwise(none)
    if removed_files is not None:
        j = j.join(removed_files.select("repo_id", F.col("removed_files").alias("_earlier")), "repo_id", "left")
        removed = F.concat(F.coalesce("_earlier", none), removed)
    meta = F.to_json(F.struct(F.col("full_name"), F.col("name"), F.col("created_at").cast("string").alias("created_at"),
                              F.col("html_url"), F.col("description")))
    line = F.concat(F.lit('{"repo":'), F.col("tree_json"),
                    F.lit(',"references":['), F.coalesce(F.col("readme"), F.lit("")), F.lit("]"),
                    F.lit(',"setuppy":'), F.coalesce(F.col("setup"), F.lit("null")),
                    F.lit(',"removed_files":'), F.to_json(removed),
                    F.lit(',"meta":'), meta, F.lit("}"))
    return j.select("repo_id", line.alias("value"))


def write_dataset(records: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """JSONL text files; refuses to overwrite unless asked."""
    records.select("value").write.mode(mode).text(path, compression=compression)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """S3: parse each line; the tree stays a raw JSON string until flattened."""
    raw = spark.read.text(path)
    return raw.select(F.from_json("value", RECORD_SCHEMA).alias("r")).select("r.*")


def without_texts(tree_json) -> Column:
    """The tree, as ``RECORD_SCHEMA`` parses it, without the texts of its files."""
    return F.regexp_replace(tree_json, CONTENT, '"content":null')


def flatten_tree(records: DataFrame, key: str = "full_name", content: bool = True) -> DataFrame:
    """P5: (key, path ARRAY<STRING>, path_str, name, excluded, content, ord).
    One round per directory level, which parses its nodes once and drops those of
    the level above; ``ord`` is the position in traversal order. Without
    ``content`` that column is left out."""
    texts = ["content"] if content else []
    frontier = records.select(F.col(f"meta.{key}").alias(key), F.array().cast("array<string>").alias("path"),
                              F.array().cast("array<int>").alias("pos"), F.col("repo").alias("json"))
    files = above = None
    while True:  # one round per level, down to the last
        node = frontier.select(key, "path", "pos", F.from_json("json", FILE_JSON).alias("n"))
        kids = node.select(key, "path", "pos", F.posexplode(F.coalesce(F.col("n.children"),
                                                                       F.array().cast("array<string>"))).alias("i", "json"))
        parsed = kids.select(key, "path", F.concat("pos", F.array("i")).alias("pos"), "json",
                             F.from_json("json", FILE_JSON).alias("c"))
        is_dir = F.col("c.children").isNotNull()
        level = stored(parsed.select(
            key, F.concat("path", F.array(F.col("c.name"))).alias("path"), "pos", F.col("c.name").alias("name"),
            F.col("c.excluded").alias("excluded"), *[F.col(f"c.{t}").alias(t) for t in texts],
            F.when(is_dir, F.col("json")).alias("json"), F.coalesce(is_dir, F.lit(False)).alias("is_dir")), "level", "is_dir", codec="zstd")
        if above is not None:
            discard(above, "is_dir=true")  # its folders are in this level now
        above = level
        leaf = level.where(~F.col("is_dir")).drop("json", "is_dir")
        files = leaf if files is None else files.unionByName(leaf)
        frontier = level.where("is_dir").select(key, "path", "pos", "json")
        if frontier.isEmpty():
            break
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy("pos")
    flat = files.select(key, "path", F.array_join("path", "/").alias("path_str"), "name", "excluded", *texts,
                        (F.row_number().over(w) - 1).cast("int").alias("ord"))
    return assert_unique_paths(flat, key)


def assert_unique_paths(flat: DataFrame, key: str = "full_name") -> DataFrame:
    """P5: a path occurring twice in one repository is an error (raised while
    the rows are produced, no extra pass)."""
    from pyspark.sql import Window
    n = F.count(F.lit(1)).over(Window.partitionBy(key, "path_str"))
    return flat.withColumn("_n", n).withColumn(
        "path_str", F.when(F.col("_n") == 1, F.col("path_str")).otherwise(
            F.raise_error(F.concat(F.lit("duplicate path in repository: "), F.col("path_str"))))).drop("_n")


def _sidecars(spark: SparkSession, pattern: str) -> DataFrame:
    """(full_name, value): whole files, named by the two folders that hold them."""
    raw = spark.read.option("wholetext", True).text(pattern)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(F.concat_ws("/", F.get(parts, F.size(parts) - 3), F.get(parts, F.size(parts) - 2)).alias("full_name"), "value")


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/results/<user>/<repo>/meta.json``; a file that is no JSON object is skipped."""
    kind = "struct<name:string, created_at:string, html_url:string, description:string>"
    rows = _sidecars(spark, f"{root.rstrip('/')}/results/*/*/meta.json")
    return rows.select("full_name", F.from_json("value", kind).alias("m")).where("m is not null").select("full_name", "m.*")


def read_removed(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<user>/<repo>/removed_files.json``, a JSON array of paths."""
    rows = _sidecars(spark, f"{root.rstrip('/')}/*/*/removed_files.json")
    return rows.select("full_name", F.coalesce(F.from_json("value", "array<string>"), F.array().cast("array<string>")).alias("removed_files"))


def attach_meta(records: DataFrame, meta: DataFrame, key: str = "full_name") -> DataFrame:
    """Inner join with the metadata table; repositories without
    metadata are skipped."""
    return records.join(meta, key, "inner")
