"""File-system and archive sources (S1, S2, P1-P4) and their writers.

``scan_files`` walks a directory of repositories on the executors (Spark's
file index would hide ``__init__.py``), reading content only below the size
limit. ``scan_archives`` reads ``<user>/<repo>/repo.zip`` with the
``binaryFile`` source and unpacks each archive inside Arrow batches
(``mapInPandas``), never on the driver. ``write_file_tree`` /
``write_archives`` produce such inputs from a file table, from the executors.
"""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.functions import patterns as P
from reposcope.operators import filters as FL
from reposcope.operators.segments import running_before
from reposcope.session import stored

ARCHIVE_SCHEMA = ("user string, repo string, path_str string, n_bytes long, data binary, status string")


def _decode_lenient(content_bin) -> F.Column:
    """UTF-8 decode, invalid sequences dropped (strict ``decode`` raises on
    them in Spark 4; ``make_valid_utf8`` replaces them with U+FFFD first)."""
    return F.regexp_replace(F.make_valid_utf8(content_bin.cast("string")), "�", "")


def _finish(df: DataFrame) -> DataFrame:
    """Apply P1 (ignore rules), P2 (size), P3 (binary sniff), P4 (decode)."""
    df = df.withColumn("path", F.split("path_str", "/"))
    df = df.where(~FL.ignored("path"))
    too_big = F.col("n_bytes") >= P.MAX_FILE_BYTES
    binary = FL.binary_sniff(F.col("data"))
    excluded = too_big | F.coalesce(binary, F.lit(False))
    return df.select("*", excluded.alias("excluded")).select(
        *[c for c in df.columns if c not in ("data",)], "excluded",
        F.when(F.col("excluded"), F.lit(None).cast("string")).otherwise(_decode_lenient(F.col("data"))).alias("content"),
        F.element_at("path", -1).alias("name"))


BATCH_BYTES = 32 << 20
#: bytes of files that one task reads; a file counts as so many at least
SPLIT_BYTES, LEAST_BYTES = 128 << 20, 4096

_ENTRY = "repo string, rel string, is_dir boolean, n_bytes long"


def _listed(batches, root: str):
    """The entries of each folder (repo, rel). Directories that the ignore rules drop are not
    entered, and links to directories are not followed; directly below the root only folders
    count, as repositories."""
    import os
    import re

    from pyarrow.fs import FileSelector, FileType, LocalFileSystem
    fs, base = _fs_and_path(root)
    rules, local = re.compile(P.IGNORE_RE), isinstance(fs, LocalFileSystem)
    for b in batches:
        for repo, rel in zip(b["repo"], b["rel"]):
            folder = "/".join(x for x in (base, repo, rel) if x)
            rows = []
            for info in fs.get_file_info(FileSelector(folder)):
                if not repo:
                    if info.type == FileType.Directory:
                        rows.append((info.base_name, "", True, 0))
                    continue
                inside = f"{rel}/{info.base_name}" if rel else info.base_name
                if info.type == FileType.Directory:
                    if not rules.search(f"./{inside}/") and not (local and os.path.islink(info.path)):
                        rows.append((repo, inside, True, 0))
                elif info.type == FileType.File and not rules.search(f"./{inside}"):
                    rows.append((repo, inside, False, info.size))
            yield pd.DataFrame(rows, columns=["repo", "rel", "is_dir", "n_bytes"])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(repo, path_str, n_bytes) of all files below ``root/<repo>``, not read yet. Tasks list the
    folders, one round per level; a level is stored, so that no folder is listed twice."""
    folders = spark.createDataFrame([("", "")], "repo string, rel string")
    files = None
    while True:
        level = stored(folders.mapInPandas(lambda it: _listed(it, root), schema=_ENTRY), "listing")
        found = level.where(~F.col("is_dir")).select("repo", F.col("rel").alias("path_str"), "n_bytes")
        files = found if files is None else files.unionByName(found)
        below = level.where("is_dir").select("repo", "rel")
        if below.isEmpty():
            return files
        # dealt evenly: the folders of a level may come from one listing
        folders = below.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _read(batches, root: str):
    """Contents of listed files, in batches of about ``BATCH_BYTES``; a file that has gone since is left out."""
    fs, base = _fs_and_path(root)
    columns = ["repo", "path_str", "n_bytes", "data"]
    rows, held = [], 0
    for b in batches:
        for repo, rel, size in zip(b["repo"], b["path_str"], b["n_bytes"]):
            data = None
            if size < P.MAX_FILE_BYTES:  # P2 before any IO: content is read only below the size limit
                try:
                    with fs.open_input_stream(f"{base}/{repo}/{rel}") as src:
                        data = src.read()
                except FileNotFoundError:
                    continue
            rows.append((repo, rel, size, data))
            held += len(data or b"") + 200
            if held > BATCH_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
    yield pd.DataFrame(rows, columns=columns)


def in_splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The listing in partitions of about ``split_bytes`` to read each, whatever the repositories' sizes."""
    read = F.when(F.col("n_bytes") < P.MAX_FILE_BYTES, F.col("n_bytes")).otherwise(F.lit(0))
    sized = files.select(F.lit(0).alias("_all"), F.struct("repo", "path_str").alias("_at"), "n_bytes", F.greatest(read, F.lit(LEAST_BYTES)).alias("_n"))
    total = sized.agg(F.sum("_n")).first()[0] or 0
    placed = running_before(sized, "_all", "_at", "_n")
    split = F.floor(F.col("_before") / split_bytes).cast("int")
    return placed.repartitionById(1 + total // split_bytes, split).select("_at.repo", "_at.path_str", "n_bytes")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``root/<repo>/<path...>`` -> flat file rows
    (repo, path ARRAY, path_str, name, excluded, content, n_bytes).

    Spark's file index hides names starting with '_' or '.', which would drop
    every ``__init__.py``; so this is a custom scan: tasks list the folders
    level by level, the files found are cut into splits by bytes, and tasks
    read them (``mapInPandas``), content only for files under the size limit.
    The driver lists nothing. P1-P4 follow as column rules."""
    rows = in_splits(list_files(spark, root)).mapInPandas(
        lambda it: _read(it, root), schema="repo string, path_str string, n_bytes long, data binary")
    return _finish(rows)


def _members(data: bytes) -> list[tuple]:
    """(path, size, content below the size limit) of all files; raises if any cannot be read."""
    rows = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.is_dir() or not info.filename.startswith("repo/"):
                continue
            head = z.read(info) if info.file_size < P.MAX_FILE_BYTES else None
            rows.append((info.filename[len("repo/"):], info.file_size, head))
    return rows


def _unzip(batches):
    """Per archive one row of status, and its files if all of them could be read."""
    columns = ["user", "repo", "path_str", "n_bytes", "data", "status"]
    for b in batches:
        for path, data in zip(b["path"], b["content"]):
            user, repo = path.rstrip("/").split("/")[-3:-1]
            try:
                rows, status = _members(data), "ok"
            except (zipfile.BadZipFile, zlib.error, EOFError, OSError):
                rows, status = [], "bad_zip"
            except (RuntimeError, NotImplementedError):
                rows, status = [], "unreadable"  # encrypted, or packed in a way that zipfile does not know
            yield pd.DataFrame([(user, repo, None, None, None, status)] + [(user, repo, *r, None) for r in rows], columns=columns)


def scan_archives(spark: SparkSession, repo_root: str) -> tuple[DataFrame, DataFrame]:
    """(files, status). Bad archives are reported in ``status`` and
    contribute no files (the source would silently reuse the previous tree)."""
    raw = spark.read.format("binaryFile").load(repo_root.rstrip("/") + "/*/*/repo.zip")
    rows = raw.select("path", "content").mapInPandas(_unzip, schema=ARCHIVE_SCHEMA)
    status = rows.where(F.col("status").isNotNull()).select("user", "repo", "status")
    files = _finish(rows.where(F.col("status").isNull()).drop("status")
                    .withColumn("repo", F.concat_ws("/", "user", "repo")))
    return files, status


# ---------------------------------------------------------------- writers (tree / archives)

_BINARY_PLACEHOLDER = bytes(range(256))


def _fs_and_path(uri: str):
    import pyarrow.fs as pafs
    return pafs.FileSystem.from_uri(uri)


def _write_files(batches, root: str):
    fs, base = _fs_and_path(root)
    for b in batches:
        for repo, path_str, content in zip(b["repo"], b["path_str"], b["content"]):
            target = f"{base}/{repo}/{path_str}"
            fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
            data = _BINARY_PLACEHOLDER if content is None else content.encode("utf-8")
            with fs.open_output_stream(target) as out:
                out.write(data)
        yield pd.DataFrame({"n": [len(b)]})


def write_file_tree(files: DataFrame, root: str) -> int:
    """Write (repo, path_str, content) rows as real files ``root/<repo>/<path>``
    from the executors (pyarrow file systems: local, HDFS, object stores).
    Deterministic paths make a retried task overwrite its own files. Rows with
    NULL content (excluded binaries) get a binary placeholder."""
    out = files.select("repo", "path_str", "content").mapInPandas(
        lambda it: _write_files(it, root), schema="n long")
    return int(out.agg(F.sum("n")).first()[0] or 0)


def _zip_repo(key, pdf: pd.DataFrame, root: str) -> pd.DataFrame:
    fs, base = _fs_and_path(root)
    user, repo = key
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for path_str, content in zip(pdf["path_str"], pdf["content"]):
            z.writestr("repo/" + path_str, _BINARY_PLACEHOLDER if content is None else content.encode("utf-8"))
    target = f"{base}/{user}/{repo}/repo.zip"
    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(target) as out:
        out.write(buf.getvalue())
    return pd.DataFrame({"user": [user], "repo": [repo], "n_files": [len(pdf)]})


def write_archives(files: DataFrame, root: str) -> int:
    """One ``<user>/<repo>/repo.zip`` per repository, built inside the task
    that holds the repository's rows (groups bounded by the repository gate)."""
    out = files.select("user", "repo", "path_str", "content").groupBy("user", "repo").applyInPandas(
        lambda k, p: _zip_repo(k, p, root), schema="user string, repo string, n_files long")
    return int(out.agg(F.sum("n_files")).first()[0] or 0)
