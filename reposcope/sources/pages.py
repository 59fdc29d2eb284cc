"""HTML pages as files (S9): a Data Source API writer, one file per row.

``df.write.format("html_pages").mode(...).save(folder)`` takes rows with
``file_name`` and ``html`` (and any key columns). Each task writes its files
and one mapping ``mapping-<partition>.jsonl`` of the other columns to file
names. Names depend on the rows alone, so a retried or repeated task writes
the same files again; ``_SUCCESS`` with the totals comes last, on commit. The
driver gets two numbers per task. Any file system that pyarrow knows will do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "html_pages"


@dataclass
class Written(WriterCommitMessage):
    n_files: int
    n_bytes: int


class HtmlPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _PageWriter(self.options["path"], overwrite)


class _PageWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        from reposcope.sources.scan import _fs_and_path

        self.path = path
        fs, base = _fs_and_path(path)
        if not overwrite and fs.get_file_info(f"{base}/_SUCCESS").is_file:
            raise ValueError(f"{path} holds pages already")
        fs.create_dir(base, recursive=True)
        if fs.get_file_info(f"{base}/_SUCCESS").is_file:  # an interrupted overwrite is no finished folder
            fs.delete_file(f"{base}/_SUCCESS")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext
        from reposcope.sources.scan import _fs_and_path

        fs, base = _fs_and_path(self.path)
        done, mapping = Written(0, 0), []
        for row in iterator:
            page = (row["html"] or "").encode("utf-8")
            name = row["file_name"]
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"no name of a page: {name!r}")
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(page)
            mapping.append(json.dumps({k: v for k, v in row.asDict().items() if k != "html"}, ensure_ascii=False, default=str))
            done.n_files += 1
            done.n_bytes += len(page)
        if mapping:
            with fs.open_output_stream(f"{base}/mapping-{TaskContext.get().partitionId():06d}.jsonl") as out:
                out.write(("\n".join(mapping) + "\n").encode("utf-8"))
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from reposcope.sources.scan import _fs_and_path

        fs, base = _fs_and_path(self.path)
        told = [m for m in messages if m is not None]
        with fs.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(json.dumps({"n_files": sum(m.n_files for m in told), "n_bytes": sum(m.n_bytes for m in told)}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of the tasks that ended stay; without ``_SUCCESS`` the folder is not finished."""


def write_pages(docs: DataFrame, path: str, mode: str = "append") -> None:
    """One file per row; a finished folder is only written over with mode ``overwrite``."""
    docs.sparkSession.dataSource.register(HtmlPages)
    docs.write.format(FORMAT).mode(mode).save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, html) of the pages of a folder."""
    pages = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.html").load(path)
    return pages.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)$", 1).alias("file_name"), F.col("value").alias("html"))
