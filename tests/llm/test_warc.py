import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from reposcope.llm import warc


def test_record_round_trip():
    for page_id, url, payload, to in ((1, "http://a/b c\r\n%", b"x" * 5, None), (None, None, b"", None), (-3, "", "é\r\n\r\n".encode(), 9)):
        (raw,) = warc.members(__import__("io").BytesIO(warc.record(page_id, url, payload, to)), 7)
        fields, block = warc.parse(raw)
        assert warc.id_of(fields["WARC-Record-ID"]) == page_id
        assert block.endswith(b"\r\n\r\n" if to else payload)
        assert warc.record(page_id, url, payload, to) == warc.record(page_id, url, payload, to)


def test_cases_round_trip(spark, tmp_path):
    long, other = "é" * 600, "z" * 1000
    rows = [(1, "u1", long, "q"), (5, "u5", long, "q"), (5, "u5", long, "q"), (3, None, other, "q"), (None, "un", other, "q"), (4, "u4", None, "q"),
            (6, "u6", "short", "q"), (7, "u7", "short", "q"), (2, "u2", long, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = f"file://{tmp_path}/w"
    listed = warc.write(pages, folder, shard_bytes=900, roll_bytes=200).collect()
    assert sum(r.records for r in listed) == len(rows) and len(listed) > 3
    got = sorted(((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to, r.payload) for r in warc.read(spark, folder).collect()), key=str)
    want = [(1, "u1", 1200, "revisit", 5, None), (2, "u2", 1200, "revisit", 5, None), (3, None, 1000, "response", None, other.encode()),
            (4, "u4", 0, "response", None, b""), (5, "u5", 1200, "response", None, long.encode()), (5, "u5", 1200, "response", None, long.encode()),
            (6, "u6", 5, "response", None, b"short"), (7, "u7", 5, "response", None, b"short"), (None, "un", 1000, "response", None, other.encode())]
    assert got == sorted(want, key=str)
    assert warc.write(pages.limit(0), f"{folder}0").count() == 0
    assert warc.read(spark, f"{folder}0").count() == 0


def test_same_files_whatever_the_partitions(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    lists = []
    for i, n in enumerate((1, 7)):
        listed = warc.write(pages.repartition(n), f"file://{tmp_path}/{i}", shard_bytes=20_000, roll_bytes=3_000).collect()
        lists.append(sorted((r.file, r.records, r.bytes, r.sha1) for r in listed))
    assert lists[0] == lists[1] and len(lists[0]) > 5
    names = [f.base_name for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(f"{tmp_path}/0"))]
    assert not any(n.startswith("_temporary") for n in names)


def test_damage_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string")
    folder = f"{tmp_path}/w"
    (one,) = warc.write(pages, folder).collect()
    bad = warc.record(1, "u", b"hellO", None)
    with open(f"{folder}/{one.file}", "ab") as f:
        f.write(bad)
    with pytest.raises(Exception, match="the manifest says 1"):
        warc.read(spark, folder).collect()
    assert warc.manifest(spark, folder).agg(F.sum("bytes")).first()[0] == one.bytes
