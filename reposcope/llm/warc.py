"""Deterministic sharded WARC writer and its reader.

Records are cut into contiguous ranges of their id by bounds that depend on the rows alone, sorted
within each range, and written by one task per range into files that roll at a compressed size.
Every header and digest is made anew from the payload. A file is written under a temporary name and
renamed when complete, and a manifest, which Spark commits in one step, lists the files that count:
a task that is lost or runs twice leaves at most files that no manifest names, or the same bytes
again. The reader opens only files of the manifest and checks sizes and digests.

Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the largest id carries
the payload, the others are revisit records that name it.

Cases: a null payload is empty; a null url is written as ``urn:page:<id>``; rows that share the
largest id of a payload are all responses; a null id sorts last, is never referred to, and is read
back as null; an empty table gives an empty manifest and no file. Other columns are not written.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposcope.llm.common import shard_bounds, shard_of, shared_folder, table

REVISIT_BYTES = 1000
SHARD_BYTES = 16 << 20
ROLL_BYTES = 2 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, records long, bytes long, sha1 string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


# ---- records -----------------------------------------------------------------------------
def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass")


def _line(value: str) -> str:
    """A header value on one line; what could break it is escaped."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _unline(value: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def name_of(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def id_of(name: str) -> int | None:
    value = name.split(":")[2]
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, compressed as a gzip member of its own without a time stamp."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = f"urn:page:{'none' if page_id is None else page_id}" if url is None else _line(url)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name_of(page_id, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name_of(refers_to, digest))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(_head(fields) + block + b"\r\n\r\n") + squeeze.flush()


def info_record(file: str) -> bytes:
    """The record that opens a file; its name does not depend on the run."""
    block = b"format: WARC File Format 1.1\r\n"
    fields = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{file}>"), ("WARC-Date", DATE), ("WARC-Filename", file),
        ("Content-Type", "application/warc-fields"), ("Content-Length", len(block)),
    ]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(_head(fields) + block + b"\r\n\r\n") + squeeze.flush()


def members(stream: io.RawIOBase, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    rest = b""
    while True:
        rest = rest or stream.read(step)
        if not rest:
            return
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof:
            out.append(unzip.decompress(rest))
            rest = unzip.unused_data
            if not unzip.eof:
                rest = stream.read(step)
                if not rest:
                    raise ValueError("the file ends within a record")
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: its length is not what its header says")
    return fields, body[:size]


# ---- writing -----------------------------------------------------------------------------
class _Roller:
    """Files of one shard; each is written under a temporary name and renamed when full."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, roll: int):
        self.fs, self.folder, self.shard, self.roll = fs, folder, shard, roll
        self.number, self.out = 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary-{self.name}-{uuid.uuid4().hex}"
            self.out, self.sha, self.bytes, self.records = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha1(), 0, 0
            self._put(info_record(self.name))
        self._put(data)
        self.records += 1
        if self.bytes >= self.roll:
            yield self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        self.out, self.number = None, self.number + 1
        return self.name, self.shard, self.records, self.bytes, self.sha.hexdigest()


def _writing(folder: str, roll: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        roller, done, refers = None, [], {}
        at = object()
        for batch in batches:
            for shard, page_id, refers_to, digest, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if roller is None or roller.shard != shard:
                    if roller and roller.out:
                        done.append(roller.close())
                    roller = _Roller(fs, path, shard, roll)
                if page_id != at:
                    at, refers = page_id, {}
                if digest is not None:  # a note that comes before the pages of this id
                    refers[digest] = refers_to
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                to = refers.get(hashlib.sha1(payload).hexdigest()) if refers else None
                done += roller.add(record(page_id, url, payload, to))
        if roller and roller.out:
            done.append(roller.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "shard", "records", "bytes", "sha1"), x)) for x in done], schema=_MANIFEST_ARROW)

    return run


_MANIFEST_ARROW = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the records that revisit another."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    known = pages.select(F.col("page_id").cast("long"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).filter(
        F.col("page_id").isNotNull() & (F.col("size") >= REVISIT_BYTES)
    )
    # one row per payload that occurs twice; dealt evenly, so that the join below may split a payload with many pages
    last = known.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers_to").hint("rebalance")
    return known.join(last, "digest").filter(F.col("page_id") < F.col("refers_to")).select("page_id", "digest", "refers_to")


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes archives and ``manifest`` below ``folder`` (a URI that all tasks reach); returns the manifest."""
    spark = pages.sparkSession
    fs, path = pafs.FileSystem.from_uri(_uri(folder))
    fs.create_dir(path, recursive=True)
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(F.col("page_id").cast("long"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("digest"), url.cast("string").alias("url"), "html")
    rows = rows.withColumn("size", F.coalesce(F.octet_length("html"), F.lit(0)) + 500)
    # notes are counted as rows of no size, so they change no bound; equal ids share a range
    notes = revisits(pages).select("page_id", "refers_to", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.lit(0).alias("size"))
    bounds = shard_bounds(rows, "page_id", F.col("size"), shard_bytes)
    shards = rows.unionByName(notes).select(shard_of("page_id", bounds).alias("_shard"), "page_id", "refers_to", "digest", "url", "html")
    sorted_ = shards.repartitionById(len(bounds) + 1, F.col("_shard")).sortWithinPartitions("_shard", F.col("page_id").asc_nulls_last(), F.col("digest").asc_nulls_last(), "url", "html")
    sorted_.mapInArrow(_writing(_uri(folder), roll_bytes), MANIFEST).write.json(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def _uri(folder: str) -> str:
    return folder if re.match(r"[a-z0-9]+:/", folder) else f"file://{folder}"


# ---- reading -----------------------------------------------------------------------------
def _reading(folder: str, with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    fields_out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def rows(fs: pafs.FileSystem, path: str, file: str, records: int) -> Iterator[dict]:
        seen = 0
        with fs.open_input_stream(f"{path}/{file}", compression=None) as stream:
            for raw in members(stream):
                fields, block = parse(raw)
                if fields["WARC-Type"] == "warcinfo":
                    continue
                seen += 1
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                response = fields["WARC-Type"] == "response"
                if hashlib.sha1(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha1:") or response and (
                    len(payload) != size or hashlib.sha1(payload).hexdigest() != digest
                ):
                    raise ValueError(f"{file}: {fields['WARC-Record-ID']} does not match its digest")
                page_id, target = id_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"]
                yield {
                    "page_id": page_id, "url": None if target == f"urn:page:{'none' if page_id is None else page_id}" else _unline(target),
                    "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
                    "refers_to": None if response else id_of(fields["WARC-Refers-To"]), "payload": payload if response and with_payload else None,
                }
        if seen != records:
            raise ValueError(f"{file}: {seen} records, the manifest says {records}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                some, size = [], 0
                for row in rows(fs, path, file, records):
                    some.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(some, schema=fields_out)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema=fields_out)

    return run


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the files of the manifest, checked against their digests."""
    files = manifest(spark, folder).select("file", "records")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n).mapInArrow(_reading(_uri(folder), with_payload), READ)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
     g as (select payload_digest, max(page_id) as last from p where payload_bytes >= {REVISIT_BYTES} group by 1)
select page_id, payload_bytes, payload_digest, case when page_id < last then 'revisit' else 'response' end as record_type,
       case when page_id < last then last end as refers_to
from p left join g using (payload_digest)
"""
