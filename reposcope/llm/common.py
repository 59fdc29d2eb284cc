"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: words are runs of anything but these six ASCII separators
SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Without that setting it lies below the checkpoint folder of the session, if one is set, or, for
    a local master alone, below the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_slices(batches: Iterable[pa.RecordBatch], at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose column ``at`` holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(at)
        if not len(column):
            continue
        wide = column.cast(pa.large_string())
        ends = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, 8 * wide.offset)
        part = (ends[1:] - ends[0] - 1).clip(0) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(wide)]):
            yield batch.slice(int(lo), int(hi - lo))


def pack_sorted(x: np.ndarray, width: int = 8) -> bytes:
    """Ascending values of ``width`` bytes whose lowest bits are much alike, in about two bytes less each.

    The steps of the upper sixteen bits and the lowest byte compress well, the bytes between them are
    noise and stay as they are.
    """
    top = np.diff((x >> np.uint64(8 * width - 16)).astype(np.uint16), prepend=np.uint16(0))
    cells = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    ends = zlib.compress(top.astype("<u2").tobytes() + cells[:, 0].tobytes(), 1)
    return len(ends).to_bytes(4, "little") + ends + cells[:, 1 : width - 2].tobytes()


def unpack_sorted(blob: bytes, width: int = 8) -> np.ndarray:
    size = int.from_bytes(blob[:4], "little")
    ends, middle = zlib.decompress(blob[4 : 4 + size]), np.frombuffer(blob, np.uint8, offset=4 + size).reshape(-1, width - 3)
    n = len(middle)
    cells = np.zeros((n, 8), dtype=np.uint8)
    cells[:, 0] = np.frombuffer(ends, np.uint8, offset=2 * n)
    cells[:, 1 : width - 2] = middle
    top = np.cumsum(np.frombuffer(ends, "<u2", n), dtype=np.uint64) & np.uint64(0xFFFF)
    return cells.reshape(-1).view("<u8").astype(np.uint64) | top << np.uint64(8 * width - 16)


def crc_mod(key: Column, m: int) -> Column:
    """crc32 of the id's decimal text modulo ``m``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "utf-8")), F.lit(m))


def shard_bounds(df: DataFrame, key: str, size: Column, target: int, samples: int = 16) -> list[int]:
    """Bounds of contiguous ranges of ``key`` that hold about ``target`` of ``size`` each.

    They come from rows picked by a hash of the key with a chance in proportion to their size, so
    they are the same in each run over the same rows, whatever the partitions. The driver holds
    about ``samples`` keys per range.
    """
    k = _key(key)
    weight = size.cast("double") * (float(samples) / float(target))
    unit = F.shiftrightunsigned(F.xxhash64(k, F.lit(7)), 11).cast("double") / float(1 << 53)
    picked = (
        df.select(k.alias("k"), weight.alias("w"), unit.alias("u"))
        .filter(F.col("u") < F.col("w"))
        .select("k", F.greatest(F.lit(1.0), "w").alias("w"))
        .orderBy("k")
        .toPandas()
    )
    return picked_bounds(picked["k"].to_numpy(), picked["w"].to_numpy(), samples)


def shard_of(key: str, bounds: list[int]) -> Column:
    """The number of bounds that are not above the key. Equal keys share a range; null keys come last."""
    return _search(_key(key), bounds, 0, len(bounds)) if bounds else F.lit(0)


def _key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(int(np.iinfo(np.int64).max)))


def picked_bounds(keys: np.ndarray, weights: np.ndarray, samples: int) -> list[int]:
    """Keys at which the running weight passes a multiple of ``samples``."""
    if not len(keys):
        return []
    step = np.floor(np.cumsum(weights) / samples).astype(np.int64)
    starts = np.flatnonzero(np.diff(step, prepend=0) > 0)
    return sorted({int(keys[i]) for i in starts} - {int(keys[0])})


def _search(k: Column, bounds: list[int], lo: int, hi: int) -> Column:
    """A decision tree of comparisons: log2(bounds) of them per row, all in generated code."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(k < F.lit(bounds[mid]), _search(k, bounds, lo, mid)).otherwise(_search(k, bounds, mid + 1, hi))
