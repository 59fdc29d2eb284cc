import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reposcope.llm import common as c


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=50))
def test_packing(values):
    x = np.array(sorted(values), dtype=np.uint64)
    assert (c.unpack_sorted(c.pack_sorted(x)) == x).all() and len(c.unpack_sorted(c.pack_sorted(x))) == len(x)
    y = x >> np.uint64(8)
    assert (c.unpack_sorted(c.pack_sorted(y, 7), 7) == y).all()


def test_packed_size():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 12_000, dtype=np.uint64) * np.uint64(2) & ~np.uint64(31))
    assert len(c.pack_sorted(x)) < 6.3 * len(x)


def test_bounds_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 3).alias("k"), (F.col("id") % 50).alias("w"))
    bounds = [c.shard_bounds(x, "k", F.col("w"), 5000) for x in (df, df.repartition(7), df.orderBy(F.desc("k")))]
    assert bounds[0] == bounds[1] == bounds[2] and 10 < len(bounds[0]) < 50
    got = df.withColumn("s", c.shard_of("k", bounds[0])).groupBy("s").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.sum("w").alias("w")).orderBy("s").collect()
    assert all(x.b < y.a for x, y in zip(got, got[1:])) and max(r.w for r in got) < 20_000
    assert c.shard_bounds(df.limit(0), "k", F.col("w"), 5000) == []
    null = spark.createDataFrame([(None,)], "k long").select(c.shard_of("k", bounds[0]).alias("s")).first()
    assert null.s == len(bounds[0])


def test_text_slices_keep_rows_and_bound_bytes():
    texts = ["a" * 5, None, "", "é" * 40, "b" * 9, None, "c" * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    for source in (batch, batch.slice(2, 5), batch.slice(0, 0)):
        parts = list(c.text_slices([source], 1, 10))
        assert sum((p.column(1).to_pylist() for p in parts), []) == source.column(1).to_pylist()
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()[1:]) <= 10 for p in parts)
