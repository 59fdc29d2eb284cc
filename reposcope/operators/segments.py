"""Running sums and order statistics without one task per group or buffer per value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposcope.session import merged, stored

#: cells of a bracket per pass, and values that are few enough to be fetched
CELLS, FETCH = 256, 4096


def running_before(df: DataFrame, key: str, order: str, value: str, out: str = "_before") -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of the same ``key``.

    Rows are range-sorted on (key, order), so that a large key lies in many
    partitions; each sums up its own rows, and a carry table of one row per
    partition and key adds what lies before. ``order`` tells the rows of a key
    apart. The sorted rows are stored, so that a retry cannot move the cuts;
    callers pass narrow rows.
    """
    ranged = stored(df.orderBy(key, order).withColumn("_pid", F.spark_partition_id()), "ranged")
    here = Window.partitionBy("_pid", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranged.groupBy("_pid", key).agg(F.sum(value).alias("_s")).withColumn("_carry", F.sum("_s").over(earlier)).drop("_s")
    zero = F.lit(0)
    return (ranged.withColumn("_here", F.sum(value).over(here)).join(merged(carry), ["_pid", key])
            .withColumn(out, F.coalesce("_here", zero) + F.coalesce("_carry", zero)).drop("_pid", "_here", "_carry"))


def medians(long: DataFrame, group: str = "metric", value: str = "v") -> dict[object, float]:
    """Exact median of each group's non-null values (the mean of the two middle ones).

    Groups are few, values any number. Each pass counts the cells of a bracket
    around a middle rank and narrows it to the cell that holds the rank, until
    the bracket is one value or holds at most ``FETCH``; those are fetched. The
    driver holds ``CELLS`` counts per rank, no task holds the values.
    """
    spark = long.sparkSession
    rows = long.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    found: dict[tuple, float] = {}
    open_: dict[tuple, tuple[float, float, int, int]] = {}  # (group, rank) -> bracket, rank in it, size
    for r in rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).collect():
        for rank in {(r["n"] - 1) // 2, r["n"] // 2}:
            open_[r["g"], rank] = r["lo"], r["hi"], rank, r["n"]
    ranks = {g: sorted(k for h, k in open_ if h == g) for g, _ in open_}
    while open_:
        found |= {k: lo for k, (lo, hi, _, _) in open_.items() if lo == hi}
        open_ = {k: b for k, b in open_.items() if k not in found}
        few = {k: b for k, b in open_.items() if b[3] <= FETCH}
        inside = lambda part: rows.join(F.broadcast(_brackets(spark, rows, part)), "g").where("v BETWEEN lo AND hi")
        if few:
            for r in inside(few).groupBy("g", "rank").agg(F.sort_array(F.collect_list("v")).alias("vs")).collect():
                found[r["g"], r["rank"]] = r["vs"][few[r["g"], r["rank"]][2]]
        open_ = {k: b for k, b in open_.items() if k not in few}
        if open_:
            # halves, so that the width of a bracket cannot overflow
            share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
            cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).alias("cell")
            cells = inside(open_).groupBy("g", "rank", cell).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            parts: dict[tuple, list] = {}
            for r in cells.orderBy("cell").collect():
                parts.setdefault((r["g"], r["rank"]), []).append(r)
            for k, cs in parts.items():
                rank = open_[k][2]
                for c in cs:
                    if rank < c["n"]:
                        open_[k] = c["lo"], c["hi"], rank, c["n"]
                        break
                    rank -= c["n"]
    return {g: sum(found[g, r] for r in rs) / len(rs) for g, rs in ranks.items()}


def _brackets(spark, rows: DataFrame, part: dict) -> DataFrame:
    """The open brackets, two per group at most, as a table."""
    kind = rows.schema["g"].dataType.simpleString()
    return spark.createDataFrame([(g, rank, lo, hi) for (g, rank), (lo, hi, _, _) in part.items()], f"g {kind}, rank long, lo double, hi double")
