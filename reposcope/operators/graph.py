"""Import-graph operators.

Nodes are module keys ('/'-joined module path) within a repository; every
operator is keyed by repo_id, so all graph work co-partitions on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposcope.operators.split import global_rank
from reposcope.session import cut_lineage, merged, stored


def keyed_edges(edges: DataFrame) -> DataFrame:
    """(repo_id, importer, importee arrays) -> (repo_id, src, dst, src_depth, dst_depth)."""
    return edges.select("repo_id",
                        F.array_join("importer", "/").alias("src"),
                        F.array_join("importee", "/").alias("dst"),
                        F.size("importer").alias("src_depth"),
                        F.size("importee").alias("dst_depth")).distinct()


def prune_two_way(edges: DataFrame) -> DataFrame:
    """G1: for a pair of opposite edges keep only the one whose importer is not
    deeper than its importee (equal depth keeps both; self-loops stay)."""
    rev = edges.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"),
                       F.lit(True).alias("has_rev"))
    j = edges.join(merged(rev), ["repo_id", "src", "dst"], "left")
    keep = F.col("has_rev").isNull() | (F.col("src_depth") <= F.col("dst_depth"))
    return j.where(keep).select("repo_id", "src", "dst", "src_depth", "dst_depth")


def graph_nodes(edges: DataFrame) -> DataFrame:
    """nodes = endpoints of the (pruned) edges."""
    return (edges.select("repo_id", F.col("src").alias("node"))
            .unionByName(edges.select("repo_id", F.col("dst").alias("node"))).distinct())


def graph_degree(edges: DataFrame) -> DataFrame:
    """In-degree (importers) and out-degree (importees) per node."""
    nodes = graph_nodes(edges)
    out_d = edges.groupBy("repo_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("num_importees"))
    in_d = edges.groupBy("repo_id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("num_importers"))
    return (nodes.join(merged(in_d), ["repo_id", "node"], "left").join(merged(out_d), ["repo_id", "node"], "left")
            .select("repo_id", "node",
                    F.coalesce("num_importers", F.lit(0)).cast("bigint").alias("num_importers"),
                    F.coalesce("num_importees", F.lit(0)).cast("bigint").alias("num_importees")))


def numbered_nodes(edges: DataFrame) -> DataFrame:
    """(repo_id, node, id): the nodes of a repository have consecutive numbers."""
    nodes = graph_nodes(edges).withColumn("_k", F.struct("repo_id", "node"))
    return global_rank(nodes, "_k", "id").drop("_k")


def last_growth(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, last): the last round in which the set of sources that reach a node grew.

    edges: (v, w) node numbers. A set is kept as one row per 64 consecutive
    numbers that hold a source, a long with a bit each; a round sends the bits
    that a row gained along the edges, ORs them per target and keeps what is
    new. One table (v, chunk, bits, fresh, last) is written per round.
    """
    bit = F.expr("shiftleft(1L, CAST(id % 64 AS INT))")
    state = stored(ids.select(F.col("id").alias("v"), F.floor(F.col("id") / 64).alias("chunk"), bit.alias("bits"),
                              bit.alias("fresh"), F.lit(0).alias("last")), "reach")
    none, round_ = F.lit(0).cast("long"), 0
    while True:  # ends: bits are only ever added
        round_ += 1
        sent = (state.where("fresh <> 0").join(merged(edges), "v")
                .select(F.col("w").alias("v"), "chunk", none.alias("bits"), F.col("fresh").alias("sent"), F.lit(0).alias("last")))
        kept = state.select("v", "chunk", "bits", none.alias("sent"), "last")
        held = kept.unionByName(sent).groupBy("v", "chunk").agg(
            F.bit_or("bits").alias("bits"), F.bit_or("sent").alias("sent"), F.max("last").alias("last"))
        gained = F.col("sent").bitwiseAND(F.bitwise_not("bits"))
        state = stored(held.select("v", "chunk", F.col("bits").bitwiseOR(F.col("sent")).alias("bits"), gained.alias("fresh"),
                                     F.when(gained != 0, F.lit(round_)).otherwise(F.col("last")).alias("last")), "reach")
        if state.where("fresh <> 0").isEmpty():
            return state.groupBy(F.col("v").alias("id")).agg(F.max("last").alias("last"))


def node_ranks(edges: DataFrame) -> DataFrame:
    """rank = max over all sources of the shortest-path length to the
    node (unreachable counts as 0), then gaps closed (dense rank from 0). A
    source at distance d joins a node's set in round d, so the largest distance
    is the last round with growth."""
    ids = numbered_nodes(edges)
    by = lambda end, as_: merged(ids.select("repo_id", F.col("node").alias(end), F.col("id").alias(as_)))
    hops = stored(edges.select("repo_id", "src", "dst").join(by("src", "v"), ["repo_id", "src"])
                  .join(by("dst", "w"), ["repo_id", "dst"]).select("v", "w"), "hops")
    raw = ids.join(merged(last_growth(hops, ids)), "id").select("repo_id", "node", F.col("last").alias("raw_rank"))
    # gaps are closed on the distinct ranks of a repository, a few rows whatever its size
    w = Window.partitionBy("repo_id").orderBy("raw_rank")
    dense = raw.select("repo_id", "raw_rank").distinct().withColumn("rank", (F.row_number().over(w) - 1).cast("bigint"))
    return raw.join(merged(dense), ["repo_id", "raw_rank"]).select("repo_id", "node", "rank")


def import_features(edges: DataFrame) -> DataFrame:
    """Rank, importers, importees, max rank and the two votes per node.
    The edge table is materialised once and shared by the ranks and the degrees."""
    edges = cut_lineage(edges)
    ranks = cut_lineage(node_ranks(edges))
    top = ranks.groupBy("repo_id").agg(F.max("rank").alias("max_rank"))
    f = ranks.join(merged(graph_degree(edges)), ["repo_id", "node"]).join(merged(top), "repo_id")
    return f.select(
        "repo_id", "node", "rank", "num_importers", "num_importees",
        (F.col("rank") == F.col("max_rank")).alias("bottom_rank"),
        F.when(F.col("rank") == 0, F.lit(1)).otherwise(F.lit(-1)).cast("int").alias("vote_top_rank"),
        F.when(F.col("rank") == F.col("max_rank"), F.lit(0)).otherwise(F.lit(-1)).cast("int").alias("vote_bottom_rank"))
