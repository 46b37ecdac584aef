"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewright.session import checkpointed, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """One row (node, component) for each node of an edge; component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). A node's minimum comes
    from a partial aggregation and goes back to its edges by a join, so no neighbour list is ever
    collected and a node with very many edges is split like any skewed join. Edges never outnumber
    those given. Every round is written to the shared folder; the loop ends when a round changes nothing.

    Edges with a null end are dropped; self loops give a component of one node; an empty edge list
    gives no rows. Any orderable type can name the nodes.
    """
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    given = checkpointed(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = given.where("u = v").select(F.col("u").alias("node"))
    now = given.where("u <> v")
    before = _digest(now)
    for _ in range(max_rounds if before[0] else 0):
        now = stored(_small_star(_large_star(now)), now)
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    linked = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    linked = linked.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    alone = loops.join(linked, "node", "left_anti")
    return linked.unionByName(alone.select("node", F.col("node").alias("component")))


def _digest(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each larger neighbour of a node moves to the smallest of that node and its neighbours. Pairs may repeat."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).where("u <> v").distinct()
