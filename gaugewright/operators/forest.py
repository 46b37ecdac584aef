"""Rivers as a forest: every node flows to one other at most. Paths by pointer jumping, reach by intervals.

A node's pointer doubles its reach in every round, so a river of d edges takes about log2(d) rounds,
each a join of as many rows as there are nodes. From the depths and subtree sizes comes a numbering
in which a node's upstream is an interval: "does a lead to b", the length between, and how much lies
upstream need no table of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewright.operators import pieces
from gaugewright.session import checkpointed, stored

#: Parts in which the branches that meet at one node are numbered.
BRANCH_PARTS = 64


class NotAForest(ValueError):
    """A node flows to several others, or a cycle has no end."""


def _further(state: DataFrame, k: int, sums: list[str]) -> DataFrame:
    """Every pointer that spans 2**k edges goes on by that of the node where it ends; the sums along the way add up."""
    ahead = state.select(F.col("node").alias("_node"), *[F.col(c).alias(f"_{c}") for c in ("top", "hops", *sums)])
    met = state.join(ahead, (F.col("top") == F.col("_node")) & (F.col("hops") == 1 << k), "left")
    rest = [c for c in state.columns if c not in ("node", "top", "hops", *sums)]
    return met.select("node", F.coalesce("_top", "top").alias("top"), *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in ("hops", *sums)], *rest)


def _rounds(state: Callable[[], DataFrame], limit: int) -> Iterator[int]:
    """Counts rounds for as long as ``state()`` has pointers of full span."""
    k = 0
    while not state().where(F.col("hops") == 1 << k).isEmpty():
        if k > limit:  # no path has more edges than there are nodes
            raise NotAForest("a cycle")
        yield k
        k += 1


def forest_index(edges: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Every node with parent, root, depth, length (to its root), entry, size and weight. (GR-08, GR-11)

    ``edges``: src, dst, length (null counts as 0); each src once. ``weights`` (node, weight) are what
    is counted upstream, such as stations; 1 for each node without it. A node's own upstream, itself
    included, has ``size`` nodes of ``weight`` in all, and these are the nodes of its root whose entry
    lies in [entry, entry + size). A node that flows to several others, or a cycle, is NotAForest.
    """
    down = checkpointed(edges.select(F.col("src").alias("node"), F.col("dst").alias("parent"), F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("step")).where("node is not null and parent is not null"))
    if not down.groupBy("node").count().where("count > 1").isEmpty() or not down.where("node = parent").isEmpty():
        raise NotAForest("a node flows to several others or to itself")
    ends = down.select(F.col("parent").alias("node")).distinct().join(down, "node", "left_anti").select("node", F.lit(None).cast(dict(down.dtypes)["parent"]).alias("parent"), F.lit(0.0).alias("step"))
    tree = checkpointed(down.unionByName(ends))
    # pointers and, with the same jumps, subtree sums: what lies less than 2**k above a node, doubled by that of the nodes 2**k above
    mass = F.lit(1.0) if weights is None else F.coalesce("weight", F.lit(0.0))
    start = tree if weights is None else tree.join(weights.groupBy("node").agg(F.sum("weight").cast("double").alias("weight")), "node", "left")
    state = stored(start.select("node", F.coalesce("parent", "node").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("step").alias("length"), F.lit(1).cast("long").alias("size"), mass.alias("weight")))
    limit = tree.count().bit_length()
    for k in _rounds(lambda: state, limit):
        above = state.where(F.col("hops") == 1 << k).groupBy(F.col("top").alias("node")).agg(F.sum("size").alias("_size"), F.sum("weight").alias("_weight"))
        moved = _further(state, k, ["length"]).join(above, "node", "left")
        grown = [(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0).cast(t))).alias(c) for c, t in (("size", "long"), ("weight", "double"))]
        state = stored(moved.select("node", "top", "hops", "length", *grown), state)
    index = checkpointed(state.join(tree.select("node", "parent"), "node").select("node", "parent", F.col("top").alias("root"), F.col("hops").alias("depth"), "length", "size", "weight"))
    # entries: a node comes after its parent and after all branches that meet there before its own
    branches = index.where("parent is not null").select("node", "parent", "size").withColumn("_piece", F.pmod(F.xxhash64("node"), F.lit(BRANCH_PARTS)).cast("long"))
    told = pieces.handed_on(branches, ["parent"], {"_sum": F.sum("size")}, {"_before": lambda w: F.sum("_sum").over(pieces.before(w))})
    earlier = F.sum("size").over(pieces.within(["parent"], "node")) - F.col("size") + F.coalesce("_before", F.lit(0))
    steps = told.select("node", F.col("parent").alias("top"), F.lit(1).cast("long").alias("hops"), (1 + earlier).cast("long").alias("entry"))
    roots = index.where("parent is null").select("node", F.col("node").alias("top"), F.lit(0).cast("long").alias("hops"), F.lit(0).cast("long").alias("entry"))
    entries = stored(steps.unionByName(roots))
    for k in _rounds(lambda: entries, limit):
        entries = stored(_further(entries, k, ["entry"]), entries)
    return checkpointed(index.join(entries.select("node", "entry"), "node"))


def holds(below: str, above: str) -> Column:
    """Whether the node of columns ``above``_* flows to (or is) that of columns ``below``_*, by their intervals."""
    b, a = (lambda c: F.col(f"{below}_{c}")), (lambda c: F.col(f"{above}_{c}"))
    return (a("root") == b("root")) & (a("entry") >= b("entry")) & (a("entry") < b("entry") + b("size"))


def _beside(pairs: DataFrame, index: DataFrame, column: str) -> DataFrame:
    told = index.select(F.col("node").alias(column), *[F.col(c).alias(f"{column}_{c}") for c in ("root", "entry", "size", "length", "depth")])
    return pairs.join(told, column, "left")


def leads_to(pairs: DataFrame, index: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with ``leads`` (a's water comes to b; a node doesn't lead to itself), and then the length and edges between. (GR-12)

    A node that the index lacks leads nowhere.
    """
    both = _beside(_beside(pairs, index, a), index, b)
    leads = F.coalesce(holds(b, a) & (F.col(a) != F.col(b)), F.lit(False))
    between = lambda c: F.when(F.col("leads"), F.col(f"{a}_{c}") - F.col(f"{b}_{c}"))
    return both.withColumn("leads", leads).select(*pairs.columns, "leads", between("length").alias("length"), between("depth").alias("hops"))


def upstream_counts(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """How many stations lie upstream of each station that has one: down, n_up. (GR-11)

    ``stations``: station and its node. Other stations at a station's own node are not upstream of it.
    """
    here = stations.groupBy("node").agg(F.count_distinct("station").cast("double").alias("weight"))
    index = forest_index(edges, here)
    own = index.join(here.withColumnRenamed("weight", "_own"), "node").select("node", (F.col("weight") - F.col("_own")).cast("long").alias("n_up")).where("n_up > 0")
    return stations.select(F.col("station").alias("down"), "node").distinct().join(own, "node").select("down", "n_up")


def upstream_of(index: DataFrame, node: str) -> DataFrame:
    """All that flows to a node, the nearest first: node, length and hops. (GR-09)"""
    at = F.broadcast(index.where(F.col("node") == node).select(*[F.col(c).alias(f"b_{c}") for c in ("root", "entry", "size", "length", "depth")]))  # one row
    seen = index.select("node", *[F.col(c).alias(f"a_{c}") for c in ("root", "entry", "size", "length", "depth")]).join(at, holds("b", "a")).where(F.col("node") != node)
    return seen.select("node", (F.col("a_length") - F.col("b_length")).alias("length"), (F.col("a_depth") - F.col("b_depth")).alias("hops")).orderBy("length", "node")


def downstream_of(index: DataFrame, node: str) -> DataFrame:
    """Where a node's water goes, the nearest first: node, length and hops. (GR-09)"""
    at = F.broadcast(index.where(F.col("node") == node).select(*[F.col(c).alias(f"a_{c}") for c in ("root", "entry", "size", "length", "depth")]))  # one row
    seen = index.select("node", *[F.col(c).alias(f"b_{c}") for c in ("root", "entry", "size", "length", "depth")]).join(at, holds("b", "a")).where(F.col("node") != node)
    return seen.select("node", (F.col("a_length") - F.col("b_length")).alias("length"), (F.col("a_depth") - F.col("b_depth")).alias("hops")).orderBy("length", "node")
