"""Connected components of large edge tables: alternating large-star and small-star, and hook-and-jump union-find.

Edges are pairs of longs (u, v). Both return (id, component) for every id that has an edge, component being the smallest id reachable. No
neighbourhood is ever gathered: each step is a minimum per node and a join, so a node with a third of all edges is only a skewed join key.
Self-loops and repeated edges do no harm; an empty edge table gives an empty result.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import compact, kept


def _sides(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], int(row[1] or 0)


def star_components(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star until the edges stay as they are: then they are (node, smallest node of its component)."""
    edges = kept(compact(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), "edges")
    before = _state(edges)
    while before[0]:
        both = _sides(edges)
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        edges = kept(compact(small.where("u <> v").distinct()), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def union_find(edges: DataFrame) -> DataFrame:
    """Distributed union-find: every round hooks the root of each edge's one end below the smaller root of the other, then halves the paths.

    `parents` is the forest (id, component); an edge whose ends have one root is done and leaves the edge table.
    """
    edges = kept(compact(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), "edges")
    parents = kept(compact(_sides(edges).groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("component"))), "forest")
    while True:
        parents = _flattened(parents)
        edges = kept(compact(_relabelled(edges, parents)), "edges")
        if edges.isEmpty():
            return parents
        hooks = _sides(edges).groupBy(F.col("u").alias("root")).agg(F.min("v").alias("below")).where("below < root")
        parents = kept(compact(parents.join(hooks, F.col("component") == F.col("root"), "left")
                               .select("id", F.coalesce("below", "component").alias("component"))), "forest")


def _relabelled(edges: DataFrame, parents: DataFrame) -> DataFrame:
    left = parents.select(F.col("id").alias("u"), F.col("component").alias("ru"))
    right = parents.select(F.col("id").alias("v"), F.col("component").alias("rv"))
    return (edges.join(left, "u").join(right, "v").where("ru <> rv")
            .select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct())


def _flattened(parents: DataFrame) -> DataFrame:
    """Path halving until every node hangs on a root."""
    while True:
        up = parents.select(F.col("id").alias("component"), F.col("component").alias("grand"))
        jumped = kept(compact(parents.join(up, "component").select("id", F.col("grand").alias("component"), (F.col("grand") != F.col("component")).alias("moved"))), "forest")
        parents = jumped.select("id", "component")
        if jumped.where("moved").isEmpty():
            return parents
