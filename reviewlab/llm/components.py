"""Connected components of a graph that is held in a DataFrame.

Each round every node takes the neighbour (or itself) with the smallest hash
as its parent, and the edges are rewritten to parents; loops and repeated
edges go. The hash order keeps sorted paths from shrinking by one node a
round, and a star is gone after two rounds. Nodes with very many edges are
pre-aggregated (minimum) or met in joins whose other side has one row per
node, which Spark splits when skewed. Nothing is brought to the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlab.llm.common import is_empty, saved


def _normal(edges: DataFrame) -> DataFrame:
    return (edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            .distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long); two nodes
    have the same root exactly when a path joins them. Edges with a null end
    are ignored; a node with only loops is left out. No edges: no rows."""
    e = saved(_normal(edges.select(F.col("u").cast("long"), F.col("v").cast("long"))), "edges")
    maps = []
    while not is_empty(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = (both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("m")))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v"))
        m = saved(least.select(F.col("u").alias("node"), F.least("m", own)["v"].alias("parent")), "parents")
        maps.append(m)
        a = m.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        b = m.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        e = saved(_normal(e.join(a, "u").join(b, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v"))), "edges")
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def up(low: DataFrame, high: DataFrame) -> DataFrame:
        h = high.select(F.col("node").alias("root"), "parent")
        return low.join(h, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))

    first = maps[0].select("node", F.col("parent").alias("root"))
    return saved(reduce(up, maps[1:], first), "components")
