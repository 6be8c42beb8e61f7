"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored, unplaced


def _flatten(parents: DataFrame) -> DataFrame:
    """(u, p) with every p a root: pointer jumping, which halves the depth of the trees each time."""
    while True:
        up = parents.select(unplaced(F.col("u")).alias("x"), F.col("p").alias("pp"))
        joined = stored(parents.join(up, F.col("p") == F.col("x")).select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
        parents = joined.select("u", "p")
        if joined.where("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """(u, root) for every vertex of the links (u, v), root being one vertex of each component.

    Each round hooks every vertex to its least neighbour, flattens the trees and contracts them; at least half of the
    vertices that still have links go, so rounds grow with the logarithm. Nothing but emptiness reaches the driver.
    """
    edges = stored(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    total = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = _flatten(stored(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))))
        if total is None:
            total = parents.select("u", F.col("p").alias("root"))
        else:
            moved = parents.select(unplaced(F.col("u")).alias("x"), "p")
            total = stored(total.join(moved, F.col("root") == F.col("x"), "left").select("u", F.coalesce("p", "root").alias("root")))
        a = parents.select(unplaced(F.col("u")).alias("a"), F.col("p").alias("pa"))
        b = parents.select(unplaced(F.col("u")).alias("b"), F.col("p").alias("pb"))
        ends = edges.join(a, F.col("u") == F.col("a")).select("v", "pa").join(b, F.col("v") == F.col("b")).where("pa <> pb")
        edges = stored(ends.select(F.least("pa", "pb").alias("u"), F.greatest("pa", "pb").alias("v")).distinct())
    return total if total is not None else edges.select("u", F.col("v").alias("root"))
