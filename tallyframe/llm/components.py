"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b): root is the same for nodes that a path joins.

    Every round maps each node to the least node among itself and its neighbours and goes on with the links between
    different images, so links and nodes shrink until none is left. Rounds go through tables in the shared folder.
    """
    now = written(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    maps = []
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).select(F.col("a").alias("node"), "to")
        maps.append(written(least, "images"))
        of = lambda c: maps[-1].select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
        moved = now.join(of("a"), "a").join(of("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        now = written(moved.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = maps[0].select("node", F.col("to").alias("root"))
    for image in maps[1:]:
        step = image.select(F.col("node").alias("root"), "to")
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out
