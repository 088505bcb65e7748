"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysentry.llm.frames import checkpointed


def _mark(links: DataFrame):
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link every node's larger (or its not larger) neighbours to the node's least neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = near.join(least, "u").filter("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v) but the roots; a root is its component's least node.

    A round is two contractions and cuts the lineage in the shared folder. The graph's
    diameter halves about every round. Only two numbers a round reach the driver.
    """
    links = checkpointed(links.select("u", "v").filter("u <> v").distinct())
    mark = _mark(links)
    while mark[0]:
        links = checkpointed(_star(_star(links, True), False))
        before, mark = mark, _mark(links)
        if before == mark:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
