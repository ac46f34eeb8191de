"""Connected components of links, by alternating large-star and small-star rounds.

Every step is a minimum per node (summed before the shuffle) and a join on the
node; no node's neighbours are gathered in one place, and the links stay in
tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _spread(least: DataFrame) -> DataFrame:
    """Deals the minima anew, so that the join that follows shuffles both sides and can split a node with many links."""
    return least.repartition(F.xxhash64("u"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _spread(both.groupBy("u").agg(F.min("v").alias("m")))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = _spread(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node that has a link; root is the component's least node.

    ``links`` has two columns of longs; direction, repeats and self-links don't matter.
    """
    a, b = links.columns
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = materialize(links, name)
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        links = materialize(_small_star(_large_star(links)), name)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
