"""Connected components of a link table, by alternating star contractions, as Spark jobs.

Each round links the larger neighbours of a node to its smallest neighbour, then the smaller ones, until
every node points at the smallest node of its component. Minima are aggregated before they are joined
back, so a node with very many links is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateframe.session import materialize

MAX_ROUNDS = 60


def _with_smallest(links: DataFrame, label: str) -> DataFrame:
    """(u, v) links with ``m``, the smallest of u and all its neighbours v."""
    smallest = materialize(links.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"{label}-minima")
    return links.join(smallest, "u")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of a table of links (u, v) of whole numbers.

    Links may repeat and run either way; a link to itself or to null says nothing and is dropped. No links
    give no rows. The component is its smallest node.
    """
    links = links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = materialize(links.distinct(), label)
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_smallest(both, label).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u != v").distinct(), label)
        near = _with_smallest(large, label)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        links = materialize(small.filter("u != v").distinct(), label)
        parents = links.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        unsettled = parents.filter("n > 1").select("u").union(links.join(links.select(F.col("u").alias("v")), "v", "left_semi").select("u"))
        if unsettled.isEmpty():
            roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    raise RuntimeError("components did not settle")
