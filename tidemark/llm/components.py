"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of the links (``a``, ``b``); the root is the least node.

    Alternating stars: each node ties its larger neighbours, then its smaller ones,
    to the least it knows, until nothing changes; rounds grow with the logarithm of
    the longest path. Minima are combined before the shuffle, and each round is
    written to the shared folder. Links of a node to itself and repeated links do
    no harm; no links give no rows.
    """
    links = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Saved, so that the join deals both sides anew and may split a node with very many neighbours.
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large.where("u <> v"), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("u"), F.col("m").alias("v")).union(tied.select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = saved(small.where("u <> v").distinct(), "small")
        # The sums tell whether a round changed anything.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
