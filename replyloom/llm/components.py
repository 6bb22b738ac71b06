"""Connected components of a graph given as a table of links.

Small-star and large-star passes (Kiveris et al., 2014): in each pass every node hangs its
neighbours on the smallest one. Both are joins against a per-node minimum, which Spark combines
map-side, so a node with a third of all links is no longer than the others. Nothing but the
number of changed links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import Scratch
from replyloom.operators.keys import lookup_join


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour that is larger than a node goes to the smallest of node and neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("m"))
    return lookup_join(both.filter("b > a"), least, "a", "node").select(
        F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every neighbour not larger than a node, and the node, go to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
    hung = lookup_join(down, least, "a", "node").select(F.col("b").alias("a"), "m")
    own = least.select(F.col("node").alias("a"), "m")
    return hung.unionByName(own).select("a", F.col("m").alias("b")).filter("a <> b").distinct()


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``node, root`` for every node with a link; ``root`` is the smallest node reachable.

    ``links`` has the two columns ``a`` and ``b``; direction, self links and repeats do not
    matter. No links give an empty table.
    """
    now = scratch.write(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b").distinct(), "links")
    before = None
    while True:
        now = scratch.write(_small_star(_large_star(now)), "links")
        # The pair of sums is a fixed-size fingerprint of the link set, not its content.
        print_now = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                            F.sum(F.xxhash64("b", "a", "b").cast("decimal(38,0)"))).first()
        if print_now == before:
            break
        before = print_now
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
