"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each end of the links (a, b) reaches.

    Alternating star contraction: in each round every node hands its neighbours
    the smallest of them, first those above it, then those below it, until each
    node hangs on its component's smallest. The number of rounds grows with the
    logarithm of the number of nodes; a hub's rows are aggregated before the
    shuffle and joined, never gathered in a list. Each round is a written table.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        # neighbours above a node go to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y")
        edges = written(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        # done when no node that others hang on hangs on another
        if not edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() and not edges.groupBy("b").count().where("count > 1").limit(1).count():
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
