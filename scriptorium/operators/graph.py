"""Connected components of an edge table, by rounds of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the least node that each node of edges (a, b) reaches; any sortable type.

    Large stars tie each node's greater neighbours to its least one, small stars its lesser ones; the number of rounds
    grows with the logarithm of the diameter.  Each round's edges are written to the shared folder.  Minima are written
    before they are joined, so adaptive execution can split a node that has a large part of the edges.  What a round has
    read is deleted once the next one's edges are written.
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    e = written(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        # Done when each node hangs on one lesser node, and none of these hangs on another.
        n, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
        both = e.union(e.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lesser = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lesser, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = written(small.union(lesser.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(e, least, large, lesser)
        e = following
    raise RuntimeError(f"no end after {most_rounds} rounds")
