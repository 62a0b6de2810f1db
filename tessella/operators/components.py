"""Connected components by repeated contraction (streets by their ends, touching polygons)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop_table, materialize, shuffled, spread


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` for every row of ``nodes`` (``node``): the smallest node reachable over ``edges`` (``a, b``).

    Every round each node points to its smallest neighbour or itself, pointers are followed once more, and edges move to
    where their ends point; the loop ends when no edge joins two components. Rounds grow with the logarithm of the size."""
    rest = materialize(edges.select("a", "b").filter("a <> b").distinct(), "links")
    label = materialize(nodes.select("node", F.col("node").alias("component")).distinct(), "labels")
    named = label.count()
    while n := rest.count():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = spread(both, 2 * n, "a").groupBy("a").agg(F.least("a", F.min("b")).alias("p"))
        to = spread(to, 2 * n, "p").join(shuffled(spread(to.select(F.col("a").alias("p"), F.col("p").alias("pp")), 2 * n, "p")), "p").select("a", F.col("pp").alias("p"))
        to = materialize(to, "pointers")
        move = lambda c: shuffled(spread(to.select(F.col("a").alias(c), F.col("p").alias(f"{c}_p")), 2 * n, c))
        after = materialize(spread(spread(rest, 2 * n, "a").join(move("a"), "a"), 2 * n, "b").join(move("b"), "b").select(F.least("a_p", "b_p").alias("a"), F.greatest("a_p", "b_p").alias("b")).filter("a <> b").distinct(), "links")
        new = materialize(spread(label, named, "component").join(shuffled(spread(to.select(F.col("a").alias("component"), "p"), named, "component")), "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        for old in (rest, to, label):
            drop_table(old)
        rest, label = after, new
    drop_table(rest)
    return label
