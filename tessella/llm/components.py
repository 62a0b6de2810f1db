"""Connected components of the nodes of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import components as labelled


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (columns ``a, b``); the label is the component's smallest node. Loops, repeated
    edges and rows with a null end are harmless; without edges the result is empty."""
    whole = edges.select("a", "b").filter("a <> b")
    nodes = whole.select(F.col("a").alias("node")).unionByName(whole.select(F.col("b").alias("node")))
    return labelled(nodes, whole).withColumnRenamed("component", "label")
