"""Joins between relations, ways and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import route_bits
from .tables import spread


def member_ways(relations: DataFrame) -> DataFrame:
    """``rel, way``: distinct way members of relations (``id, members array<struct<type, ref, role>>``), roles ignored."""
    refs = F.array_distinct(F.transform(F.filter("members", lambda m: m.getField("type") == "way"), lambda m: m.getField("ref")))
    return relations.select(F.col("id").alias("rel"), F.explode(refs).alias("way"))


def way_points(way_refs: DataFrame, nodes: DataFrame, missing: str = "drop_point", rows: int = 0) -> DataFrame:
    """``way, pos, node, lon, lat`` from ``way, pos, node`` and ``id, lon, lat``.

    ``missing``: ``drop_point`` (roads), ``drop_way`` (areas) or ``keep`` (null coordinates, for averages). ``rows``: of ``way_refs``,
    where they are known; large tables then meet in as many partitions as they need."""
    at = spread(nodes.select(F.col("id").alias("node"), "lon", "lat"), rows, "node")
    way_refs = spread(way_refs, rows, "node")
    if missing == "drop_point":
        return way_refs.join(at, "node").select("way", "pos", "node", "lon", "lat")
    found = way_refs.join(at, "node", "left").select("way", "pos", "node", "lon", "lat")
    if missing == "keep":
        return found
    found = spread(found, rows, "way")
    whole = found.groupBy("way").agg(F.count("*").alias("n"), F.count("lon").alias("k")).filter("n = k").select("way")
    return found.join(whole, "way", "left_semi")


def way_lines(points: DataFrame) -> DataFrame:
    """``way, points array<struct<pos, lon, lat>>`` in reference order."""
    return points.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("points"))  # a way's points


def route_flags(members: DataFrame) -> DataFrame:
    """``way, flags``: the OR of the bits of all route relations (``way, route, network``) of a way."""
    return members.groupBy("way").agg(F.bit_or(route_bits(F.col("route"), F.col("network"))).alias("flags"))


def shared_nodes(way_refs: DataFrame) -> DataFrame:
    """Nodes that more than one row of ``way_refs`` uses (a way that crosses itself counts)."""
    return way_refs.groupBy("node").agg(F.count("*").alias("uses")).filter("uses > 1")


def most_common(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value with the largest ``n`` for each key; ties go to the one first seen (smallest ``seq``)."""
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col("seq"))).alias(value), F.max("n").alias("n"))


def top_shares(counted: DataFrame, keys: list[str], most: int = 3, share: float = 0.25) -> DataFrame:
    """The ``most`` most frequent values of each group (``n``, ties to the smaller ``seq``) with at least ``share`` of its total."""
    group = Window.partitionBy(*keys)
    ranked = counted.withColumns({"k": F.row_number().over(group.orderBy(F.desc("n"), "seq")), "total": F.sum("n").over(group)})
    return ranked.filter((F.col("k") <= most) & (F.col("n") >= share * F.col("total")))
