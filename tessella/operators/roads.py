"""Roads to graph: edges between cuts, measures, node numbering, load shedding, half-edges, turns, name tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import GRAPH_CELL, cell, graph_position, heading, segment_length, unit_x, unit_y
from .spatial import split_at_cells
from .tables import materialize


def road_edges(points: DataFrame, shared: DataFrame) -> DataFrame:
    """``way, edge, pos, node, cut, ax, ay, x, y``: points (``way, pos, node, lon, lat``) with the segment that ends at each
    and the number of the edge that the segment belongs to. Cuts are way ends and shared nodes."""
    w = Window.partitionBy("way").orderBy("pos")
    p = points.join(shared.select("node", F.lit(True).alias("_shared")), "node", "left")
    p = p.withColumns({"x": unit_x(F.col("lon")), "y": unit_y(F.col("lat"))})
    p = p.withColumns({"_prev": F.lag("pos").over(w), "_next": F.lead("pos").over(w), "ax": F.lag("x").over(w), "ay": F.lag("y").over(w)})
    p = p.withColumn("cut", F.col("_prev").isNull() | F.col("_next").isNull() | F.coalesce("_shared", F.lit(False)))
    # a segment belongs to the edge that the last cut before its end began
    before = F.sum(F.col("cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return p.withColumn("edge", F.coalesce(before, F.lit(0)).cast("int")).select("way", "edge", "pos", "node", "cut", "ax", "ay", "x", "y")


def edge_measures(segments: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """``way, edge, a, b, points, length, ascent, descent``: end nodes and sums over the segments of every edge.

    ``heights``: ``way, pos, z`` of the points; without it climbs are null."""
    if heights is not None:
        segments = segments.join(heights, ["way", "pos"], "left")
    else:
        segments = segments.withColumn("z", F.lit(None).cast("double"))
    w = Window.partitionBy("way").orderBy("pos")
    s = segments.withColumns({"before": F.lag("node").over(w), "dz": F.col("z") - F.lag("z").over(w)}).filter("edge > 0")
    return s.groupBy("way", "edge").agg(
        F.min_by("before", "pos").alias("a"), F.max_by("node", "pos").alias("b"), F.count("*").alias("points"),
        F.sum(segment_length(F.col("ax"), F.col("ay"), F.col("x"), F.col("y"))).alias("length"),
        F.sum(F.greatest(F.col("dz"), F.lit(0.0))).alias("ascent"), F.sum(F.greatest(-F.col("dz"), F.lit(0.0))).alias("descent"))


def graph_nodes(ends: DataFrame) -> DataFrame:
    """``node, bx, by, u, v, number``: nodes (``node, x, y``) numbered from 1 inside their graph cell by (v, u, id)."""
    n = ends.select("node", "x", "y").distinct()
    n = n.withColumns({"bx": cell(F.col("x") / 2, GRAPH_CELL), "by": cell(F.col("y") / 2, GRAPH_CELL)})
    n = n.withColumns({"u": graph_position(F.col("x"), F.col("bx")), "v": graph_position(F.col("y"), F.col("by"))})
    return n.withColumn("number", F.row_number().over(Window.partitionBy("bx", "by").orderBy("v", "u", "node"))).select("node", "bx", "by", "u", "v", "number")


def half_edges(edges: DataFrame, nodes: DataFrame, most_cells: int = 63) -> DataFrame:
    """Both directions of every edge, with the target as cell offset and number; edges over too many cells or with an end
    outside ``nodes`` are left out."""
    both = edges.select("way", "edge", F.col("a").alias("node"), F.col("b").alias("target"), F.lit(True).alias("forward")).unionByName(
        edges.select("way", "edge", F.col("b").alias("node"), F.col("a").alias("target"), F.lit(False).alias("forward")))
    at = nodes.select("node", "bx", "by", "number")
    to = nodes.select(F.col("node").alias("target"), F.col("bx").alias("tx"), F.col("by").alias("ty"), F.col("number").alias("target_number"))
    joined = both.join(at, "node").join(to, "target").withColumns({"dx": F.col("tx") - F.col("bx"), "dy": F.col("ty") - F.col("by")})
    return joined.filter(F.greatest(F.abs("dx"), F.abs("dy")) <= most_cells).select("way", "edge", "forward", "bx", "by", "number", "dx", "dy", "target_number")


def cell_load(edges: DataFrame) -> DataFrame:
    """``bx, by, ends, nodes``: edge ends and distinct nodes of each graph cell; ``edges``: ``node, bx, by`` for each end."""
    return edges.groupBy("bx", "by").agg(F.count("*").alias("ends"), F.countDistinct("node").alias("nodes"))


def shed_level(cls: Column, category: Column) -> Column:
    """The level from which a full cell drops a road of this class and category; null for never. Steps and footways,
    service roads, paths, tracks."""
    return F.when(cls.isin(11, 14), 1).when((cls == 7) & (category == 6), 2).when(cls == 13, 3).when(cls == 12, 4)


def shed(ends: DataFrame, most_ends: int = 1 << 19, most_nodes: int = 1 << 18, levels: int = 4, strict: bool = True) -> DataFrame:
    """Edges (``way, edge``) that stay when full cells (``most_ends`` edge ends or ``most_nodes`` nodes, or more) give up their least needed roads.

    ``ends``: ``way, edge, node, bx, by, rank`` (of ``shed_level``). A full cell goes up one level a round; an edge goes if
    either of its cells has reached its rank. A cell that is full at the last level is an error, or, with ``strict`` off,
    keeps the roads that no level drops. A cell that isn't full never gets full again, so there are no more rounds than levels."""
    left, reached = ends, None
    for done in range(levels + 1):
        full = cell_load(left).filter((F.col("ends") >= most_ends) | (F.col("nodes") >= most_nodes)).select("bx", "by", F.lit(1).alias("up"))
        if full.isEmpty() or (done == levels and not strict):
            return left.select("way", "edge").distinct()
        reached = full if reached is None else reached.unionByName(full)
        reached = materialize(reached.groupBy("bx", "by").agg(F.sum("up").cast("int").alias("up")), "levels")
        if strict and not reached.filter(F.col("up") > levels).isEmpty():
            raise ValueError(f"a cell is full even without the roads of level {levels}")
        gone = ends.join(reached, ["bx", "by"]).filter("rank <= up").select("way", "edge").distinct()
        left = materialize(ends.join(gone, ["way", "edge"], "left_anti"), "left")


def street_pieces(segments: DataFrame, size: int) -> DataFrame:
    """``way, edge, part, pos, before, total, ax, ay, bx, by, cx, cy``: the parts of road segments (``road_edges`` with both ends) in
    street pieces, which end at junctions and at cell borders; ``before`` and ``total`` are lengths along the piece."""
    parts = split_at_cells(segments.select("way", "edge", "pos", "ax", "ay", "bx", "by"), size)
    along, edge = Window.partitionBy("way", "edge").orderBy("pos", "t0"), Window.partitionBy("way", "edge", "part").orderBy("pos", "t0")
    moved = F.coalesce((F.lag("cx").over(along) != F.col("cx")) | (F.lag("cy").over(along) != F.col("cy")), F.lit(False))
    parts = parts.withColumn("_moved", moved.cast("int")).withColumn("part", F.sum("_moved").over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    parts = parts.withColumn("_size", F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")))
    whole = edge.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.withColumns({"before": F.coalesce(F.sum("_size").over(edge.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "total": F.sum("_size").over(whole)})
    return parts.select("way", "edge", "part", "pos", "t0", "before", "total", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("qx").alias("bx"), F.col("qy").alias("by"), "cx", "cy")


def piece_measures(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """``piece, length, first_node, last_node`` of street pieces (``street_pieces`` with ``piece``): the share of the edge's length (of
    ``edge_measures``) by planar lengths, in whole length units, and the edge's end nodes where the piece reaches them, else null."""
    one = parts.groupBy("way", "edge", "part", "piece").agg(F.max("total").alias("total"))
    edge = Window.partitionBy("way", "edge")
    one = one.withColumns({"_planar": F.sum("total").over(edge), "_last": F.max("part").over(edge)}).join(edges.select("way", "edge", "a", "b", F.col("length").alias("_length")), ["way", "edge"])
    length = F.rint(F.when(F.col("_planar") != 0, F.col("_length") * F.col("total") / F.col("_planar")).otherwise(0.0)).cast("long")
    return one.select("piece", length.alias("length"), F.when(F.col("part") == 0, F.col("a")).alias("first_node"), F.when(F.col("part") == F.col("_last"), F.col("b")).alias("last_node"))


def left_turns(half: DataFrame, angle: float = 35.0, road_class: int = 7, most: int = 5) -> DataFrame:
    """``node, turns``: pairs of outgoing car edges that turn left by more than ``angle``, packed six bits each.

    ``half``: ``node, seq, class, heading`` with ``seq`` the place of the edge among all edges of the node from 0."""
    car = half.filter(F.col("class") <= road_class)
    enough = car.groupBy("node").agg(F.count("*").alias("n")).filter("n >= 3").select("node")
    car = car.join(enough, "node", "left_semi")
    pairs = car.select("node", F.col("seq").alias("a"), F.col("heading").alias("ha")).join(car.select("node", F.col("seq").alias("c"), F.col("heading").alias("hc")), "node")
    turn = F.pmod(F.pmod(F.col("hc") - F.col("ha"), F.lit(360.0)), F.lit(360.0)) - 180.0
    left = pairs.filter((F.col("a") != F.col("c")) & (turn > angle))
    packed = left.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("a", "c"))).alias("p"), F.max(F.greatest("a", "c")).alias("m"), F.count("*").alias("n")).filter((F.col("n") <= most) & (F.col("m") <= 7))
    bits = F.aggregate(F.transform("p", lambda x, j: F.shiftleft(x.getField("a").cast("long") + 8 * x.getField("c"), 0) * F.pow(F.lit(2.0), 6 * j).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return packed.select("node", bits.alias("turns"))


def name_table(names: DataFrame, sort_key: str = "sort_key") -> DataFrame:
    """Distinct names of a cell by sort key, with the byte offset of each: four bytes for every word before it."""
    w = Window.partitionBy("cx", "cy").orderBy(sort_key, "name")
    words = F.size(F.split("name", " "))
    return names.select("cx", "cy", "name", sort_key).distinct().withColumn("offset", F.coalesce(4 * F.sum(words).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).select("cx", "cy", "name", "offset")


def start_heading(first: DataFrame) -> DataFrame:
    """``heading`` of rows ``x, y, nx, ny`` (a node and the next point off it)."""
    return first.withColumn("heading", heading(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"), F.col("y")))
