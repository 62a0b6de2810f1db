"""Areas from segments: parity, rings, nesting, dissolve; area algebra on grid cells."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .lines import task_of
from .tables import materialize, spread


def odd_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Undirected segments (``xa, ya, xb, yb``) that occur an odd number of times under ``keys``; points and pairs cancel."""
    a, b = F.struct(F.col("xa").alias("x"), F.col("ya").alias("y")), F.struct(F.col("xb").alias("x"), F.col("yb").alias("y"))
    s = segments.filter("xa <> xb OR ya <> yb").select(*keys, F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    odd = s.groupBy(*keys, "p", "q").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return odd.select(*keys, F.col("p.x").alias("xa"), F.col("p.y").alias("ya"), F.col("q.x").alias("xb"), F.col("q.y").alias("yb"))


def simple_rings(ring: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The rings of at least three points that are left when a ring is cut at each vertex that it visits again.

    The smallest such vertex comes first: all its visits cut at once, and every stretch from one to the next is a ring to look at anew."""
    whole, todo = [], [ring]
    while todo:
        one = todo.pop()
        again = [p for p, n in Counter(one).items() if n > 1]
        if not again:
            whole.append(one)
            continue
        turned = one[one.index(min(again)) :] + one[: one.index(min(again))]
        cuts = [i for i, p in enumerate(turned) if p == turned[0]]
        todo += [turned[i:j] for i, j in zip(cuts, [*cuts[1:], len(turned)])]
    return [r for r in whole if len(r) > 2]


def twice_area(ring: list[tuple[int, int]]) -> int:
    x0, y0 = ring[0]
    return sum((ax - x0) * (by - y0) - (bx - x0) * (ay - y0) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]))


def normal_ring(ring: list[tuple[int, int]], outer: bool) -> list[tuple[int, int]]:
    """Start at the smallest vertex; outer rings run counter-clockwise, holes clockwise."""
    if (twice_area(ring) > 0) != outer:
        ring = ring[::-1]
    at = ring.index(min(ring))
    return ring[at:] + ring[:at]


def _closed_walk(links: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Points of one ring in order. Each link ``x, y, s, t`` is a visit to a vertex, between the segments ``s`` and ``t``."""
    visits: dict[int, list[int]] = {}
    for i, (_, _, s, t) in enumerate(links):
        visits.setdefault(s, []).append(i)
        visits.setdefault(t, []).append(i)
    at = min(range(len(links)), key=links.__getitem__)
    segment, points = links[at][3], []
    for _ in links:
        x, y, s, t = links[at]
        points.append((x, y))
        segment = s + t - segment  # leave by the other segment
        one, other = visits[segment]
        at = one + other - at
    return points


def _inner_point(ring: list[tuple[int, int]]) -> tuple[float, float]:
    """A point inside a simple ring: between the first two crossings of a line just above its lowest vertices."""
    y0, y1 = sorted({y for _, y in ring})[:2]
    y = (y0 + y1) / 2
    x = sorted(ax + (y - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]) if (ay > y) != (by > y))
    return (x[0] + x[1]) / 2, y


def assemble(segments: DataFrame, key: str, band: int = 1 << 14) -> tuple[DataFrame, DataFrame]:
    """Rings (``key, ring, depth, parent, points``) of every area, and the areas (``key``) whose outline doesn't close.

    Pairs of segments cancel; at every vertex the segments left are paired in the order of their angles; what the pairs join is
    a ring, found by components over segments. So areas are spread over tasks, and one task orders the points of a ring, which are one
    row afterwards. Rings that touch themselves fall apart where a vertex repeats. Depth and parent come from
    crossing counts of a point inside each ring with the edges of the area's larger rings, met in bands of ``band`` units."""
    odd = materialize(odd_segments(segments, [key]).withColumn("s", F.monotonically_increasing_id()), "outline")
    n = odd.count()
    end = lambda a, b: odd.select(key, "s", F.col(f"x{a}").alias("x"), F.col(f"y{a}").alias("y"), F.atan2(F.col(f"y{b}") - F.col(f"y{a}"), F.col(f"x{b}") - F.col(f"x{a}")).alias("angle"))
    at_vertex = Window.partitionBy(key, "x", "y")
    ends = spread(end("a", "b").unionByName(end("b", "a")), 2 * n, key, "x", "y").withColumn("pair", F.floor((F.row_number().over(at_vertex.orderBy("angle", "s")) - 1) / 2))
    pairs = materialize(ends.groupBy(key, "x", "y", "pair").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.count("*").alias("n")), "pairs")
    open_ = materialize(pairs.filter("n = 1").select(key).distinct(), "open_areas")
    closed = spread(pairs, n, key).join(spread(open_, n, key), key, "left_anti").select(key, "x", "y", "a", "b")
    label = components(odd.select(F.col("s").alias("node")), closed.select("a", "b")).withColumnRenamed("node", "a")
    links = materialize(spread(closed, n, "a").join(spread(label, n, "a"), "a"), "links")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (area, _), one in pdf.groupby([key, "component"], sort=True):
            for ring in simple_rings(_closed_walk(list(one[["x", "y", "a", "b"]].itertuples(index=False, name=None)))):
                points, (px, py) = normal_ring(ring, True), _inner_point(ring)
                out.append((area, px, py, abs(twice_area(ring)), [{"x": x, "y": y} for x, y in points]))
        return pd.DataFrame(out, columns=[key, "px", "py", "size", "points"])

    kind = segments.schema[key].dataType.simpleString()
    dealt = spread(links.select("*", task_of(links, "component", n)), n, "_task")
    rings = dealt.groupBy("_task").applyInPandas(walk, f"{key} {kind}, px double, py double, size bigint, points array<struct<x:bigint,y:bigint>>")
    first = F.get("points", 0)
    order = Window.partitionBy(key).orderBy(first.getField("x"), first.getField("y"), "size", "px", "py")
    rings = materialize(spread(rings, n, key).withColumn("ring", (F.row_number().over(order) - 1).cast("int")), "rings")
    by_key = spread(rings, n, key)  # a ring's row is as large as its points are many
    several = by_key.filter("ring > 0").select(key).distinct()
    inner = by_key.join(several, key, "left_semi").select(key, "ring", "size", "px", "py", F.floor(F.col("py") / band).alias("band"))
    edges = by_key.join(several, key, "left_semi").select(key, F.col("ring").alias("other"), F.col("size").alias("larger"), F.explode(F.arrays_zip(F.col("points").alias("p"), F.concat(F.slice("points", 2, F.size("points")), F.array(first)).alias("q"))).alias("e"))
    edges = edges.select(key, "other", "larger", F.col("e.p.x").alias("ax"), F.col("e.p.y").alias("ay"), F.col("e.q.x").alias("bx"), F.col("e.q.y").alias("by")).filter("ay <> by")
    edges = edges.withColumn("band", F.explode(F.sequence(F.floor(F.least("ay", "by") / band), F.floor(F.greatest("ay", "by") / band))))
    crosses = ((F.col("ay") > F.col("py")) != (F.col("by") > F.col("py"))) & (F.col("px") < (F.col("bx") - F.col("ax")) * (F.col("py") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    around = spread(inner, n, key, "band").join(spread(edges, n, key, "band"), [key, "band"]).filter((F.col("larger") > F.col("size")) & crosses).groupBy(key, "ring", "other", "larger").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    around = spread(around, n, key, "ring")
    nested = around.groupBy(key, "ring").agg(F.count("*").cast("int").alias("depth"), F.min_by("other", F.struct("larger", "other")).alias("parent"))
    placed = spread(rings, n, key, "ring").join(nested, [key, "ring"], "left").withColumns({"depth": F.coalesce("depth", F.lit(0)), "parent": F.coalesce("parent", F.lit(-1))})
    clockwise = F.concat(F.slice("points", 1, 1), F.reverse(F.slice("points", 2, F.size("points"))))
    return placed.select(key, "ring", "depth", "parent", F.when(F.col("depth") % 2 == 0, F.col("points")).otherwise(clockwise).alias("points")), open_


def ring_area(points: Column) -> Column:
    """Shoelace area of a ring, vertices relative to its first one."""
    first = F.get(points, 0)
    rest = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    terms = F.zip_with(points, rest, lambda a, b: (a.getField("x") - first.getField("x")) * (b.getField("y") - first.getField("y")) - (b.getField("x") - first.getField("x")) * (a.getField("y") - first.getField("y")))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, x: s + x) / 2.0


def touching(segments: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``a, b``: areas (equal in ``by``) that share a segment, each to the smallest area at it: enough for components."""
    a, b = F.struct(F.col("xa").alias("x"), F.col("ya").alias("y")), F.struct(F.col("xb").alias("x"), F.col("yb").alias("y"))
    s = segments.select(*by, key, F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    least = s.groupBy(*by, "p", "q").agg(F.min(key).alias("a"), F.max(key).alias("_m")).filter("a <> _m")
    return s.join(least, [*by, "p", "q"]).filter(F.col("a") != F.col(key)).select("a", F.col(key).alias("b")).distinct()


def dissolve(segments: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Outlines ``component, by, xa, ya, xb, yb`` of touching areas merged: inside a component shared segments cancel."""
    label = components(segments.select(F.col(key).alias("node")).distinct(), touching(segments, key, by)).select(F.col("node").alias(key), "component")
    return odd_segments(segments.join(label, key), ["component", *by])


def large_polygons(rings: DataFrame, key: str, least: float, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``rings`` (of ``assemble``) without outer rings and holes under ``least`` square units, and without outer rings whose box
    misses ``box`` (``x0, y0, x1, y1``); the holes of what goes, go too."""
    xs, ys = F.transform("points", lambda p: p.getField("x")), F.transform("points", lambda p: p.getField("y"))
    keeps = F.abs(ring_area(F.col("points"))) >= least
    if box is not None:
        x0, y0, x1, y1 = box
        keeps = keeps & ((F.col("depth") % 2 == 1) | ~((F.array_max(xs) < x0) | (F.array_min(xs) > x1) | (F.array_max(ys) < y0) | (F.array_min(ys) > y1)))
    kept = rings.filter(keeps)
    outer = kept.filter("depth % 2 = 0").select(key, F.col("ring").alias("parent"))
    return kept.filter("depth % 2 = 0").unionByName(kept.filter("depth % 2 = 1").join(outer, [key, "parent"], "left_semi").select(*kept.columns))


def islets(coast: DataFrame, least: float) -> DataFrame:
    """Closed coast ways (``points``, first and last equal) tagged as islets (``islet``) of at least ``least`` square units, as areas of class 11."""
    ring = F.slice("points", 1, F.size("points") - 1)
    closed = coast.filter(F.col("islet") & (F.size("points") >= 4) & (F.get("points", 0) == F.element_at("points", -1)))
    return closed.withColumn("points", ring).filter(F.abs(ring_area(F.col("points"))) >= least).withColumns({"array": F.lit("c5"), "class": F.lit(11)})


def cells_union(*covers: DataFrame) -> DataFrame:
    out = covers[0]
    for c in covers[1:]:
        out = out.unionByName(c)
    return out.distinct()


def cells_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["cx", "cy"], "left_anti")


def cells_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["cx", "cy"], "left_semi")


def cells_odd(covers: DataFrame) -> DataFrame:
    """Cells that an odd number of covers has."""
    return covers.groupBy("cx", "cy").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("cx", "cy")


def sea_cells(box: DataFrame, land: DataFrame, inland_water: DataFrame) -> DataFrame:
    """Cells of a box that are no land, and inland water on land."""
    return cells_union(cells_difference(box, land), cells_intersection(box, inland_water))


def clip_ring_to_box(points: list[tuple[float, float]], x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    """Sutherland-Hodgman: the part of a ring inside a box; exact in area, border edges may degenerate."""
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for p, q in zip(points, points[1:] + points[:1]):
            dp, dq = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if dp >= 0:
                out.append(p)
            if (dp < 0) != (dq < 0):
                t = dp / (dp - dq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        points = out
        if not points:
            break
    return points


def cut_into_blocks(rings: DataFrame, key: str, block: int) -> DataFrame:
    """``key, ring, bx, by, size``: rings cut into blocks (rows by box overlap, clipped in Arrow batches)."""
    xs, ys = F.transform("points", lambda p: p.getField("x")), F.transform("points", lambda p: p.getField("y"))
    span = lambda v: F.sequence(F.floor(F.array_min(v) / block).cast("long"), F.floor((F.array_max(v) - 1) / block).cast("long"))
    spread = rings.withColumn("bx", F.explode(span(xs))).withColumn("by", F.explode(span(ys))).select(key, "ring", "bx", "by", "points")

    def clip(batches):
        for pdf in batches:
            areas = []
            for bx, by, points in zip(pdf["bx"], pdf["by"], pdf["points"]):
                part = clip_ring_to_box([(p["x"], p["y"]) for p in points], bx * block, by * block, (bx + 1) * block, (by + 1) * block)
                areas.append(twice_area(part) / 2 if len(part) >= 3 else 0.0)
            yield pdf[[key, "ring", "bx", "by"]].assign(size=areas)

    kind = rings.schema[key].dataType.simpleString()
    return spread.mapInPandas(clip, f"{key} {kind}, ring int, bx bigint, by bigint, size double").filter("size <> 0")


def coastlines(ways: DataFrame, segments: DataFrame) -> DataFrame:
    """``chain, closed, twice_area, kind`` of coast ways chained by their end nodes.

    ``ways``: ``way, first, last`` (end nodes); ``segments``: ``way, xa, ya, xb, yb`` in drawing order, y north. Land lies on
    the left: a ring that runs counter-clockwise is land, a clockwise one is water. An open chain is closed straight."""
    ends = ways.select("way", F.explode(F.array("first", "last")).alias("node"))
    least = ends.groupBy("node").agg(F.min("way").alias("a"))
    links = ends.join(least, "node").filter("a <> way").select("a", F.col("way").alias("b"))
    chain = components(ways.select(F.col("way").alias("node")), links).select(F.col("node").alias("way"), F.col("component").alias("chain"))
    s = segments.join(chain, "way")
    turn = s.groupBy("chain").agg(F.sum(F.col("xa") * F.col("yb") - F.col("xb") * F.col("ya")).alias("turn"))
    out = s.select("chain", F.col("xa").alias("x"), F.col("ya").alias("y"), F.lit(1).alias("d")).unionByName(s.select("chain", F.col("xb").alias("x"), F.col("yb").alias("y"), F.lit(-1).alias("d")))
    loose = out.groupBy("chain", "x", "y").agg(F.sum("d").alias("d")).filter("d <> 0")
    gap = loose.groupBy("chain").agg(*[F.sum(F.when(F.col("d") == sign, F.col(c))).alias(f"{c}{sign % 3}") for sign in (1, -1) for c in ("x", "y")])
    joined = turn.join(gap, "chain", "left")
    closing = F.coalesce(F.col("x2") * F.col("y1") - F.col("x1") * F.col("y2"), F.lit(0))  # from the loose end back to the start
    twice = F.col("turn") + closing
    return joined.select("chain", F.col("x1").isNull().alias("closed"), twice.alias("twice_area"), F.when(twice > 0, "land").when(twice < 0, "water").alias("kind"))
