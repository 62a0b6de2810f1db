"""Coordinates and the cell grid that partitions every layer (pure Column expressions).

Map units: 2**28 of them make a turn, x runs east from 180 W and y south from 90 N. A cell is 32768 units wide; a tile
holds ``g`` by ``g`` cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the map model.
UNIT_BITS = 28
AREA_BITS = 25
CELL = 32768
MARGIN = 512
GRAPH_CELL = 65536
EARTH_RADIUS_M = 6371000.0
#: Length units per metre on a road edge.
LENGTH_FACTOR = 5 * 2**25 / (2 * math.pi * EARTH_RADIUS_M)
METRES_PER_UNIT = 2 * math.pi * EARTH_RADIUS_M / 2**28


def unit_x(lon: Column, bits: int = UNIT_BITS) -> Column:
    """Map x of a longitude in decimicrodegrees (1e-7 degrees)."""
    return (lon / 1e7 + 180.0) * (2.0**bits / 360.0)


def unit_y(lat: Column, bits: int = UNIT_BITS) -> Column:
    return (90.0 - lat / 1e7) * (2.0**bits / 360.0)


def area_x(lon: Column) -> Column:
    """Area units (2**25 a turn), rounded half to even."""
    return F.rint(unit_x(lon, AREA_BITS)).cast("int")


def area_y(lat: Column) -> Column:
    return F.rint(unit_y(lat, AREA_BITS)).cast("int")


def to_lon(x: Column) -> Column:
    return x / (2.0**UNIT_BITS / 360.0) - 180.0


def to_lat(y: Column) -> Column:
    return 90.0 - y / (2.0**UNIT_BITS / 360.0)


def cell(v: Column, size: int = CELL) -> Column:
    return F.floor(v / size).cast("long")


def tile(c: Column, g: int) -> Column:
    return F.floor(c / g).cast("long")


def slot(cx: Column, cy: Column, g: int) -> Column:
    """Number of a cell inside its tile."""
    return F.pmod(cx, F.lit(g)) * g + F.pmod(cy, F.lit(g))


def packed(u: Column, v: Column) -> Column:
    """Position inside a cell, ``v << 16 | u``."""
    return F.shiftleft(v.cast("long"), 16).bitwiseOR(u.cast("long"))


def cells_touched(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, size: int = CELL, margin: int = 0) -> DataFrame:
    """``df`` with a row for every cell ``cx, cy`` that a box reaches with a margin."""
    span = lambda a, b: F.sequence(cell(a - margin, size), cell(b + margin, size))
    return df.withColumn("cx", F.explode(span(x0, x1))).withColumn("cy", F.explode(span(y0, y1)))


def graph_position(v: Column, graph_cell: Column) -> Column:
    """Half-unit position inside a graph cell, 65536 units squeezed to 0..65535 by truncation."""
    return F.floor((v / 2 - graph_cell * GRAPH_CELL) * ((GRAPH_CELL - 1.0) / GRAPH_CELL)).cast("long")


def detail_level(width: Column, height: Column, base: int = 4096) -> Column:
    """Level from which a ring is drawn: 14 for small ones, 9 at the least, by the shorter side."""
    side, level = F.least(width, height), F.lit(14)
    for k in range(1, 6):
        level = F.when(side >= base << k, 14 - k).otherwise(level)
    return level


def local_points(points: Column, ox: Column, oy: Column, margin: int = MARGIN) -> Column:
    """Points (array of x, y) relative to a cell's origin: rounded, shifted by the margin, consecutive repeats dropped;
    null for fewer than two."""
    moved = F.transform(points, lambda p: packed(F.rint(p.getField("x") - ox) + margin, F.rint(p.getField("y") - oy) + margin))
    changes = F.filter(moved, lambda p, i: (i == 0) | (p != F.get(moved, i - 1)))
    return F.when(F.size(changes) >= 2, changes)


def segment_length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Great-circle length of a segment in length units."""
    lat0, lat1 = F.radians(to_lat(y0)), F.radians(to_lat(y1))
    dlon = F.radians(to_lon(x1) - to_lon(x0))
    h = F.pow(F.sin((lat1 - lat0) / 2), 2) + F.cos(lat0) * F.cos(lat1) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_M * LENGTH_FACTOR * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def compensated_sum(values: Column) -> Column:
    """Sum of an array of doubles in its order with the lost low bits added at the end (Neumaier)."""
    def add(state: Column, x: Column) -> Column:
        s, c = state.getField("s"), state.getField("c")
        lost = F.when(F.abs(s) >= F.abs(x), (s - (s + x)) + x).otherwise((x - (s + x)) + s)
        return F.struct((s + x).alias("s"), (c + lost).alias("c"))
    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), add, lambda state: state.getField("s") + state.getField("c"))


def compensated_mean(values: Column) -> Column:
    return compensated_sum(values) / F.when(F.size(values) > 0, F.size(values))


def heading(dx: Column, dy: Column, y: Column) -> Column:
    """Direction in degrees counter-clockwise from east, x scaled by the latitude's cosine."""
    return F.degrees(F.atan2(-dy, dx * F.cos(F.radians(to_lat(y)))))
