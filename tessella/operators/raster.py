"""Raster jobs on tile rows ``tile_row, tile_col, z`` (row-major arrays of ``side`` by ``side``); an absent tile is zero.

Spark deals the tiles and exchanges border strips; numpy works inside one tile.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE_SCHEMA = "tile_row long, tile_col long, z array<double>"


def kernel(sigma: float, cut: float = 4.0) -> np.ndarray:
    """Normalised Gaussian weights, cut at ``cut`` sigma."""
    radius = int(cut * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def with_halo(tiles: DataFrame, side: int, radius: int) -> DataFrame:
    """``tile_row, tile_col, parts``: every tile with the strips of its neighbours that are at most ``radius`` away.

    Only strips are shuffled: a tile is cut up before it is sent to its eight neighbours."""
    def cut(batches):
        for pdf in batches:
            out = []
            for r, c, z in zip(pdf["tile_row"], pdf["tile_col"], pdf["z"]):
                a = np.asarray(z, float).reshape(side, side)
                for dr in (-1, 0, 1):
                    rows = slice(side - radius, side) if dr == 1 else slice(0, radius) if dr == -1 else slice(0, side)
                    for dc in (-1, 0, 1):
                        cols = slice(side - radius, side) if dc == 1 else slice(0, radius) if dc == -1 else slice(0, side)
                        out.append((r + dr, c + dc, -dr, -dc, a[rows, cols].ravel()))
            yield pd.DataFrame(out, columns=["tile_row", "tile_col", "dr", "dc", "part"])

    sent = tiles.select(F.col("tile_row").cast("long"), F.col("tile_col").cast("long"), F.col("z").cast("array<double>")).mapInPandas(cut, "tile_row long, tile_col long, dr int, dc int, part array<double>")
    return sent.groupBy("tile_row", "tile_col").agg(F.collect_list(F.struct("dr", "dc", "part")).alias("parts"), F.bool_or((F.col("dr") == 0) & (F.col("dc") == 0)).alias("own")).filter("own").drop("own")  # nine parts at most


def _padded(parts, side: int, radius: int) -> np.ndarray:
    p = np.zeros((side + 2 * radius, side + 2 * radius))
    at = {-1: slice(0, radius), 0: slice(radius, radius + side), 1: slice(radius + side, side + 2 * radius)}
    for x in parts:
        target = p[at[x["dr"]], at[x["dc"]]]
        target[:] = np.asarray(x["part"], float).reshape(target.shape)
    return p


def smooth(tiles: DataFrame, side: int, rows: int, cols: int, sigma: float = 1.0) -> DataFrame:
    """Gaussian smoothing, rows then columns; the grid of ``rows`` by ``cols`` tiles is reflected at its edge."""
    w = kernel(sigma)
    radius = len(w) // 2

    def run(batches):
        for pdf in batches:
            out = []
            for r, c, parts in zip(pdf["tile_row"], pdf["tile_col"], pdf["parts"]):
                p = _padded(parts, side, radius)
                if r == 0:
                    p[:radius] = p[radius : 2 * radius][::-1]
                if r == rows - 1:
                    p[side + radius :] = p[side : side + radius][::-1]
                if c == 0:
                    p[:, :radius] = p[:, radius : 2 * radius][:, ::-1]
                if c == cols - 1:
                    p[:, side + radius :] = p[:, side : side + radius][:, ::-1]
                v = sum(k * p[i : i + side] for i, k in enumerate(w))
                out.append(sum(k * v[:, i : i + side] for i, k in enumerate(w)).ravel())
            yield pdf[["tile_row", "tile_col"]].assign(z=out)

    return with_halo(tiles, side, radius).mapInPandas(run, TILE_SCHEMA)


def hillshade(tiles: DataFrame, side: int, step_m: float, latitude: Column | None = None, exaggeration: float = 1.5) -> DataFrame:
    """Light from the north west at 45 degrees, flat = 1; slopes from the neighbours' border rows."""
    lx, ly, lz = math.cos(math.radians(45)) * math.sin(math.radians(315)), math.cos(math.radians(45)) * math.cos(math.radians(315)), math.sin(math.radians(45))

    def run(batches):
        for pdf in batches:
            out = []
            for parts, lat in zip(pdf["parts"], pdf["lat"]):
                p = _padded(parts, side, 1) * exaggeration
                gy = (p[2:, 1:-1] - p[:-2, 1:-1]) / (2 * step_m)
                gx = (p[1:-1, 2:] - p[1:-1, :-2]) / (2 * step_m * math.cos(math.radians(lat)))
                out.append(((-gx * lx + gy * ly + lz) / np.sqrt(gx * gx + gy * gy + 1) / lz).ravel())
            yield pdf[["tile_row", "tile_col"]].assign(z=out)

    return with_halo(tiles, side, 1).withColumn("lat", F.lit(0.0) if latitude is None else latitude).mapInPandas(run, TILE_SCHEMA)


def shade_colour(colour: Column, shade: Column, water: Column) -> Column:
    """A colour channel under shade: factor 0.7 about flat, held in 0.4 to 1.12; water is not shaded."""
    s = F.when(water, 1.0).otherwise(F.least(F.greatest(1.0 + 0.7 * (shade - 1.0), F.lit(0.4)), F.lit(1.12)))
    return F.floor(F.least(F.greatest(colour * s, F.lit(0.0)), F.lit(255.0))).cast("int")


def resample_nearest(z: Column, side: int, new_side: int) -> Column:
    """Nearest-index resample of a tile; negative values become 0."""
    index = F.transform(F.sequence(F.lit(0), F.lit(new_side * new_side - 1)), lambda i: F.floor(F.floor(i / new_side) * side / new_side) * side + F.floor((i % new_side) * side / new_side))
    return F.transform(index, lambda i: F.when(F.get(z, i.cast("int")) < 0, F.lit(0.0)).otherwise(F.get(z, i.cast("int")).cast("double")))


def pyramid(tiles: DataFrame, side: int) -> DataFrame:
    """The next level: two by two tiles become one, each pixel the mean of four; absent children are zero."""
    half = side // 2

    def shrink(batches):
        for pdf in batches:
            small = [np.asarray(z, float).reshape(half, 2, half, 2).mean((1, 3)).ravel() for z in pdf["z"]]
            yield pdf[["tile_row", "tile_col"]].assign(z=small)

    def join(batches):
        for pdf in batches:
            out = []
            for parts in pdf["parts"]:
                a = np.zeros((side, side))
                for x in parts:
                    a[x["r"] * half : (x["r"] + 1) * half, x["c"] * half : (x["c"] + 1) * half] = np.asarray(x["z"]).reshape(half, half)
                out.append(a.ravel())
            yield pdf[["tile_row", "tile_col"]].assign(z=out)

    small = tiles.select(F.col("tile_row").cast("long"), F.col("tile_col").cast("long"), F.col("z").cast("array<double>")).mapInPandas(shrink, TILE_SCHEMA)  # a quarter is shuffled
    up = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    four = small.select(up("tile_row"), up("tile_col"), F.struct((F.col("tile_row") % 2).alias("r"), (F.col("tile_col") % 2).alias("c"), "z").alias("p")).groupBy("tile_row", "tile_col").agg(F.collect_list("p").alias("parts"))
    return four.mapInPandas(join, TILE_SCHEMA)


def pyramid_levels(tiles: DataFrame, side: int, levels: int = 3) -> DataFrame:
    """``level, tile_row, tile_col, z``: the tiles (level 0) and ``levels`` halvings; a parent exists if any of its children does."""
    out, now = tiles.select(F.lit(0).alias("level"), F.col("tile_row").cast("long"), F.col("tile_col").cast("long"), F.col("z").cast("array<double>")), tiles
    for level in range(1, levels + 1):
        now = pyramid(now, side)
        out = out.unionByName(now.select(F.lit(level).alias("level"), "tile_row", "tile_col", "z"))
    return out


def crop_cells(tiles: DataFrame, side: int, cell: int, land: float = 0.5) -> DataFrame:
    """``tile_row, tile_col, row, col, z``: tiles cut into squares of ``cell`` pixels; those without a value above ``land`` are left out."""
    n = side // cell
    pixel = lambda row, col: F.transform(F.sequence(F.lit(0), F.lit(cell * cell - 1)), lambda i: F.get("z", ((row * cell + F.floor(i / cell)) * side + col * cell + i % cell).cast("int")))
    cells = tiles.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return cells.select("tile_row", "tile_col", "row", "col", pixel(F.col("row"), F.col("col")).alias("z")).filter(F.array_max("z") > land)


def rasterise(rings: DataFrame, pixel: float) -> DataFrame:
    """``row, col, ink``: pixels (of ``pixel`` units) whose centre lies in a ring (``paint, ink, points``), with the ink of the ring painted
    last, in the order of ``paint`` (any column that sorts). A hole is a ring of its own, painted after its outer ring in what shows through.
    Rings whose box is smaller than a pixel are left out.

    No tile is gathered: each ring gives the pixels between every second pair of crossings of a row's centre line, and the
    last paint of a pixel is an aggregate with partial sums."""
    x, y = F.transform("points", lambda p: p.getField("x")), F.transform("points", lambda p: p.getField("y"))
    large = rings.filter((F.array_max(x) - F.array_min(x) >= pixel) | (F.array_max(y) - F.array_min(y) >= pixel)).withColumn("_ring", F.monotonically_increasing_id())
    closed = F.arrays_zip(F.col("points").alias("p"), F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1)).alias("q"))
    e = large.select("_ring", "paint", "ink", F.explode(closed).alias("e")).select("_ring", "paint", "ink", F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1"))
    line = lambda v: F.ceil(v / pixel - 0.5).cast("long")  # noqa: E731  the first row or column with its centre at or after a place
    first, last = line(F.least("y0", "y1")), line(F.greatest("y0", "y1")) - 1
    crossed = e.filter(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    crossed = crossed.withColumn("x", F.col("x0") + ((F.col("row") + 0.5) * pixel - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))
    w = Window.partitionBy("_ring", "row").orderBy("x")
    gaps = crossed.withColumns({"n": F.row_number().over(w), "to": F.lead("x").over(w)}).filter("n % 2 = 1 AND to IS NOT NULL")
    inside = gaps.filter(line(F.col("x")) < line(F.col("to"))).select("row", F.explode(F.sequence(line(F.col("x")), line(F.col("to")) - 1)).alias("col"), "paint", "ink")
    return inside.groupBy("row", "col").agg(F.max_by("ink", "paint").alias("ink"))


def write_grid(tiles: DataFrame, path: str) -> None:
    """A stored height grid: rows by tile, near ones in one file, so that a box reads few files."""
    tiles.repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col").write.mode("overwrite").parquet(path)


def read_grid(spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The tiles of a stored grid, or those in ``box`` (first and last tile row, first and last tile column)."""
    rows = spark.read.parquet(path)
    return rows if box is None else rows.filter(F.col("tile_row").between(*box[:2]) & F.col("tile_col").between(*box[2:]))


def bilinear(points: DataFrame, tiles: DataFrame, side: int, rows: int, cols: int, key: str = "id", outside: str = "zero") -> DataFrame:
    """``key, z`` for points at positions ``r, c`` of a grid of ``rows`` by ``cols`` pixels: the four pixels around each, wherever
    their tiles are; absent ones are zero, positions on the last row or column are held just inside. Points off the grid are zero, or with ``outside`` "edge" take
    the value at its edge."""
    off = F.lit(outside == "zero") & ((F.col("r") < 0) | (F.col("c") < 0) | (F.col("r") > rows) | (F.col("c") > cols))
    held = points.withColumns({"_off": off, "r": F.least(F.greatest(F.col("r"), F.lit(0.0)), F.lit(rows - 1.001)), "c": F.least(F.greatest(F.col("c"), F.lit(0.0)), F.lit(cols - 1.001))})
    r0, c0 = F.floor("r"), F.floor("c")
    corners = [(dr, dc) for dr in (0, 1) for dc in (0, 1)]
    weight = lambda dr, dc: F.when(F.col("_off"), 0.0).otherwise((F.col("r") - r0 if dr else 1 - (F.col("r") - r0)) * (F.col("c") - c0 if dc else 1 - (F.col("c") - c0)))
    four = held.select(key, F.explode(F.array(*[F.struct((r0 + dr).alias("pr"), (c0 + dc).alias("pc"), weight(dr, dc).alias("w")) for dr, dc in corners])).alias("p"))
    at = four.select(key, F.floor(F.col("p.pr") / side).cast("long").alias("tile_row"), F.floor(F.col("p.pc") / side).cast("long").alias("tile_col"), ((F.col("p.pr") % side) * side + F.col("p.pc") % side).cast("int").alias("i"), F.col("p.w").alias("w"))
    met = at.join(tiles.select("tile_row", "tile_col", "z"), ["tile_row", "tile_col"], "left")
    return met.groupBy(key).agg(F.sum(F.col("w") * F.coalesce(F.get("z", F.col("i")), F.lit(0.0))).alias("z"))


def height_profile(points: DataFrame, tiles: DataFrame, side: int, rows: int, cols: int, line: str) -> DataFrame:
    """``line, pos, cm, up, down``: heights in centimetres along lines of points (``line, pos`` and grid positions ``r, c``), with the climb and
    fall since the point before. Points off the grid take the height at its edge."""
    at = bilinear(points.withColumn("_key", F.struct(line, "pos")), tiles, side, rows, cols, "_key", "edge")
    z = at.select(F.col(f"_key.{line}").alias(line), F.col("_key.pos").alias("pos"), (100.0 * F.col("z")).alias("cm"))
    step = F.col("cm") - F.lag("cm").over(Window.partitionBy(line).orderBy("pos"))
    return z.withColumns({"up": F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0)), "down": F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0))})


def region_windows(regions: DataFrame, tiles: DataFrame, side: int, rows: int, cols: int, n: int, margin: int = 1) -> DataFrame:
    """``region, z``: ``n`` by ``n`` pixels with ``margin`` more on every side, resampled from whatever tiles lie under them.

    ``regions``: ``region``, the grid position ``r0, c0`` of its first pixel without the margin and the step ``dr, dc`` from pixel to pixel. Pixels
    off the grid of ``rows`` by ``cols`` are zero, absent tiles too. A tile is cut where it stands and only the strip that a region
    needs is sent on, so a task holds the window of one region at a time."""
    last = n - 1 + margin
    span = lambda at, step, most: (F.least(F.greatest(F.col(at) - margin * F.col(step), F.lit(0.0)), F.lit(most - 1.001)), F.least(F.greatest(F.col(at) + last * F.col(step), F.lit(0.0)), F.lit(most - 1.001)))
    (r_low, r_high), (c_low, c_high) = span("r0", "dr", rows), span("c0", "dc", cols)
    window = regions.select("region", "r0", "c0", "dr", "dc", F.floor(r_low).alias("ra"), (F.floor(r_high) + 2).alias("rb"), F.floor(c_low).alias("ca"), (F.floor(c_high) + 2).alias("cb"))
    tile = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side).cast("long"), F.floor((F.col(b) - 1) / side).cast("long")))
    asked = window.withColumn("tile_row", tile("ra", "rb")).withColumn("tile_col", tile("ca", "cb"))
    met = asked.join(tiles.select("tile_row", "tile_col", F.col("z").cast("array<double>").alias("z")), ["tile_row", "tile_col"], "left")

    def cut(batches):
        for pdf in batches:
            out = []
            for x in pdf.itertuples():
                a, b = max(x.ra, x.tile_row * side), min(x.rb, (x.tile_row + 1) * side)
                c, d = max(x.ca, x.tile_col * side), min(x.cb, (x.tile_col + 1) * side)
                z = None if x.z is None else np.asarray(x.z, float).reshape(side, side)[a - x.tile_row * side : b - x.tile_row * side, c - x.tile_col * side : d - x.tile_col * side].ravel()
                out.append((x.region, x.r0, x.c0, x.dr, x.dc, x.ra, x.rb, x.ca, x.cb, a, b, c, d, z))
            yield pd.DataFrame(out, columns=names)

    names = ["region", "r0", "c0", "dr", "dc", "ra", "rb", "ca", "cb", "a", "b", "c", "d", "z"]
    kind = regions.schema["region"].dataType.simpleString()
    strips = met.mapInPandas(cut, f"region {kind}, r0 double, c0 double, dr double, dc double, {', '.join(f'{c} long' for c in names[5:13])}, z array<double>")
    gathered = strips.groupBy(*names[:9]).agg(F.collect_list(F.struct("a", "b", "c", "d", "z")).alias("parts"))  # the tiles under one window

    def sample(batches):
        for pdf in batches:
            out = []
            for x in pdf.itertuples():
                w = np.zeros((x.rb - x.ra, x.cb - x.ca))
                for p in x.parts:
                    if p["z"] is not None:
                        w[p["a"] - x.ra : p["b"] - x.ra, p["c"] - x.ca : p["d"] - x.ca] = np.asarray(p["z"], float).reshape(p["b"] - p["a"], p["d"] - p["c"])
                r, c = x.r0 + np.arange(-margin, n + margin) * x.dr, x.c0 + np.arange(-margin, n + margin) * x.dc
                off = ((r < 0) | (r > rows))[:, None] | ((c < 0) | (c > cols))[None]
                r, c = np.clip(r, 0, rows - 1.001), np.clip(c, 0, cols - 1.001)
                i, j = np.floor(r).astype(int), np.floor(c).astype(int)
                fr, fc = (r - i)[:, None], (c - j)[None]
                at = lambda di, dj: w[np.ix_(i + di - x.ra, j + dj - x.ca)]  # noqa: B023,E731
                z = (at(0, 0) * (1 - fc) + at(0, 1) * fc) * (1 - fr) + (at(1, 0) * (1 - fc) + at(1, 1) * fc) * fr
                out.append(np.where(off, 0.0, z).ravel())
            yield pdf[["region"]].assign(z=out)

    return gathered.mapInPandas(sample, f"region {kind}, z array<double>")


def mosaic(tiles: DataFrame, wanted: DataFrame, side: int, rows: int, cols: int, grow: int = 1) -> DataFrame:
    """The tiles among ``wanted`` (``tile_row, tile_col``) that exist, and tiles of zeros for their missing neighbours up to ``grow`` away inside
    the grid of ``rows`` by ``cols`` tiles, which a filter over the borders fills."""
    land = tiles.select("tile_row", "tile_col", F.col("z").cast("array<double>").alias("z")).join(wanted.select("tile_row", "tile_col").distinct(), ["tile_row", "tile_col"], "left_semi")
    near = lambda c: F.explode(F.sequence(F.col(c) - grow, F.col(c) + grow)).alias(c)
    around = land.select(near("tile_row"), "tile_col").select("tile_row", near("tile_col")).distinct().filter(F.col("tile_row").between(0, rows - 1) & F.col("tile_col").between(0, cols - 1))
    return around.join(land, ["tile_row", "tile_col"], "left").withColumn("z", F.coalesce("z", F.array_repeat(F.lit(0.0), side * side)))


#: Bits after the point of filter weights, and half width of the filter in pixels of the smaller image; fixed values.
WEIGHT_BITS, FILTER_REACH = 22, 3


def lanczos_weights(size: int, factor: int) -> np.ndarray:
    """Weights of each pixel of an image side that is ``factor`` times smaller, over the pixels of the large one, in fixed point.

    The kernel is cut at the image's edges and its weights are made to sum to one again."""
    centre = (np.arange(size // factor)[:, None] + 0.5) * factor
    x = (np.arange(size)[None] + 0.5 - centre) / factor
    inside = (np.arange(size)[None] >= np.floor(centre - FILTER_REACH * factor + 0.5)) & (np.arange(size)[None] < np.floor(centre + FILTER_REACH * factor + 0.5))
    w = np.where(inside & (np.abs(x) < FILTER_REACH), np.sinc(x) * np.sinc(x / FILTER_REACH), 0.0)
    w = w / w.sum(1, keepdims=True) * (1 << WEIGHT_BITS)
    return np.trunc(w + np.where(w < 0, -0.5, 0.5)).astype(np.int64)


def filtered_levels(tiles: DataFrame, side: int, span: int = 8) -> DataFrame:
    """``level, tile_row, tile_col, z``: images of regions of ``span`` by ``span`` tiles (8-bit values) at half, a quarter, ... of their size, each
    from the tiles themselves, with a Lanczos filter that reaches over the tiles' borders but not over the region's. Rows are filtered first
    and rounded to 8 bits, then columns. A tile exists if one of those under it does.

    Every tile is cut into what each smaller tile needs of it; a task holds what lies under one smaller tile."""
    factors = [1 << k for k in range(1, span.bit_length())]

    def reach(factor: int, t: int) -> tuple[int, int]:
        return max(0, (t * side - FILTER_REACH) * factor - 1), min(span * side, ((t + 1) * side + FILTER_REACH) * factor + 1)

    def cut(batches):
        for pdf in batches:
            out = []
            for row, col, z in zip(pdf["tile_row"], pdf["tile_col"], pdf["z"]):
                a, r, c = np.asarray(z, np.int64).reshape(side, side), row % span, col % span
                for level, factor in enumerate(factors, 1):
                    for i in range(span // factor):
                        top, end = (np.clip(np.array(reach(factor, i)) - r * side, 0, side)).tolist()
                        for j in range(span // factor):
                            left, right = (np.clip(np.array(reach(factor, j)) - c * side, 0, side)).tolist()
                            if top < end and left < right:
                                own = r // factor == i and c // factor == j
                                out.append((level, row // span * (span // factor) + i, col // span * (span // factor) + j, r * side + top, c * side + left, end - top, own, a[top:end, left:right].ravel()))
            yield pd.DataFrame(out, columns=["level", "tile_row", "tile_col", "top", "left", "height", "own", "part"])

    sent = tiles.select(F.col("tile_row").cast("long"), F.col("tile_col").cast("long"), "z").mapInPandas(cut, "level int, tile_row long, tile_col long, top int, left int, height int, own boolean, part array<int>")
    under = sent.groupBy("level", "tile_row", "tile_col").agg(F.collect_list(F.struct("top", "left", "height", "part")).alias("parts"), F.bool_or("own").alias("own")).filter("own").drop("own")

    def clipped(v: np.ndarray) -> np.ndarray:
        return np.clip(v + (1 << WEIGHT_BITS - 1) >> WEIGHT_BITS, 0, 255)

    def filter_(batches):
        weights = {level: lanczos_weights(span * side, factor) for level, factor in enumerate(factors, 1)}
        for pdf in batches:
            out = []
            for level, row, col, parts in zip(pdf["level"], pdf["tile_row"], pdf["tile_col"], pdf["parts"]):
                factor = factors[level - 1]
                i, j = row % (span // factor), col % (span // factor)
                (top, end), (left, right) = reach(factor, i), reach(factor, j)
                image = np.zeros((end - top, right - left), np.int64)
                for p in parts:
                    part = np.asarray(p["part"]).reshape(p["height"], -1)
                    image[p["top"] - top : p["top"] - top + part.shape[0], p["left"] - left : p["left"] - left + part.shape[1]] = part
                w = weights[level]
                across = clipped(image @ w[j * side : (j + 1) * side, left:right].T)
                out.append(clipped(w[i * side : (i + 1) * side, top:end] @ across).ravel())
            yield pdf[["level", "tile_row", "tile_col"]].assign(z=out)

    return under.mapInPandas(filter_, "level int, tile_row long, tile_col long, z array<int>")


def touched_tiles(edges: DataFrame, size: float, grow: int = 2) -> DataFrame:
    """Tiles that an area with the edges ``x0, y0, x1, y1`` touches, grown by ``grow`` tiles on every side: those that an edge runs
    through, and those inside, whose centre lies between two crossings of a line through the middle of their row."""
    steps = F.ceil(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))) / size * 10).cast("int") + 1
    along = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / steps
    p = edges.select(F.explode(F.transform(F.sequence(F.lit(0), steps), lambda i: F.struct(along("x0", "x1", i).alias("x"), along("y0", "y1", i).alias("y")))).alias("p"))
    under = p.select(F.floor(F.col("p.x") / size).cast("long").alias("cx"), F.floor(F.col("p.y") / size).cast("long").alias("cy")).distinct()
    row = lambda v: F.floor(v / size - 0.5).cast("long")
    crossed = edges.withColumn("cy", F.explode(F.sequence(row(F.least("y0", "y1")), row(F.greatest("y0", "y1")) + 1))).withColumn("_y", (F.col("cy") + 0.5) * size)
    crossed = crossed.filter((F.col("y0") > F.col("_y")) != (F.col("y1") > F.col("_y"))).select("cy", (F.col("x0") + (F.col("_y") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).alias("x"))
    w = Window.partitionBy("cy").orderBy("x")
    gaps = crossed.withColumns({"n": F.row_number().over(w), "to": F.lead("x").over(w)}).filter("n % 2 = 1 AND to IS NOT NULL")
    first, last = F.ceil(F.col("x") / size - 0.5).cast("long"), F.floor(F.col("to") / size - 0.5).cast("long")
    inside = gaps.filter(first <= last).select(F.explode(F.sequence(first, last)).alias("cx"), "cy")
    around = F.sequence(F.lit(-grow), F.lit(grow))
    return under.unionByName(inside).distinct().withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).select((F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy")).distinct()


def quantised(z: Column, most: int = 255) -> Column:
    """``struct<a0, a1, v>``: scale, base and 16-bit values of heights; ``(v / a0 + a1) / 6 - 1000`` gives them back."""
    u = F.transform(z, lambda h: 6.0 * (h + 1000.0))
    a1 = F.floor(F.array_min(u)).cast("long")
    a0 = F.least(F.greatest(F.floor(65535 / F.greatest(F.ceil(F.array_max(u)) - a1, F.lit(1))), F.lit(1)), F.lit(most)).cast("long")
    return F.struct(a0.alias("a0"), a1.alias("a1"), F.transform(u, lambda h: F.least(F.greatest(F.rint((h - a1) * a0), F.lit(0.0)), F.lit(65535.0)).cast("int")).alias("v"))
