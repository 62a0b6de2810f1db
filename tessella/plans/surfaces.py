"""Areas and rasters on the parcel and tile views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import areas, raster, spatial
from ..operators.tables import spread
from ..sources.fixtures import ctes, view
from .common import query

PARCELS = ctes("v_parcel_seg") + """, sg AS (SELECT cls, area, CASE WHEN (xa, ya) < (xb, yb) THEN xa ELSE xb END AS x0, CASE WHEN (xa, ya) < (xb, yb) THEN ya ELSE yb END AS y0, CASE WHEN (xa, ya) < (xb, yb) THEN xb ELSE xa END AS x1, CASE WHEN (xa, ya) < (xb, yb) THEN yb ELSE ya END AS y1 FROM v_parcel_seg)"""


@query(PARCELS + ", o AS (SELECT cls, x0, y0, x1, y1 FROM sg GROUP BY ALL HAVING count(*) % 2 = 1) SELECT cls, count(*) AS segments, sum(abs(x1 - x0) + abs(y1 - y0)) AS length FROM o GROUP BY cls")
def odd_segments(spark, sf_dir):
    """AGG4: segments left by parity, by class."""
    o = areas.odd_segments(view(spark, sf_dir, "v_parcel_seg"), ["cls"])
    return o.groupBy("cls").agg(F.count("*").alias("segments"), F.sum(F.abs(F.col("xb") - F.col("xa")) + F.abs(F.col("yb") - F.col("ya"))).alias("length"))


NESTED = """WITH c AS (SELECT c_custkey AS area, c_custkey % 5 AS holes, 100 * (c_custkey % 50) AS x, 100 * (c_custkey // 50) AS y FROM customer)"""


def nested_segments(spark, sf_dir):
    """An area for each customer: a square of 60 units, up to four square holes in it, the last one with an island, and a lobe of
    20 units that touches the square's corner; the segments in either direction, and one pair that cancels."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("area"), (F.col("c_custkey") % 5).alias("holes"), (100 * (F.col("c_custkey") % 50)).alias("x"), (100 * F.floor(F.col("c_custkey") / 50)).alias("y"))
    square = lambda x, y, n: F.array(*[F.struct((F.col("x") + x + a * n).alias("xa"), (F.col("y") + y + b * n).alias("ya"), (F.col("x") + x + d * n).alias("xb"), (F.col("y") + y + e * n).alias("yb")) for a, b, d, e in ((0, 0, 1, 0), (1, 1, 1, 0), (1, 1, 0, 1), (0, 0, 0, 1))])
    none = F.array().cast("array<struct<xa:bigint,ya:bigint,xb:bigint,yb:bigint>>")
    holes = [F.when(F.col("holes") > k, square(5 + 13 * k, 5, 10)).otherwise(none) for k in range(4)]
    pair = F.array(*[F.struct((F.col("x") + 1).alias("xa"), (F.col("y") + 1).alias("ya"), (F.col("x") + 3).alias("xb"), (F.col("y") + 2).alias("yb"))] * 2)
    parts = F.concat(square(0, 0, 60), square(60, 60, 20), *holes, F.when(F.col("holes") == 4, square(5 + 39 + 3, 8, 4)).otherwise(none), pair)
    c = spread(c, 20 * c.count(), "area")  # before each becomes some twenty segments
    return c.select("area", F.explode(F.transform(parts, lambda p: F.struct(*[p.getField(k).cast("long").alias(k) for k in ("xa", "ya", "xb", "yb")]))).alias("p")).select("area", "p.*")


@query(NESTED + """, r AS (SELECT area, 0 AS depth, x, y, 60 AS side FROM c UNION ALL SELECT area, 0, x + 60, y + 60, 20 FROM c UNION ALL SELECT area, 1, x + 5 + 13 * k, y + 5, 10 FROM c, LATERAL (SELECT unnest(range(0, holes)) AS k) UNION ALL SELECT area, 2, x + 47, y + 8, 4 FROM c WHERE holes = 4)
SELECT area, CAST(depth AS INTEGER) AS depth, 4 AS points, CAST(CASE WHEN depth = 1 THEN -1 ELSE 1 END * side * side AS DOUBLE) AS size, x + side / 2.0::DOUBLE AS cx, y + side / 2.0::DOUBLE AS cy, CAST(x AS BIGINT) AS first_x, CAST(y AS BIGINT) AS first_y FROM r""")
def assembled_areas(spark, sf_dir):
    """ASM1, ASM2, ASM3, ASM4, TXT10, TXT11: rings of areas with holes, islands and touching lobes: depth, signed area, centre, first point."""
    rings, _ = areas.assemble(nested_segments(spark, sf_dir), "area")
    centre = lambda c: (F.aggregate("points", F.lit(0).cast("long"), lambda s, p: s + p.getField(c)) / F.size("points")).cast("double")
    first = F.get("points", 0)
    return rings.select("area", "depth", F.size("points").alias("n"), areas.ring_area(F.col("points")).alias("size"), centre("x").alias("cx"), centre("y").alias("cy"), first.getField("x").alias("first_x"), first.getField("y").alias("first_y")).withColumnRenamed("n", "points")


@query(NESTED + """ SELECT area, count(*) AS rings, CAST(sum(size) AS DOUBLE) AS size FROM (SELECT area, 3600 AS size FROM c UNION ALL SELECT area, 400 FROM c UNION ALL SELECT area, -100 FROM c, LATERAL (SELECT unnest(range(0, holes)) AS k)) WHERE abs(size) >= 100 GROUP BY area""")
def large_polygons(spark, sf_dir):
    """FLT3: areas without rings under 100 square units (the islands of 16 units here), with their size."""
    rings, _ = areas.assemble(nested_segments(spark, sf_dir), "area")
    kept = areas.large_polygons(rings, "area", 100.0)
    return kept.groupBy("area").agg(F.count("*").alias("rings"), F.sum(areas.ring_area(F.col("points"))).alias("size"))


@query("""WITH p AS (SELECT s_suppkey AS way, 3 + s_suppkey % 20 AS side, s_suppkey % 3 = 0 AS islet, s_suppkey % 7 <> 0 AS closed FROM supplier) SELECT way, CAST(11 AS INTEGER) AS class, CAST(side * side AS DOUBLE) AS size FROM p WHERE islet AND closed AND side * side >= 150""")
def islet_areas(spark, sf_dir):
    """ASM18: closed coast ways that are islets become areas of class 11, from 150 square units on."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("way"), (3 + F.col("s_suppkey") % 20).alias("n"), (F.col("s_suppkey") % 3 == 0).alias("islet"), (F.col("s_suppkey") % 7 != 0).alias("closed"))
    at = lambda a, b: F.struct((F.col("n") * a).cast("long").alias("x"), (F.col("n") * b).cast("long").alias("y"))
    ring = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1))
    coast = s.withColumn("points", F.when(F.col("closed"), F.concat(ring, F.array(at(0, 0)))).otherwise(ring))
    return areas.islets(coast, 150.0).select("way", "class", F.abs(areas.ring_area(F.col("points"))).alias("size"))


COMPONENTS = PARCELS.replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT DISTINCT a.area AS a, b.area AS b FROM sg a JOIN sg b ON a.cls = b.cls AND a.x0 = b.x0 AND a.y0 = b.y0 AND a.x1 = b.x1 AND a.y1 = b.y1 AND a.area <> b.area),
r AS (SELECT area AS node, area AS c FROM (SELECT DISTINCT area FROM sg) UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node), l AS (SELECT node, min(c) AS component FROM r GROUP BY node)"""


@query(COMPONENTS + ", o AS (SELECT component, cls, x0, y0, x1, y1 FROM sg JOIN l ON l.node = sg.area GROUP BY ALL HAVING count(*) % 2 = 1) SELECT component, cls, count(*) AS outline FROM o GROUP BY ALL")
def dissolved_areas(spark, sf_dir):
    """ASM9, JON10, ASM12: touching parcels of a class merged; outline by segment parity."""
    return areas.dissolve(view(spark, sf_dir, "v_parcel_seg"), "area", ["cls"]).groupBy("component", "cls").agg(F.count("*").alias("outline"))


@query("""WITH p AS (SELECT c_custkey AS area, 1000 * (c_custkey % 50) AS x, 1000 * CAST(floor(c_custkey / 50.0) AS BIGINT) AS y FROM customer),
b AS (SELECT area, bx, "by", CAST((least(x + 1000, (bx + 1) * 768) - greatest(x, bx * 768)) * (least(y + 1000, ("by" + 1) * 768) - greatest(y, "by" * 768)) AS DOUBLE) AS area_inside FROM p, LATERAL (SELECT unnest(range(CAST(floor(x / 768.0) AS BIGINT), CAST(floor((x + 999) / 768.0) AS BIGINT) + 1)) AS bx), LATERAL (SELECT unnest(range(CAST(floor(y / 768.0) AS BIGINT), CAST(floor((y + 999) / 768.0) AS BIGINT) + 1)) AS "by"))
SELECT bx, "by", round(sum(area_inside), 3) AS covered FROM b WHERE area_inside > 0 GROUP BY ALL""")
def block_areas(spark, sf_dir):
    """ASM8: parcels cut into blocks, covered area by block."""
    rings, _ = areas.assemble(view(spark, sf_dir, "v_parcel_seg"), "area")
    return areas.cut_into_blocks(rings, "area", 768).groupBy("bx", "by").agg(F.round(F.sum("size"), 3).alias("covered"))


CELLS = "WITH a AS (SELECT DISTINCT c_custkey % 50 AS cx, c_custkey // 50 AS cy FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), b AS (SELECT DISTINCT c_custkey % 50 AS cx, c_custkey // 50 + 1 AS cy FROM customer WHERE c_nationkey < 12), bx AS (SELECT DISTINCT c_custkey % 50 AS cx, c_custkey // 50 AS cy FROM customer)"


def covers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    at = lambda df, up=0: df.select((F.col("c_custkey") % 50).alias("cx"), (F.floor(F.col("c_custkey") / 50) + up).cast("long").alias("cy")).distinct()
    return at(c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))), at(c.filter("c_nationkey < 12"), 1), at(c)


@query(CELLS + """ SELECT 'union' AS op, count(*) AS n, sum(cx * 1000 + cy) AS s FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'difference', count(*), sum(cx * 1000 + cy) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'intersection', count(*), sum(cx * 1000 + cy) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'odd', count(*), sum(cx * 1000 + cy) FROM (SELECT cx, cy FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL HAVING count(*) % 2 = 1)
UNION ALL SELECT 'sea', count(*), sum(cx * 1000 + cy) FROM ((SELECT * FROM bx EXCEPT SELECT * FROM a) UNION (SELECT * FROM bx INTERSECT SELECT * FROM b))""")
def cover_algebra(spark, sf_dir):
    """SET3, SET4, SET5, ASM17: union, difference, intersection, even-odd and sea on cell covers."""
    a, b, box = covers(spark, sf_dir)
    ops = {"union": areas.cells_union(a, b), "difference": areas.cells_difference(a, b), "intersection": areas.cells_intersection(a, b), "odd": areas.cells_odd(a.unionByName(b)), "sea": areas.sea_cells(box, a, b)}
    out = None
    for name, cells in ops.items():
        row = cells.agg(F.lit(name).alias("op"), F.count("*").alias("n"), F.sum(F.col("cx") * 1000 + F.col("cy")).alias("s"))
        out = row if out is None else out.unionByName(row)
    return out


TILES = ctes("v_tile") + """, px AS (SELECT tile_row * 8 + (i - 1) // 8 AS r, tile_col * 8 + (i - 1) % 8 AS c, CAST(z[i] AS DOUBLE) AS z FROM v_tile, LATERAL (SELECT unnest(range(1, 65)) AS i)), dim AS (SELECT (max(tile_row) + 1) * 8 AS h, (max(tile_col) + 1) * 8 AS w FROM v_tile)"""


def tiles(spark, sf_dir):
    return view(spark, sf_dir, "v_tile").select("tile_row", "tile_col", F.col("z").cast("array<double>").alias("z"))


def pixels(t, digits=5):
    return t.select("tile_row", "tile_col", F.posexplode("z").alias("i", "v")).select("tile_row", "tile_col", "i", F.round("v", digits).alias("v"))


@query(TILES + """, g AS (SELECT r, c FROM (SELECT unnest(range(0, h)) AS r FROM dim), LATERAL (SELECT unnest(range(0, (SELECT w FROM dim))) AS c)), f AS (SELECT g.r, g.c, coalesce(px.z, 0) AS z FROM g LEFT JOIN px ON px.r = g.r AND px.c = g.c),
k AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * j * j)) FROM (SELECT unnest(range(-4, 5)) AS j)) AS wt FROM (SELECT unnest(range(-4, 5)) AS d)),
a AS (SELECT f.r, f.c, CASE WHEN f.r + d < 0 THEN -(f.r + d) - 1 WHEN f.r + d >= h THEN 2 * h - 1 - f.r - d ELSE f.r + d END AS sr, wt FROM f, k, dim),
v AS (SELECT a.r, a.c, sum(wt * f.z) AS z FROM a JOIN f ON f.r = a.sr AND f.c = a.c GROUP BY ALL),
b AS (SELECT v.r, v.c, CASE WHEN v.c + d < 0 THEN -(v.c + d) - 1 WHEN v.c + d >= w THEN 2 * w - 1 - v.c - d ELSE v.c + d END AS sc, wt FROM v, k, dim),
s AS (SELECT b.r, b.c, sum(wt * v.z) AS z FROM b JOIN v ON v.r = b.r AND v.c = b.sc GROUP BY ALL)
SELECT r // 8 AS tile_row, c // 8 AS tile_col, CAST((r % 8) * 8 + c % 8 AS INTEGER) AS i, round(z, 5) AS v FROM s WHERE (r // 8, c // 8) IN (SELECT (tile_row, tile_col) FROM v_tile)""")
def smoothed_tiles(spark, sf_dir):
    """RAS3, RAS2: Gaussian smoothing over tiles with halo exchange, reflected at the grid's edge."""
    t = tiles(spark, sf_dir)
    size = t.agg(F.max("tile_row").alias("r"), F.max("tile_col").alias("c")).first()
    return pixels(raster.smooth(t, 8, (size.r or 0) + 1, (size.c or 0) + 1))


@query(TILES + """, g AS (SELECT r, c FROM (SELECT unnest(range(0, h)) AS r FROM dim), LATERAL (SELECT unnest(range(0, (SELECT w FROM dim))) AS c)), f AS (SELECT g.r, g.c, coalesce(px.z, 0) AS z, px.z IS NOT NULL AS own FROM g LEFT JOIN px ON px.r = g.r AND px.c = g.c),
n AS (SELECT r, c, own, coalesce(lag(z) OVER v, 0) AS up, coalesce(lead(z) OVER v, 0) AS dn, coalesce(lag(z) OVER h, 0) AS lf, coalesce(lead(z) OVER h, 0) AS rt FROM f WINDOW v AS (PARTITION BY c ORDER BY r), h AS (PARTITION BY r ORDER BY c)),
s AS (SELECT r, c, (dn - up) * 1.5 / 2 AS gy, (rt - lf) * 1.5 / (2 * cos(radians(55))) AS gx FROM n WHERE own)
SELECT r // 8 AS tile_row, c // 8 AS tile_col, CAST((r % 8) * 8 + c % 8 AS INTEGER) AS i, round((-gx * cos(radians(45)) * sin(radians(315)) + gy * cos(radians(45)) * cos(radians(315)) + sin(radians(45))) / sqrt(gx * gx + gy * gy + 1) / sin(radians(45)), 5) AS v FROM s""")
def hillshaded_tiles(spark, sf_dir):
    """RAS5, RAS4's margin: hillshade with border rows from the neighbours."""
    return pixels(raster.hillshade(tiles(spark, sf_dir), 8, 1.0, F.lit(55.0)))


@query(TILES + """ SELECT r // 16 AS tile_row, c // 16 AS tile_col, CAST(((r // 2) % 8) * 8 + (c // 2) % 8 AS INTEGER) AS i, round(sum(z) / 4, 5) AS v FROM px GROUP BY ALL""")
def pyramid_tiles(spark, sf_dir):
    """RAS8: the next pyramid level (pixels without any child are left out on both sides)."""
    t = tiles(spark, sf_dir)
    p = pixels(raster.pyramid(t, 8))
    there = t.select(F.floor(F.col("tile_row") / 2).alias("tile_row"), F.floor(F.col("tile_col") / 2).alias("tile_col"), (F.col("tile_row") % 2).alias("a"), (F.col("tile_col") % 2).alias("b"))
    return p.withColumns({"a": F.floor(F.col("i") / 32).cast("long"), "b": F.floor(F.col("i") % 8 / 4).cast("long")}).join(there, ["tile_row", "tile_col", "a", "b"], "left_semi").select("tile_row", "tile_col", "i", "v")


@query(TILES + """, l AS (SELECT unnest(range(1, 4)) AS level), q AS (SELECT level, CAST(pow(2, level) AS BIGINT) AS f, r, c, z FROM px, l)
SELECT CAST(level AS INTEGER) AS level, r // f // 8 AS tile_row, c // f // 8 AS tile_col, CAST((r // f) % 8 * 8 + (c // f) % 8 AS INTEGER) AS i, round(sum(z) / (f * f), 5) AS v FROM q GROUP BY level, f, r // f, c // f""")
def pyramid_levels(spark, sf_dir):
    """RAS8: three halvings (pixels without any child are left out on both sides)."""
    t = tiles(spark, sf_dir)
    p = raster.pyramid_levels(t, 8).filter("level > 0").select("level", "tile_row", "tile_col", F.posexplode("z").alias("i", "v"))
    p = p.withColumns({"r": F.col("tile_row") * 8 + F.floor(F.col("i") / 8), "c": F.col("tile_col") * 8 + F.col("i") % 8})
    source = t.select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("level"), "tile_row", "tile_col").withColumn("n", F.expr("shiftright(8, level)"))
    span = lambda c: F.sequence(F.col(c) * F.col("n"), F.col(c) * F.col("n") + F.col("n") - 1)
    there = source.withColumn("r", F.explode(span("tile_row"))).withColumn("c", F.explode(span("tile_col"))).select("level", "r", "c").distinct()
    return p.join(there, ["level", "r", "c"], "left_semi").select("level", "tile_row", "tile_col", "i", F.round("v", 5).alias("v"))


@query(TILES + """ SELECT r // 8 AS tile_row, c // 8 AS tile_col, CAST(r % 8 // 4 AS INTEGER) AS "row", CAST(c % 8 // 4 AS INTEGER) AS col, round(max(2 * z), 5) AS top, round(sum(2 * z * ((r % 4) * 4 + c % 4 + 1)), 4) AS weighted FROM px GROUP BY ALL HAVING max(2 * z) > 0.5""")
def cropped_cells(spark, sf_dir):
    """RAS9, AGG19: tiles cut into cells of four by four pixels, those without land left out."""
    cells = raster.crop_cells(tiles(spark, sf_dir).withColumn("z", F.transform("z", lambda h: 2 * h)), 8, 4)
    weighted = F.aggregate(F.transform("z", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return cells.select("tile_row", "tile_col", "row", "col", F.round(F.array_max("z"), 5).alias("top"), F.round(weighted, 4).alias("weighted"))


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 9 AS cls, 37 * (c_custkey % 50) + c_custkey * 7 % 90 AS x, 41 * (c_custkey // 50) + c_custkey * 11 % 70 AS y, c_custkey % 80 AS side FROM customer),
r AS (SELECT cls, k, 0 AS hole, cls + 2 AS ink, x AS x0, y AS y0, x + side AS x1, y + side AS y1 FROM c UNION ALL SELECT cls, k, 1, 1, x + 10, y + 10, x + 35, y + 35 FROM c WHERE side >= 50),
p AS (SELECT *, unnest(range(CAST(ceil(y0 / 10.0 - 0.5) AS BIGINT), CAST(ceil(y1 / 10.0 - 0.5) AS BIGINT))) AS "row" FROM r WHERE x1 - x0 >= 10 OR y1 - y0 >= 10), q AS (SELECT *, unnest(range(CAST(ceil(x0 / 10.0 - 0.5) AS BIGINT), CAST(ceil(x1 / 10.0 - 0.5) AS BIGINT))) AS col FROM p)
SELECT "row", col, CAST(arg_max(ink, (cls, k, hole)) AS INTEGER) AS ink FROM q GROUP BY "row", col""")
def painted_cover(spark, sf_dir):
    """RAS6, FLT9: overlapping squares painted in the order of their class, their holes painted back in land."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), (k % 9).cast("int").alias("cls"), (37 * (k % 50) + k * 7 % 90).alias("x"), (41 * F.floor(k / 50) + k * 11 % 70).alias("y"), (k % 80).alias("side"))
    square = lambda d, n: F.array(*[F.struct((F.col("x") + d + a * n).cast("double").alias("x"), (F.col("y") + d + b * n).cast("double").alias("y")) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))])
    paint = lambda hole: F.struct("cls", "k", F.lit(hole).alias("hole")).alias("paint")
    outer = c.select(paint(0), (F.col("cls") + 2).alias("ink"), square(0, F.col("side")).alias("points"))
    holes = c.filter("side >= 50").select(paint(1), F.lit(1).alias("ink"), square(10, 25).alias("points"))
    return raster.rasterise(outer.unionByName(holes), 10.0)


@query(ctes("v_tile") + " SELECT tile_row, tile_col, CAST(i AS INTEGER) AS i, round(greatest(CAST(z[(i // 4) * 2 * 8 + (i % 4) * 2 + 1] AS DOUBLE), 0), 5) AS v FROM v_tile, LATERAL (SELECT unnest(range(0, 16)) AS i)")
def resampled_tiles(spark, sf_dir):
    """RAS1: nearest-index resample, negatives to zero."""
    return pixels(tiles(spark, sf_dir).withColumn("z", raster.resample_nearest(F.col("z"), 8, 4)))


POINTS = "SELECT event_id AS id, CAST(event_id * 7919 % 15000 AS DOUBLE) / 100 AS r, CAST(event_id * 6101 % 19000 AS DOUBLE) / 100 AS c FROM events"


@query(TILES + f""", q AS ({POINTS}), d2 AS (SELECT CAST(h AS DOUBLE) AS h, CAST(w AS DOUBLE) AS w FROM dim), f AS (SELECT id, r0r AS r, c0c AS c, floor(r0r) AS r0, floor(c0c) AS c0, gone FROM (SELECT id, least(greatest(r, 0.0), h - 1.001) AS r0r, least(greatest(c, 0.0), w - 1.001) AS c0c, r < 0 OR c < 0 OR r > h OR c > w AS gone FROM q, d2)), w AS (SELECT id, r0 + dr AS pr, c0 + dc AS pc, CASE WHEN gone THEN 0.0 ELSE (CASE dr WHEN 1 THEN r - r0 ELSE 1 - (r - r0) END) * (CASE dc WHEN 1 THEN c - c0 ELSE 1 - (c - c0) END) END AS wt FROM f, (VALUES (0), (1)) x(dr), (VALUES (0), (1)) y(dc))
SELECT id, round(sum(wt * coalesce(px.z, 0)), 5) AS z FROM w LEFT JOIN px ON px.r = w.pr AND px.c = w.pc GROUP BY id""")
def sampled_heights(spark, sf_dir):
    """JON17, QRY4, RAS4: bilinear samples of the tiles at points."""
    p = spark.sql(POINTS.replace("FROM events", "FROM {e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))
    t = tiles(spark, sf_dir)
    size = t.agg(F.max("tile_row").alias("r"), F.max("tile_col").alias("c")).first()
    return raster.bilinear(p, t, 8, 8 * ((size.r or 0) + 1), 8 * ((size.c or 0) + 1)).select("id", F.round("z", 5).alias("z"))


def grid_size(t):
    size = t.agg(F.max("tile_row").alias("r"), F.max("tile_col").alias("c")).first()
    return (size.r or 0) + 1, (size.c or 0) + 1


@query(TILES + """, q AS (SELECT user_id AS way, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos, CAST(event_id * 7919 % 17000 AS DOUBLE) / 100 - 5 AS r, CAST(event_id * 6101 % 21000 AS DOUBLE) / 100 - 5 AS c FROM events),
f AS (SELECT way, pos, least(greatest(r, 0.0), CAST(h AS DOUBLE) - 1.001) AS r, least(greatest(c, 0.0), CAST(w AS DOUBLE) - 1.001) AS c FROM q, dim),
w AS (SELECT way, pos, floor(r) + dr AS pr, floor(c) + dc AS pc, (CASE dr WHEN 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) * (CASE dc WHEN 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS wt FROM f, (VALUES (0), (1)) x(dr), (VALUES (0), (1)) y(dc)),
z AS (SELECT way, pos, 100 * sum(wt * coalesce(px.z, 0)) AS cm FROM w LEFT JOIN px ON px.r = w.pr AND px.c = w.pc GROUP BY way, pos),
d AS (SELECT *, cm - lag(cm) OVER (PARTITION BY way ORDER BY pos) AS step FROM z)
SELECT way, pos, round(cm, 3) AS cm, round(coalesce(greatest(step, 0.0), 0.0), 3) AS up, round(coalesce(greatest(-step, 0.0), 0.0), 3) AS down FROM d""")
def height_profiles(spark, sf_dir):
    """QRY4, JON17, WIN2: heights in cm along ordered points, some off the grid, with climbs and falls."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = e.select(F.col("user_id").alias("way"), F.row_number().over(order).cast("long").alias("pos"), (F.col("event_id") * 7919 % 17000 / 100 - 5).alias("r"), (F.col("event_id") * 6101 % 21000 / 100 - 5).alias("c"))
    t = tiles(spark, sf_dir)
    rows, cols = grid_size(t)
    found = raster.height_profile(p, t, 8, 8 * rows, 8 * cols, "way")
    return found.select("way", "pos", *[F.round(c, 3).alias(c) for c in ("cm", "up", "down")])


@query(TILES + """, g AS (SELECT c_custkey AS region, c_custkey * 7919 % 16000 / 100.0 - 4 AS r0, c_custkey * 6101 % 20000 / 100.0 - 4 AS c0, 0.5 + c_custkey % 5 * 0.6 AS dr, 0.75 + c_custkey % 3 AS dc FROM customer WHERE c_custkey % 3 = 0),
p AS (SELECT region, (i + 1) * 6 + j + 1 AS k, CAST(r0 + i * dr AS DOUBLE) AS r, CAST(c0 + j * dc AS DOUBLE) AS c FROM g, (SELECT unnest(range(-1, 5)) AS i), (SELECT unnest(range(-1, 5)) AS j)),
f AS (SELECT region, k, least(greatest(r, 0.0), CAST(h AS DOUBLE) - 1.001) AS r, least(greatest(c, 0.0), CAST(w AS DOUBLE) - 1.001) AS c, r < 0 OR c < 0 OR r > h OR c > w AS gone FROM p, dim),
w AS (SELECT region, k, floor(r) + dr AS pr, floor(c) + dc AS pc, CASE WHEN gone THEN 0.0 ELSE (CASE dr WHEN 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END) * (CASE dc WHEN 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) END AS wt FROM f, (VALUES (0), (1)) x(dr), (VALUES (0), (1)) y(dc))
SELECT region, CAST(k AS INTEGER) AS k, round(sum(wt * coalesce(px.z, 0)), 5) AS z FROM w LEFT JOIN px ON px.r = w.pr AND px.c = w.pc GROUP BY region, k""")
def region_heights(spark, sf_dir):
    """RAS4: regions of four by four pixels with a margin of one, of several pixel sizes, resampled from the tiles under them; some off the grid."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter(k % 3 == 0)
    regions = c.select(k.alias("region"), (k * 7919 % 16000 / 100.0 - 4).alias("r0"), (k * 6101 % 20000 / 100.0 - 4).alias("c0"), (0.5 + k % 5 * 0.6).alias("dr"), (0.75 + k % 3).alias("dc"))
    t = tiles(spark, sf_dir)
    rows, cols = grid_size(t)
    found = raster.region_windows(regions, t, 8, 8 * rows, 8 * cols, 4)
    return found.select("region", F.posexplode("z").alias("k", "z")).select("region", "k", F.round("z", 5).alias("z"))


WANTED = "(tile_row * 5 + tile_col * 3) % 7 < 3"


@query(TILES + f""", ld AS (SELECT tile_row, tile_col FROM v_tile WHERE {WANTED}), kp AS (SELECT DISTINCT tile_row + i AS tile_row, tile_col + j AS tile_col FROM ld, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), dim WHERE tile_row + i BETWEEN 0 AND h // 8 - 1 AND tile_col + j BETWEEN 0 AND w // 8 - 1),
g AS (SELECT r, c FROM (SELECT unnest(range(0, h)) AS r FROM dim), LATERAL (SELECT unnest(range(0, (SELECT w FROM dim))) AS c)), f AS (SELECT g.r, g.c, CASE WHEN (g.r // 8, g.c // 8) IN (SELECT (tile_row, tile_col) FROM ld) THEN px.z ELSE 0 END AS z FROM g LEFT JOIN px ON px.r = g.r AND px.c = g.c),
k AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * j * j)) FROM (SELECT unnest(range(-4, 5)) AS j)) AS wt FROM (SELECT unnest(range(-4, 5)) AS d)),
a AS (SELECT f.r, f.c, CASE WHEN f.r + d < 0 THEN -(f.r + d) - 1 WHEN f.r + d >= h THEN 2 * h - 1 - f.r - d ELSE f.r + d END AS sr, wt FROM f, k, dim),
v AS (SELECT a.r, a.c, sum(wt * f.z) AS z FROM a JOIN f ON f.r = a.sr AND f.c = a.c GROUP BY ALL),
b AS (SELECT v.r, v.c, CASE WHEN v.c + d < 0 THEN -(v.c + d) - 1 WHEN v.c + d >= w THEN 2 * w - 1 - v.c - d ELSE v.c + d END AS sc, wt FROM v, k, dim),
s AS (SELECT b.r, b.c, sum(wt * v.z) AS z FROM b JOIN v ON v.r = b.r AND v.c = b.sc GROUP BY ALL)
SELECT r // 8 AS tile_row, c // 8 AS tile_col, CAST((r % 8) * 8 + c % 8 AS INTEGER) AS i, round(z, 5) AS v FROM s WHERE (r // 8, c // 8) IN (SELECT (tile_row, tile_col) FROM kp)""")
def smoothed_mosaic(spark, sf_dir):
    """RAS2, RAS3: a mosaic of wanted tiles, zeros for their missing neighbours, smoothed."""
    t = tiles(spark, sf_dir)
    rows, cols = grid_size(t)
    return pixels(raster.smooth(raster.mosaic(t, t.filter(WANTED), 8, rows, cols), 8, rows, cols))


@query(TILES + """, iv AS (SELECT r // 64 AS rr, c // 64 AS rc, r % 64 AS r, c % 64 AS c, CAST(least(greatest(floor((z + 0.4) * 300), 0), 255) AS BIGINT) AS v FROM px),
lf AS (SELECT unnest([1, 2, 3]) AS level, unnest([2, 4, 8]) AS f), ox AS (SELECT level, f, unnest(range(0, 64 // f)) AS o FROM lf),
wx AS (SELECT level, o, x, CASE WHEN abs((x + 0.5 - (o + 0.5) * f) / f) >= 3 THEN 0.0 WHEN x + 0.5 = (o + 0.5) * f THEN 1.0 ELSE sin(pi() * (x + 0.5 - (o + 0.5) * f) / f) / (pi() * (x + 0.5 - (o + 0.5) * f) / f) * sin(pi() * (x + 0.5 - (o + 0.5) * f) / f / 3) / (pi() * (x + 0.5 - (o + 0.5) * f) / f / 3) END AS w FROM ox, (SELECT unnest(range(0, 64)) AS x) WHERE x >= floor((o + 0.5) * f - 3 * f + 0.5) AND x < floor((o + 0.5) * f + 3 * f + 0.5)),
wn AS (SELECT level, o, x, w / sum(w) OVER (PARTITION BY level, o) * 4194304 AS w FROM wx), wi AS (SELECT level, o, x, CAST(trunc(CASE WHEN w < 0 THEN w - 0.5 ELSE w + 0.5 END) AS BIGINT) AS w FROM wn),
hz AS (SELECT rr, rc, level, r, o AS c, least(greatest(CAST(floor((sum(v * w) + 2097152) / 4194304.0) AS BIGINT), 0), 255) AS v FROM iv JOIN wi ON wi.x = iv.c GROUP BY rr, rc, level, r, o),
vt AS (SELECT rr, rc, hz.level, o AS r, c, least(greatest(CAST(floor((sum(v * w) + 2097152) / 4194304.0) AS BIGINT), 0), 255) AS v FROM hz JOIN wi ON wi.level = hz.level AND wi.x = hz.r GROUP BY rr, rc, hz.level, o, c),
kp AS (SELECT DISTINCT level, f, tile_row // f AS tr, tile_col // f AS tc FROM v_tile, lf), ki AS (SELECT *, tr * 8 + i // 8 AS gr, tc * 8 + i % 8 AS gc FROM kp, (SELECT unnest(range(0, 64)) AS i))
SELECT CAST(ki.level AS INTEGER) AS level, tr AS tile_row, tc AS tile_col, CAST(i AS INTEGER) AS i, CAST(coalesce(v, 0) AS INTEGER) AS v FROM ki LEFT JOIN vt ON vt.level = ki.level AND vt.rr = gr // (64 // f) AND vt.r = gr % (64 // f) AND vt.rc = gc // (64 // f) AND vt.c = gc % (64 // f)""")
def filtered_pyramid(spark, sf_dir):
    """RAS8: three levels of regions of eight by eight tiles by the Lanczos filter, in the fixed point of 8-bit images."""
    z = F.transform("z", lambda h: F.least(F.greatest(F.floor((h + 0.4) * 300), F.lit(0)), F.lit(255)).cast("int"))
    found = raster.filtered_levels(tiles(spark, sf_dir).withColumn("z", z), 8)
    return found.select("level", "tile_row", "tile_col", F.posexplode("z").alias("i", "v"))


@query(ctes("v_tile") + """, u AS (SELECT tile_row, tile_col, list_transform(z, lambda h: 6.0 * (CAST(h AS DOUBLE) * 1000 + 1000.0)) AS u FROM v_tile), a AS (SELECT *, CAST(floor(list_min(u)) AS BIGINT) AS a1, CAST(ceil(list_max(u)) AS BIGINT) AS hi FROM u), b AS (SELECT *, least(greatest(65535 // greatest(hi - a1, 1), 1), 255) AS a0 FROM a)
SELECT tile_row, tile_col, a0, a1, CAST(list_sum(list_transform(u, lambda h: round_even((h - a1) * a0, 0))) AS BIGINT) AS total, list_max(u) > 6000.5 AS land FROM b""")
def quantised_tiles(spark, sf_dir):
    """TXT13, AGG19, RAS9: quantised heights by tile with their land flag."""
    t = tiles(spark, sf_dir).withColumn("z", F.transform("z", lambda h: h * 1000)).withColumn("q", raster.quantised(F.col("z")))
    return t.select("tile_row", "tile_col", "q.a0", "q.a1", F.aggregate("q.v", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), (F.array_max(F.transform("z", lambda h: 6.0 * (h + 1000.0))) > 6000.5).alias("land"))


@query(ctes("v_tile") + """ SELECT tile_row, tile_col, CAST(i - 1 AS INTEGER) AS i, CAST(floor(least(greatest(200 * (CASE WHEN cls = 0 THEN 1.0::DOUBLE ELSE least(greatest(1.0 + 0.7 * (1 + CAST(z[i] AS DOUBLE) - 1.0), 0.4), 1.12) END), 0), 255)) AS INTEGER) AS v FROM v_tile, LATERAL (SELECT unnest(range(1, 65)) AS i)""")
def shaded_colours(spark, sf_dir):
    """RAS7: cover colour under clamped shade, water unshaded."""
    t = view(spark, sf_dir, "v_tile").select("tile_row", "tile_col", "cls", F.posexplode("z").alias("i", "h"))
    return t.select("tile_row", "tile_col", "i", raster.shade_colour(F.lit(200.0), 1 + F.col("h").cast("double"), F.col("cls") == 0).alias("v"))


@query("""WITH a AS (SELECT n_nationkey AS id, 80 + n_nationkey % 5 * 40 AS x0, 540 + n_nationkey // 5 * 30 AS y0 FROM nation), t AS (SELECT DISTINCT cx, cy FROM a, LATERAL (SELECT unnest(range(x0 - 2, x0 + 14)) AS cx), LATERAL (SELECT unnest(range(y0 - 2, y0 + 13)) AS cy)),
n AS (SELECT CAST(floor(80 + c_custkey * 7919 % 20000 / 100.0) AS BIGINT) AS cx, CAST(floor(540 + c_custkey * 6101 % 20000 / 100.0) AS BIGINT) AS cy, count(*) AS n FROM customer GROUP BY ALL)
SELECT cx, cy, coalesce(n, 0) AS n FROM t LEFT JOIN n USING (cx, cy)""")
def boundary_tiles(spark, sf_dir):
    """FLT7, GRD10: tiles that areas touch, on their edges and inside, and two around, with the points in each."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    x, y = 80 + F.col("n_nationkey") % 5 * 40, 540 + F.floor(F.col("n_nationkey") / 5) * 30
    corners = F.array(*[F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y")) for dx, dy in ((0.5, 0.5), (11.5, 0.5), (11.5, 10.5), (0.5, 10.5))])
    rings = n.select(F.col("n_nationkey").alias("ring"), F.posexplode(corners).alias("pos", "p")).select(F.lit(1).alias("k"), "ring", "pos", "p.x", "p.y")
    touched = raster.touched_tiles(spatial.ring_edges(rings, ["k"]), 1.0)
    at = lambda low, factor, to: F.floor(low + F.col("c_custkey") * factor % 20000 / 100.0).cast("long").alias(to)
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(at(80, 7919, "cx"), at(540, 6101, "cy")).agg(F.count("*").alias("n"))
    return touched.join(points, ["cx", "cy"], "left").select("cx", "cy", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT c_custkey * 4 + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS chain, c_custkey % 5 <> 0 AS closed, CAST(CASE WHEN c_custkey % 5 = 0 THEN 2000000 ELSE 2000000 END * CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END AS BIGINT) AS twice_area,
CASE WHEN c_custkey % 2 = 0 THEN 'water' ELSE 'land' END AS kind FROM customer""")
def coastline_chains(spark, sf_dir):
    """ASM11: coast ways chained by end nodes; odd parcels run counter-clockwise, every fifth one lacks a side."""
    s = view(spark, sf_dir, "v_parcel_seg").withColumn("way", F.col("area") * 4 + F.col("pos")).filter("NOT (area % 5 = 0 AND pos = 0)")
    swap = F.col("area") % 2 == 0
    at = lambda own, other: F.when(swap, F.col(other)).otherwise(F.col(own))
    s = s.select("area", "way", at("xa", "xb").alias("xa"), at("ya", "yb").alias("ya"), at("xb", "xa").alias("xb"), at("yb", "ya").alias("yb"))
    node = lambda x, y: F.concat_ws(":", "area", x, y)
    return areas.coastlines(s.select("way", node("xa", "ya").alias("first"), node("xb", "yb").alias("last")), s.select("way", "xa", "ya", "xb", "yb"))
