"""Roads to graph on the way views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grid, rules
from ..operators import entities, lines, roads, spatial
from ..operators.tables import materialize
from ..sources.fixtures import ctes, view
from .basics import HAVERSINE, SEGMENTS, X, Y, tagged_ways, trace_segments
from .common import query

EDGES = ctes("v_way_ref", "v_way_node") + f""", sh AS (SELECT node FROM v_way_ref GROUP BY node HAVING count(*) > 1),
p AS (SELECT r.way, r.pos, r.node, {X} AS x, {Y} AS y, sh.node IS NOT NULL AS shared FROM v_way_ref r JOIN v_way_node n ON n.id = r.node LEFT JOIN sh ON sh.node = r.node),
q AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lag(node) OVER w AS before, lead(node) OVER w IS NULL OR lag(node) OVER w IS NULL OR shared AS cut FROM p WINDOW w AS (PARTITION BY way ORDER BY pos)),
s AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY way ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS edge FROM q),
e AS (SELECT way, CAST(edge AS INTEGER) AS edge, arg_min(before, pos) AS a, arg_max(node, pos) AS b, count(*) AS points, sum({HAVERSINE.replace('bx', 'x').replace('by_', 'y')}) AS length FROM s WHERE edge > 0 GROUP BY way, edge)"""


def segments(spark, sf_dir):
    """The road segments of one build, written once, as edges, nodes and measures all read them."""
    refs = view(spark, sf_dir, "v_way_ref")
    return materialize(roads.road_edges(entities.way_points(refs, view(spark, sf_dir, "v_way_node")), entities.shared_nodes(refs)), "segments")


@query(EDGES + " SELECT way, edge, a, b, points, round(length, 3) AS length FROM e")
def road_edges(spark, sf_dir):
    """AGG2, WIN1, WIN2, AGG5: edges between cuts with their lengths."""
    return roads.edge_measures(segments(spark, sf_dir)).select("way", "edge", "a", "b", "points", F.round("length", 3).alias("length"))


@query(EDGES + """, z AS (SELECT way, edge, CAST(node % 100 - before % 100 AS DOUBLE) AS dz FROM s WHERE edge > 0)
SELECT way, CAST(edge AS INTEGER) AS edge, sum(greatest(dz, 0)) AS ascent, sum(greatest(-dz, 0)) AS descent FROM z GROUP BY way, edge""")
def edge_climbs(spark, sf_dir):
    """AGG5: ascent and descent of edges, with heights of the points given as a table."""
    s = segments(spark, sf_dir)
    return roads.edge_measures(s, s.select("way", "pos", (F.col("node") % 100).cast("double").alias("z"))).select("way", "edge", "ascent", "descent")


NODES = EDGES + """, en AS (SELECT DISTINCT node, x, y FROM s WHERE node IN (SELECT a FROM e UNION SELECT b FROM e)),
g AS (SELECT node, CAST(floor(x / 2 / 65536) AS BIGINT) AS bx, CAST(floor(y / 2 / 65536) AS BIGINT) AS by_, x, y FROM en),
u AS (SELECT node, bx, by_, CAST(floor((x / 2 - bx * 65536) * (65535.0 / 65536)) AS BIGINT) AS u, CAST(floor((y / 2 - by_ * 65536) * (65535.0 / 65536)) AS BIGINT) AS v FROM g),
nd AS (SELECT *, CAST(row_number() OVER (PARTITION BY bx, by_ ORDER BY v, u, node) AS INTEGER) AS number FROM u)"""


def graph(spark, sf_dir):
    s = segments(spark, sf_dir)
    edges = roads.edge_measures(s)
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return edges, roads.graph_nodes(s.join(ends, "node", "left_semi"))


@query(NODES + ' SELECT node, bx, by_ AS "by", u, v, number FROM nd')
def graph_nodes(spark, sf_dir):
    """GRD7, WIN4: graph nodes numbered inside their cells."""
    return graph(spark, sf_dir)[1]


HALF = NODES + """, h AS (SELECT way, edge, a AS node, b AS target, true AS forward FROM e UNION ALL SELECT way, edge, b, a, false FROM e),
hf AS (SELECT h.way, h.edge, h.forward, f.bx, f.by_ AS "by", f.number, t.bx - f.bx AS dx, t.by_ - f.by_ AS dy, t.number AS target_number, h.node FROM h JOIN nd f ON f.node = h.node JOIN nd t ON t.node = h.target WHERE greatest(abs(t.bx - f.bx), abs(t.by_ - f.by_)) <= 63)"""


@query(HALF + ' SELECT way, edge, forward, bx, "by", number, dx, dy, target_number FROM hf')
def half_edges(spark, sf_dir):
    """JON12, FLT8, ASM14: both directions of edges that span at most 63 cells."""
    edges, nodes = graph(spark, sf_dir)
    return roads.half_edges(edges, nodes)


def edge_ends(spark, sf_dir):
    edges, nodes = graph(spark, sf_dir)
    ends = edges.select("way", "edge", F.explode(F.array("a", "b")).alias("node")).join(nodes.select("node", "bx", "by"), "node")
    ways = tagged_ways(spark, sf_dir).withColumn("class", rules.road_class(F.col("tags")))
    ranks = ways.select("way", roads.shed_level(F.col("class"), rules.road_category(F.col("class"), F.col("tags"))).alias("rank"))
    return ends.join(ranks, "way")


ENDS = NODES.replace("WITH ", ctes("v_way") + ", ", 1) + """, ee AS (SELECT x.way, x.edge, x.node, nd.bx, nd.by_ AS "by", CASE w.highway WHEN 'footway' THEN 1 WHEN 'track' THEN 4 END AS rank FROM (SELECT way, edge, a AS node FROM e UNION ALL SELECT way, edge, b FROM e) x JOIN nd USING (node) JOIN v_way w ON w.way = x.way),
l0 AS (SELECT bx, "by", count(*) AS ends, count(DISTINCT node) AS nodes FROM ee GROUP BY ALL)"""


@query(ENDS + ' SELECT bx, "by", ends, nodes FROM l0')
def cell_loads(spark, sf_dir):
    """AGG6: edge ends and nodes of graph cells."""
    return roads.cell_load(edge_ends(spark, sf_dir))


def _shed_sql() -> str:
    """Four rounds: cells at three quarters of the fullest one's load, or more, go up a level."""
    rounds, levels = [], []
    for k in range(1, 5):
        levels.append(f"""SELECT bx, "by", 1 AS up FROM l{k - 1} WHERE ends >= (SELECT m FROM lim)""")
        rounds.append(f"""d{k} AS (SELECT bx, "by", sum(up) AS up FROM ({' UNION ALL '.join(levels)}) GROUP BY ALL), k{k} AS (SELECT * FROM ee WHERE (way, edge) NOT IN (SELECT (way, edge) FROM ee JOIN d{k} USING (bx, "by") WHERE rank <= up)),
l{k} AS (SELECT bx, "by", count(*) AS ends, count(DISTINCT node) AS nodes FROM k{k} GROUP BY ALL)""")
    return ', lim AS (SELECT max(ends) * 3 // 4 AS m FROM l0), ' + ", ".join(rounds) + " SELECT DISTINCT way, edge FROM k4"


@query(ENDS + _shed_sql())
def shed_edges(spark, sf_dir):
    """AGG7: edges left after full cells gave up footways, service roads, paths and tracks, a level a round. Cells of the fixture are
    far from the model's limits, so the limit is three quarters of the fullest cell's load; roads that no level drops may pass it, and stay."""
    ends = materialize(edge_ends(spark, sf_dir), "ends")
    most = roads.cell_load(ends).agg(F.max("ends")).first()[0]
    return roads.shed(ends, most * 3 // 4 if most else 1, most_nodes=1 << 62, strict=False)


TURN_SQL = """WITH h AS (SELECT event_id // 4 AS node, CAST(event_id % 4 AS INTEGER) AS seq, CAST(event_id * 31 % 9 AS INTEGER) AS class, CAST(event_id * 7919 % 3600 AS DOUBLE) / 10 AS heading FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY node) AS n FROM h WHERE class <= 7),
p AS (SELECT a.node, a.seq AS a, b.seq AS c, row_number() OVER (PARTITION BY a.node ORDER BY a.seq, b.seq) - 1 AS j FROM c a JOIN c b ON a.node = b.node AND a.seq <> b.seq WHERE a.n >= 3 AND ((b.heading - a.heading) % 360 + 360) % 360 - 180 > 35)
SELECT node, CAST(sum((a + 8 * c) * CAST(pow(2, 6 * least(j, 4)) AS BIGINT)) AS BIGINT) AS turns FROM p GROUP BY node HAVING count(*) <= 5"""


@query(TURN_SQL)
def left_turns(spark, sf_dir):
    """AGG8: left turns packed by node, four half-edges at each."""
    e = F.col("event_id")
    h = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(e / 4).alias("node"), (e % 4).cast("int").alias("seq"), (e * 31 % 9).cast("int").alias("class"), ((e * 7919 % 3600).cast("double") / 10).alias("heading"))
    return roads.left_turns(h)


NAMES = "SELECT o_custkey % 12 AS cx, o_orderkey % 5 AS cy, concat('Street ', CASE WHEN o_custkey % 3 = 0 THEN 'of ' ELSE '' END, o_custkey % 40) AS name FROM orders"


@query(f"""WITH n AS (SELECT DISTINCT * FROM ({NAMES})) SELECT cx, cy, name, coalesce(4 * CAST(sum(len(string_split(name, ' '))) OVER (PARTITION BY cx, cy ORDER BY lower(name), name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset" FROM n""")
def name_tables(spark, sf_dir):
    """WIN6, AGG18, JON13: name tables of cells with word offsets."""
    n = spark.sql(NAMES.replace("FROM orders", "FROM {o}"), o=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return roads.name_table(n.withColumn("sort_key", F.lower("name")))


@query(ctes("v_trace") + SEGMENTS + """, d AS (SELECT *, bx - ax AS dx, by_ - ay AS dy, (SELECT min(ax) + 8000 FROM g) AS x0, (SELECT min(ax) + 20000 FROM g) AS x1, (SELECT min(ay) + 5000 FROM g) AS y0, (SELECT min(ay) + 15000 FROM g) AS y1 FROM g),
cl AS (SELECT way, pos, greatest(0.0, CASE WHEN dx > 0 THEN (x0 - ax) / dx::DOUBLE WHEN dx < 0 THEN (x1 - ax) / dx::DOUBLE END, CASE WHEN dy > 0 THEN (y0 - ay) / dy::DOUBLE WHEN dy < 0 THEN (y1 - ay) / dy::DOUBLE END) AS t0,
least(1.0, CASE WHEN dx > 0 THEN (x1 - ax) / dx::DOUBLE WHEN dx < 0 THEN (x0 - ax) / dx::DOUBLE END, CASE WHEN dy > 0 THEN (y1 - ay) / dy::DOUBLE WHEN dy < 0 THEN (y0 - ay) / dy::DOUBLE END) AS t1
FROM d WHERE NOT (dx = 0 AND (ax < x0 OR ax > x1)) AND NOT (dy = 0 AND (ay < y0 OR ay > y1))),
k AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(t1) OVER w >= 1 THEN 0 ELSE 1 END AS fresh FROM cl WHERE t0 <= t1 WINDOW w AS (PARTITION BY way ORDER BY pos)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY way ORDER BY pos) AS part FROM k) SELECT way, CAST(part AS BIGINT) AS part, count(*) AS segments, round(sum(t1 - t0), 6) AS share FROM n GROUP BY way, part""")
def clipped_lines(spark, sf_dir):
    """ASM5: traces clipped to a box, parts chained."""
    g = trace_segments(spark, sf_dir)
    low = g.agg(F.min("ax").alias("x"), F.min("ay").alias("y")).first()
    box = [F.lit(v) for v in ((low.x or 0) + 8000, (low.y or 0) + 5000, (low.x or 0) + 20000, (low.y or 0) + 15000)]
    parts = spatial.chain_parts(spatial.clip_segments(g, *box), ["way"])
    return parts.groupBy("way", "part").agg(F.count("*").alias("segments"), F.round(F.sum(F.col("t1") - F.col("t0")), 6).alias("share"))


@query(ctes("v_trace") + SEGMENTS + """, cx AS (SELECT way, pos, (k * 4096 - ax) / (bx - ax)::DOUBLE AS t FROM g, LATERAL (SELECT unnest(range(CAST(floor(least(ax, bx) / 4096.0) AS BIGINT) + 1, CAST(ceil(greatest(ax, bx) / 4096.0) AS BIGINT))) AS k) WHERE ax <> bx),
cy AS (SELECT way, pos, (k * 4096 - ay) / (by_ - ay)::DOUBLE AS t FROM g, LATERAL (SELECT unnest(range(CAST(floor(least(ay, by_) / 4096.0) AS BIGINT) + 1, CAST(ceil(greatest(ay, by_) / 4096.0) AS BIGINT))) AS k) WHERE ay <> by_),
ts AS (SELECT way, pos, 0.0::DOUBLE AS t FROM g UNION SELECT way, pos, 1.0 FROM g UNION SELECT * FROM cx UNION SELECT * FROM cy),
pr AS (SELECT way, pos, t AS t0, lead(t) OVER (PARTITION BY way, pos ORDER BY t) AS t1 FROM ts),
m AS (SELECT way, pos, floor((ax + (t0 + t1) / 2 * (bx - ax)) / 4096) AS cx, floor((ay + (t0 + t1) / 2 * (by_ - ay)) / 4096) AS cy, (t1 - t0) * sqrt(CAST((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS DOUBLE)) AS len FROM pr JOIN g USING (way, pos) WHERE t1 IS NOT NULL)
SELECT CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, round(sum(len), 2) AS length FROM m GROUP BY ALL HAVING sum(len) > 0.001""")
def split_lengths(spark, sf_dir):
    """ASM7, ASM6: traces cut at cell borders, length by cell."""
    parts = spatial.split_at_cells(trace_segments(spark, sf_dir), 4096)
    size = F.sqrt((F.col("qx") - F.col("px")) * (F.col("qx") - F.col("px")) + (F.col("qy") - F.col("py")) * (F.col("qy") - F.col("py")))
    return parts.groupBy("cx", "cy").agg(F.sum(size).alias("s")).filter("s > 0.001").select("cx", "cy", F.round("s", 2).alias("length"))


#: Cells and reach of the boundary here: an eighth of the model's, as the fixture spans a few cells only.
MASK_CELL, MASK_REACH = 4096, 4096.0
MASK = """, nr AS (SELECT n_nationkey AS k, 140930000 + n_nationkey % 5 * 33000 AS x, 25615000 + n_nationkey // 5 * 24000 AS y FROM nation),
rv AS (SELECT k * 2 AS ring, false AS hole, unnest([0, 1, 2]) AS pos, unnest([x, x + 17000, x + 3000]) AS x, unnest([y, y + 6000, y + 17000]) AS y FROM nr UNION ALL SELECT k * 2 + 1, true, unnest([0, 1, 2]), unnest([x + 3000, x + 13000, x + 4000]), unnest([y + 3000, y + 6500, y + 13000]) FROM nr WHERE k % 3 = 0),
re AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w2) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w2) AS y1 FROM rv WINDOW w AS (PARTITION BY ring ORDER BY pos), w2 AS (PARTITION BY ring ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
gc AS (SELECT cx, cy, cx * 4096.0::DOUBLE AS gx, cy * 4096.0::DOUBLE AS gy FROM (SELECT unnest(range(34400, 34450)) AS cx), (SELECT unnest(range(6240, 6290)) AS cy)),
hit AS (SELECT cx, cy FROM gc JOIN re ON least(x, x1) <= gx + 8192 AND greatest(x, x1) >= gx - 4096 AND least(y, y1) <= gy + 8192 AND greatest(y, y1) >= gy - 4096, LATERAL (SELECT unnest(range(0, 2001)) / 2000.0 AS t) u GROUP BY cx, cy
HAVING min(pow(greatest(gx - (x + t * (x1 - x)), x + t * (x1 - x) - gx - 4096, 0), 2) + pow(greatest(gy - (y + t * (y1 - y)), y + t * (y1 - y) - gy - 4096, 0), 2)) <= 4096.0 * 4096.0),
ins AS (SELECT cx, cy, ring, hole FROM gc JOIN re ON (y > gy + 2048) <> (y1 > gy + 2048) AND gx + 2048 < (x1 - x) * (gy + 2048 - y) / (y1 - y)::DOUBLE + x GROUP BY ALL HAVING count(*) % 2 = 1),
mk AS (SELECT cx, cy FROM hit UNION SELECT cx, cy FROM ins GROUP BY cx, cy HAVING bool_or(NOT hole) AND NOT bool_or(hole))"""


def boundary_rings(spark, sf_dir):
    """A triangle for each nation, every third one with a hole."""
    k = F.col("n_nationkey")
    x, y = 140930000 + k % 5 * 33000, 25615000 + F.floor(k / 5) * 24000
    corners = lambda *xy: F.array(*[F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in xy])
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    outer = n.select((k * 2).alias("ring"), F.lit(False).alias("hole"), F.posexplode(corners((0, 0), (17000, 6000), (3000, 17000))).alias("pos", "p"))
    holes = n.filter(k % 3 == 0).select((k * 2 + 1).alias("ring"), F.lit(True).alias("hole"), F.posexplode(corners((3000, 3000), (13000, 6500), (4000, 13000))).alias("pos", "p"))
    return outer.unionByName(holes).select("ring", "hole", "pos", "p.x", "p.y")


@query("WITH " + MASK[2:] + " SELECT cx, cy FROM mk")
def boundary_mask(spark, sf_dir):
    """FLT2, ASM17: cells no farther than a cell from a boundary of several rings with holes. The SQL walks along the edges in small steps."""
    return spatial.buffered_cells(boundary_rings(spark, sf_dir), MASK_CELL, MASK_REACH)


@query(EDGES + MASK + """, t AS (SELECT DISTINCT way, CAST(floor(x / 4096) AS BIGINT) AS cx, CAST(floor(y / 4096) AS BIGINT) AS cy FROM s)
SELECT cx, cy, count(*) AS ways FROM t JOIN mk USING (cx, cy) GROUP BY ALL""")
def masked_cells(spark, sf_dir):
    """FLT2, JON11: ways spread over cells, kept where the boundary with its buffer touches the cell."""
    t = segments(spark, sf_dir).select("way", grid.cell(F.col("x"), MASK_CELL).alias("cx"), grid.cell(F.col("y"), MASK_CELL).alias("cy")).distinct()
    mask = spatial.buffered_cells(boundary_rings(spark, sf_dir), MASK_CELL, MASK_REACH)
    return t.join(mask, ["cx", "cy"], "left_semi").groupBy("cx", "cy").agg(F.count("*").alias("ways"))


@query(ctes("v_tile", "v_trace") + """, b AS (SELECT way, min(event_lon) AS x0, max(event_lon) AS x1, min(event_lat) AS y0, max(event_lat) AS y1 FROM (SELECT way, lon / 10000 % 37 AS event_lon, lat / 10000 % 40 AS event_lat FROM v_trace WHERE pos <= 2) GROUP BY way),
t AS (SELECT tile_col AS cx, tile_row AS cy FROM v_tile WHERE (tile_row + tile_col) % 4 = 0) SELECT way FROM b WHERE EXISTS (SELECT 1 FROM t WHERE floor(x0) <= cx AND cx <= floor(x1) AND floor(y0) <= cy AND cy <= floor(y1))""")
def covered_boxes(spark, sf_dir):
    """FLT6: boxes that overlap a raster tile; the boxes hold the first two points of each trace, tiles are there for a quarter of the grid."""
    t = view(spark, sf_dir, "v_trace").filter("pos <= 2").select("way", (F.col("lon") / 10000 % 37).alias("x"), (F.col("lat") / 10000 % 40).alias("y"))
    boxes = t.groupBy("way").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    there = view(spark, sf_dir, "v_tile").select(F.col("tile_col").alias("cx"), F.col("tile_row").alias("cy")).filter("(cx + cy) % 4 = 0")
    return spatial.boxes_on_cells(boxes, there, "way", 1.0).select("way")


@query(ctes("v_trace") + SEGMENTS + """, bs AS (SELECT way, pos, ax, ay, bx, by_, cx, cy, bx - ax AS dx, by_ - ay AS dy, cx * 4096 - 512 AS x0, (cx + 1) * 4096 + 512 AS x1, cy * 4096 - 512 AS y0, (cy + 1) * 4096 + 512 AS y1 FROM g,
LATERAL (SELECT unnest(range(CAST(floor((least(ax, bx) - 512) / 4096.0) AS BIGINT), CAST(floor((greatest(ax, bx) + 512) / 4096.0) AS BIGINT) + 1)) AS cx) c, LATERAL (SELECT unnest(range(CAST(floor((least(ay, by_) - 512) / 4096.0) AS BIGINT), CAST(floor((greatest(ay, by_) + 512) / 4096.0) AS BIGINT) + 1)) AS cy) d),
cl AS (SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN (x0 - ax) / dx::DOUBLE WHEN dx < 0 THEN (x1 - ax) / dx::DOUBLE END, CASE WHEN dy > 0 THEN (y0 - ay) / dy::DOUBLE WHEN dy < 0 THEN (y1 - ay) / dy::DOUBLE END) AS t0,
least(1.0, CASE WHEN dx > 0 THEN (x1 - ax) / dx::DOUBLE WHEN dx < 0 THEN (x0 - ax) / dx::DOUBLE END, CASE WHEN dy > 0 THEN (y1 - ay) / dy::DOUBLE WHEN dy < 0 THEN (y0 - ay) / dy::DOUBLE END) AS t1
FROM bs WHERE NOT (dx = 0 AND (ax < x0 OR ax > x1)) AND NOT (dy = 0 AND (ay < y0 OR ay > y1))),
fr AS (SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(t1) OVER w >= 1 THEN 0 ELSE 1 END AS fresh FROM cl WHERE t0 <= t1 WINDOW w AS (PARTITION BY way, cx, cy ORDER BY pos)),
pa AS (SELECT *, sum(fresh) OVER (PARTITION BY way, cx, cy ORDER BY pos) AS part FROM fr),
po AS (SELECT way, cx, cy, part, pos * 2 AS o, ax + t0 * dx AS x, ay + t0 * dy AS y FROM pa WHERE fresh = 1 UNION ALL SELECT way, cx, cy, part, pos * 2 + 1, ax + t1 * dx, ay + t1 * dy FROM pa),
wd AS (SELECT way, cx, cy, part, o, (CAST(round_even(y - cy * 4096, 0) AS BIGINT) + 512) * 65536 + CAST(round_even(x - cx * 4096, 0) AS BIGINT) + 512 AS word FROM po),
dd AS (SELECT *, lag(word) OVER (PARTITION BY way, cx, cy, part ORDER BY o) AS last FROM wd)
SELECT way, cx, cy, CAST(part AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n, CAST(sum(word) AS BIGINT) AS total, arg_min(word, o) AS first, arg_max(word, o) AS last FROM dd WHERE last IS NULL OR last <> word GROUP BY way, cx, cy, part HAVING count(*) >= 2""")
def placed_traces(spark, sf_dir):
    """ASM6, GRD6, GRD9: traces cut into cells with a margin of 512 units, as packed points of each cell and part."""
    p = spatial.placed_lines(trace_segments(spark, sf_dir), ["way"], 4096, grid.MARGIN)
    total = F.aggregate("points", F.lit(0).cast("long"), lambda s, v: s + v)
    return p.select("way", "cx", "cy", "part", F.size("points").alias("n"), total.alias("total"), F.element_at("points", 1).alias("first"), F.element_at("points", -1).alias("last"))


@query(EDGES + """, pe AS (SELECT way % 20 AS cell, node, min(way * 100000 + edge * 2 + side) AS seq FROM (SELECT way, edge, a AS node, 0 AS side FROM e UNION ALL SELECT way, edge, b, 1 FROM e) GROUP BY ALL)
SELECT cell, node, CAST(row_number() OVER (PARTITION BY cell ORDER BY seq) AS INTEGER) AS number FROM pe""")
def piece_end_numbers(spark, sf_dir):
    """WIN5: ends of street pieces numbered in a cell by first appearance."""
    e = roads.edge_measures(segments(spark, sf_dir))
    ends = e.select("way", "edge", F.posexplode(F.array("a", "b")).alias("side", "node"))
    first = ends.groupBy((F.col("way") % 20).alias("cell"), "node").agg(F.min(F.col("way") * 100000 + F.col("edge") * 2 + F.col("side")).alias("seq"))
    return first.select("cell", "node", F.row_number().over(Window.partitionBy("cell").orderBy("seq")).alias("number"))


#: Deviation that overview lines may have here, in map units: segments of the fixture are long.
OVERVIEW_TOLERANCE = 16384.0

OVERVIEW = EDGES.replace("WITH ", "WITH RECURSIVE " + ctes("v_way")[5:] + ", ", 1) + f""", oe AS (SELECT CASE highway WHEN 'motorway' THEN 0 ELSE 2 END AS class, s.way, pos, before AS a, node AS b FROM s JOIN v_way w ON w.way = s.way WHERE before IS NOT NULL AND highway IN ('motorway', 'primary')),
dt AS (SELECT (class, way, pos) AS id, true AS ahead, a AS tail, b AS head, class FROM oe UNION ALL SELECT (class, way, pos), false, b, a, class FROM oe),
lv AS (SELECT class, tail AS node, min((id, ahead)) AS p, max((id, ahead)) AS q FROM dt GROUP BY ALL HAVING count(*) = 2),
jt AS (SELECT class, node, p[1] AS p, p[2] AS pa, q[1] AS q, q[2] AS qa FROM (SELECT class, node, row(p[1], p[2]) AS p, row(q[1], q[2]) AS q FROM lv) WHERE p[1] <> q[1]),
nx AS (SELECT dt.*, CASE WHEN jt.p = dt.id THEN jt.q ELSE jt.p END AS nid, CASE WHEN jt.p = dt.id THEN jt.qa ELSE jt.pa END AS na FROM dt LEFT JOIN jt ON jt.class = dt.class AND jt.node = dt.head),
wk AS (SELECT id AS sid, ahead AS sa, tail AS st, id, ahead, 0 AS k FROM nx WHERE (id, ahead) NOT IN (SELECT (nid, na) FROM nx WHERE nid IS NOT NULL) UNION ALL SELECT sid, sa, st, nx.nid, nx.na, k + 1 FROM wk JOIN nx ON nx.id = wk.id AND nx.ahead = wk.ahead WHERE nx.nid IS NOT NULL),
rg AS (SELECT id AS sid, ahead AS sa, tail AS st, id, ahead, 0 AS k FROM nx WHERE id NOT IN (SELECT id FROM wk) UNION ALL SELECT sid, sa, st, nx.nid, nx.na, k + 1 FROM rg JOIN nx ON nx.id = rg.id AND nx.ahead = rg.ahead WHERE NOT (nx.nid = sid AND nx.na = sa)),
ls AS (SELECT * FROM wk UNION ALL SELECT rg.* FROM rg JOIN (SELECT sid, sa FROM (SELECT a.sid, a.sa, row_number() OVER (PARTITION BY a.sid[1], c.low ORDER BY a.st, (a.sid, a.sa)) AS o FROM (SELECT DISTINCT sid, sa, st FROM rg) a JOIN (SELECT sid, sa, min(x.tail) AS low FROM rg JOIN nx x USING (id, ahead) GROUP BY ALL) c USING (sid, sa)) WHERE o = 1) USING (sid, sa)),
ed AS (SELECT sid, sa, arg_max(id, k) AS lid, arg_max(ahead, k) AS la FROM ls GROUP BY ALL),
tk AS (SELECT ed.sid, ed.sa FROM ed JOIN nx f ON f.id = ed.sid AND f.ahead = ed.sa JOIN nx l ON l.id = ed.lid AND l.ahead = ed.la WHERE (f.tail, ed.sid, ed.sa) <= (l.head, ed.lid, NOT ed.la) OR ed.sid IN (SELECT id FROM rg)),
on_ AS (SELECT ls.sid, k, id, ahead FROM ls JOIN tk USING (sid, sa)),
pn AS (SELECT sid, 0 AS pos, tail AS node FROM on_ JOIN nx USING (id, ahead) WHERE k = 0 UNION ALL SELECT sid, k + 1, head FROM on_ JOIN nx USING (id, ahead)),
pt AS MATERIALIZED (SELECT sid, pos, pn.node, x, y FROM pn JOIN (SELECT node, min(x) AS x, min(y) AS y FROM s GROUP BY node) n ON n.node = pn.node),
sp AS (SELECT sid, 0 AS a, CAST(max(pos) AS INTEGER) AS b FROM pt GROUP BY sid UNION ALL SELECT sid, unnest([a, p]), unnest([p, b]) FROM (
SELECT sp.sid, sp.a, sp.b, CAST(arg_max(m.pos, (round(@far, 6), -m.pos)) AS INTEGER) AS p, max(@far) AS d FROM sp JOIN pt f ON f.sid = sp.sid AND f.pos = sp.a JOIN pt l ON l.sid = sp.sid AND l.pos = sp.b JOIN pt m ON m.sid = sp.sid AND m.pos > sp.a AND m.pos < sp.b GROUP BY ALL HAVING max(@far) > {OVERVIEW_TOLERANCE}) u)
SELECT sid[1] AS class, sid[1] || ':' || sid[2] || ':' || sid[3] AS chain, 0 AS line, CAST(pos AS INTEGER) AS pos, node, x, y FROM pt WHERE (sid, pos) IN (SELECT (sid, a) FROM sp UNION SELECT (sid, b) FROM sp)"""
_T = "CASE WHEN pow(l.x - f.x, 2) + pow(l.y - f.y, 2) > 0 THEN least(1.0, greatest(0.0, ((m.x - f.x) * (l.x - f.x) + (m.y - f.y) * (l.y - f.y)) / (pow(l.x - f.x, 2) + pow(l.y - f.y, 2)))) ELSE 0.0 END"
OVERVIEW = OVERVIEW.replace("@far", f"sqrt(pow(m.x - f.x - {_T} * (l.x - f.x), 2) + pow(m.y - f.y - {_T} * (l.y - f.y), 2))")


@query(OVERVIEW)
def overview_lines(spark, sf_dir):
    """ASM10: roads of the classes 0 to 3, class by class, joined through nodes of degree two with all their points, and simplified."""
    s = segments(spark, sf_dir)
    ways = tagged_ways(spark, sf_dir).select("way", rules.road_class(F.col("tags")).alias("class")).filter("class BETWEEN 0 AND 3")
    before = F.lag("node").over(Window.partitionBy("way").orderBy("pos"))
    e = s.withColumn("a", before).filter("a IS NOT NULL").select("way", F.col("pos").alias("edge"), "a", F.col("node").alias("b")).join(ways, "way")
    return lines.simplified_chains(e, s.select("node", "x", "y").distinct(), OVERVIEW_TOLERANCE)
