"""Entity joins: relations to ways to nodes, candidates, spatial neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import entities, places, spatial
from ..sources.fixtures import ctes, rows_of, view
from .common import query


@query(ctes("v_member") + "SELECT DISTINCT rel, way FROM v_member")
def relation_ways(spark, sf_dir):
    """JON1, SET2: distinct way members of relations, roles ignored."""
    m = view(spark, sf_dir, "v_member")
    both = F.array(F.struct(F.lit("way").alias("type"), F.col("way").alias("ref"), F.lit("forward").alias("role")), F.struct(F.lit("way").alias("type"), F.col("way").alias("ref"), F.lit("").alias("role")), F.struct(F.lit("node").alias("type"), F.col("way").alias("ref"), F.lit("stop").alias("role")))
    relations = m.groupBy(F.col("rel").alias("id")).agg(F.flatten(F.collect_list(both)).alias("members"))
    return entities.member_ways(relations)


NODE_CTE = ctes("v_way_ref", "v_way_node")


def points(spark, sf_dir, missing="drop_point"):
    """The points of the ways of the fixture."""
    return entities.way_points(view(spark, sf_dir, "v_way_ref"), view(spark, sf_dir, "v_way_node"), missing, rows_of(spark, sf_dir, "lineitem"))


@query(NODE_CTE + "SELECT way, count(*) AS points, sum(lon) AS lon, sum(lat) AS lat FROM v_way_ref r JOIN v_way_node n ON n.id = r.node GROUP BY way")
def way_points_dropped(spark, sf_dir):
    """JON2: coordinates of way points, missing nodes dropped."""
    p = points(spark, sf_dir)
    return p.groupBy("way").agg(F.count("*").alias("points"), F.sum("lon").alias("lon"), F.sum("lat").alias("lat"))


@query(NODE_CTE + "SELECT way, count(*) AS points FROM v_way_ref r LEFT JOIN v_way_node n ON n.id = r.node GROUP BY way HAVING count(*) = count(n.lon)")
def way_points_whole(spark, sf_dir):
    """JON2: ways with every node, others dropped."""
    return points(spark, sf_dir, "drop_way").groupBy("way").agg(F.count("*").alias("points"))


@query(NODE_CTE + "SELECT way, count(*) - count(n.lon) AS missing, CAST(sum(lon) AS DOUBLE) / count(n.lon) AS lon FROM v_way_ref r LEFT JOIN v_way_node n ON n.id = r.node GROUP BY way")
def way_means(spark, sf_dir):
    """JON2, ASM15: mean position of the nodes that are there."""
    p = points(spark, sf_dir, "keep")
    return p.groupBy("way").agg((F.count("*") - F.count("lon")).alias("missing"), (F.sum("lon").cast("double") / F.when(F.count("lon") > 0, F.count("lon"))).alias("lon"))


@query(NODE_CTE + "SELECT way, string_agg(lon || ' ' || lat, ',' ORDER BY pos) AS line FROM v_way_ref r JOIN v_way_node n ON n.id = r.node GROUP BY way")
def way_geometry(spark, sf_dir):
    """AGG1: geometry of ways in reference order."""
    lines = entities.way_lines(points(spark, sf_dir))
    return lines.select("way", F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p.getField("lon"), p.getField("lat"))), ",").alias("line"))


@query(ctes("v_way_ref") + "SELECT node, count(*) AS uses FROM v_way_ref GROUP BY node HAVING count(*) > 1")
def shared_nodes(spark, sf_dir):
    """AGG2: nodes used more than once."""
    return entities.shared_nodes(view(spark, sf_dir, "v_way_ref"))


@query(ctes("v_way_ref", "v_addr") + """, e AS (SELECT way, min(pos) AS p0, max(pos) AS p1 FROM v_way_ref GROUP BY way)
SELECT r.way, r.pos, a.hn FROM v_way_ref r JOIN e ON e.way = r.way AND (r.pos = p0 OR r.pos = p1) JOIN v_addr a ON a.id = r.node // 100""")
def interpolation_ends(spark, sf_dir):
    """JON4: house numbers at both ends of interpolation ways (a hundred nodes of the fixture share an address)."""
    refs, addresses = view(spark, sf_dir, "v_way_ref"), view(spark, sf_dir, "v_addr")
    ends = refs.groupBy("way").agg(F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    return refs.join(ends, "way").filter("pos = p0 OR pos = p1").withColumn("id", F.floor(F.col("node") / 100)).join(addresses.select("id", "hn"), "id").select("way", "pos", "hn")


@query(ctes("v_node", "v_way_ref", "v_way_node", "v_member") + """, w AS (SELECT way, avg(lon) AS lon, avg(lat) AS lat FROM v_way_ref r JOIN v_way_node n ON n.id = r.node GROUP BY way)
SELECT 'n' AS kind, count(*) AS n, sum(lon) // 1000 AS lon FROM v_node UNION ALL SELECT 'w', count(*), CAST(floor(sum(round_even(lon, 0)) / 1000) AS BIGINT) FROM w
UNION ALL SELECT 'r', count(*), CAST(floor(sum(lon) / 1000) AS BIGINT) FROM (SELECT rel, round_even(avg(round_even(lon, 0)), 0) AS lon FROM v_member JOIN w USING (way) GROUP BY rel)""")
def candidates(spark, sf_dir):
    """SET1, ASM15, SNK4: candidates from nodes, ways and relations, with counts by kind."""
    nodes = view(spark, sf_dir, "v_node").select(F.lit("n").alias("kind"), F.col("lon").cast("double").alias("lon"))
    ways = points(spark, sf_dir).groupBy("way").agg(F.rint(F.avg("lon")).alias("lon"))
    relations = view(spark, sf_dir, "v_member").join(ways, "way").groupBy("rel").agg(F.rint(F.avg("lon")).alias("lon"))
    both = nodes.unionByName(ways.select(F.lit("w").alias("kind"), "lon")).unionByName(relations.select(F.lit("r").alias("kind"), "lon"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.floor(F.sum("lon") / 1000).cast("long").alias("lon"))


@query(ctes("v_node_dense") + ", p AS (SELECT id, lon AS x, lat AS y FROM v_node_dense) SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND abs(a.x - b.x) <= 800 AND abs(a.y - b.y) <= 800 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 640000")
def close_pairs(spark, sf_dir):
    """JON8: all pairs of points within a radius."""
    p = view(spark, sf_dir, "v_node_dense").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.close_pairs(p, 800)


CLUSTERS = ctes("v_node_dense").replace("WITH", "WITH RECURSIVE", 1) + """, p AS (SELECT id, lon AS x, lat AS y, typ, name_id FROM v_node_dense),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.typ = b.typ AND a.name_id = b.name_id AND a.id <> b.id AND abs(a.x - b.x) <= 1500 AND abs(a.y - b.y) <= 1500),
r AS (SELECT id AS node, id AS c FROM p UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)"""


@query(CLUSTERS + " SELECT node, min(c) AS component FROM r GROUP BY node")
def point_components(spark, sf_dir):
    """ASM12: connected components of close points of one type and name."""
    p = view(spark, sf_dir, "v_node_dense").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "typ", "name_id")
    return spatial.chained(p, 1500, by=["typ", "name_id"], metric="box")


@query(ctes("v_node_dense").replace("WITH", "WITH RECURSIVE", 1) + """, q AS (SELECT id, lon AS x, lat AS y, typ, name_id, row_number() OVER (PARTITION BY typ, name_id ORDER BY id) AS n FROM v_node_dense WHERE name_id > 0),
g AS (SELECT typ, name_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, x BIGINT, y BIGINT)[]) AS kept FROM (SELECT DISTINCT typ, name_id FROM q)
UNION ALL SELECT g.typ, g.name_id, q.n, CASE WHEN len(list_filter(kept, lambda k: abs(k.x - q.x) < 1500 AND abs(k.y - q.y) < 1500)) > 0 THEN kept ELSE list_append(kept, {'id': q.id, 'x': q.x, 'y': q.y}) END FROM g JOIN q ON q.typ = g.typ AND q.name_id = g.name_id AND q.n = g.n + 1),
l AS (SELECT arg_max(kept, n) AS kept FROM g GROUP BY typ, name_id)
SELECT id FROM v_node_dense WHERE name_id = 0 UNION ALL SELECT k.id FROM (SELECT unnest(kept) AS k FROM l)""")
def greedy_deduplication(spark, sf_dir):
    """WIN7: drop a point near an earlier kept one of its type and name; unnamed points stay."""
    p = view(spark, sf_dir, "v_node_dense").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), "typ", F.when(F.col("name_id") > 0, F.col("name_id").cast("string")).alias("name"))
    return places.drop_repeats(p, 1500, ["typ", "name"], name="name").select("id")


@query(ctes("v_node", "v_admin") + "SELECT a.id AS area, count(*) AS n, min(v.id) AS first_id FROM v_node v JOIN v_admin a ON v.lon > a.x0 AND v.lon < a.x1 AND v.lat > a.y0 AND v.lat < a.y1 GROUP BY a.id")
def points_in_areas(spark, sf_dir):
    """JON9, ASM16, FLT1: points and the areas around them (inner cells at once, border cells by crossing count)."""
    n = view(spark, sf_dir, "v_node").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    a = view(spark, sf_dir, "v_admin")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rings = a.select(F.col("id").alias("area"), F.posexplode(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))).alias("pos", "p")).select("area", F.lit(0).alias("ring"), "pos", "p.x", "p.y")
    hits = spatial.containing_areas(n, spatial.ring_edges(rings, ["area"]), ["id"], ["area"], 1_000_000, border=False)
    return hits.groupBy("area").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(ctes("v_node") + ", c AS (SELECT user_id % 7 AS street, v AS value, count(*) AS n, min(id) AS seq FROM v_node WHERE v IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY street ORDER BY n DESC, seq) AS k FROM c) SELECT street, value, n FROM r WHERE k = 1")
def most_common_values(spark, sf_dir):
    """AGG9: the most common value of each group, ties to the one first seen."""
    c = view(spark, sf_dir, "v_node").filter("v IS NOT NULL").groupBy((F.col("user_id") % 7).alias("street"), F.col("v").alias("value")).agg(F.count("*").alias("n"), F.min("id").alias("seq"))
    return entities.most_common(c, ["street"], "value")


@query(ctes("v_node") + ", c AS (SELECT user_id AS street, CAST(floor(sqrt(name_id)) AS BIGINT) AS name_id, count(*) AS n, min(id) AS seq FROM v_node GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY street ORDER BY n DESC, seq) AS k, sum(n) OVER (PARTITION BY street) AS total FROM c) SELECT street, name_id, n FROM r WHERE k <= 3 AND n >= 0.25 * total")
def top_shares(spark, sf_dir):
    """AGG10, SRT3: up to three values of a group with a least share."""
    c = view(spark, sf_dir, "v_node").groupBy(F.col("user_id").alias("street"), F.floor(F.sqrt("name_id")).cast("long").alias("name_id")).agg(F.count("*").alias("n"), F.min("id").alias("seq"))
    return entities.top_shares(c, ["street"]).select("street", "name_id", "n")
