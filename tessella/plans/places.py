"""Addresses, places and search on the address views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grid, rules, text
from ..operators import addresses, places, roads, spatial
from ..sources.fixtures import ctes, view
from .basics import FOLD, KEYS_SQL, X, Y, tagged_ways
from .common import query
from .roads import EDGES, segments


def named_segments(spark, sf_dir, s=None):
    """Road segments with both ends, of the classes 0 to 8, with the name of their way."""
    s = (s or segments(spark, sf_dir)).filter("ax IS NOT NULL").select("way", "edge", "pos", "ax", "ay", F.col("x").alias("bx"), F.col("y").alias("by"))
    return s, tagged_ways(spark, sf_dir).filter(rules.road_class(F.col("tags")).between(0, 8)).select("way", F.col("name_id").alias("name"))


def pieces(spark, sf_dir, s=None):
    """Street pieces of named roads (of all ``segments``): ``piece, pos, t0, name, before, total, ax, ay, bx, by, cx, cy``."""
    s, named = named_segments(spark, sf_dir, s)
    parts = roads.street_pieces(s.join(named.select("way"), "way", "left_semi"), grid.CELL).join(named, "way")
    return parts.withColumn("piece", F.concat_ws(":", F.lpad(F.col("way").cast("string"), 12, "0"), F.lpad(F.col("edge").cast("string"), 5, "0"), F.lpad(F.col("part").cast("string"), 5, "0")))


PIECES = EDGES.replace("WITH ", ctes("v_way") + ", ", 1) + """, g0 AS (SELECT s.way, CAST(edge AS INTEGER) AS edge, pos, w.name_id AS name, ax, ay, s.x AS bx, s.y AS by_ FROM s JOIN v_way w ON w.way = s.way WHERE ax IS NOT NULL AND w.highway IN ('motorway', 'primary', 'residential')),
gx AS (SELECT way, pos, (k * 32768 - ax) / (bx - ax) AS t FROM g0, LATERAL (SELECT unnest(range(CAST(floor(least(ax, bx) / 32768.0) AS BIGINT) + 1, CAST(ceil(greatest(ax, bx) / 32768.0) AS BIGINT))) AS k) WHERE ax <> bx),
gy AS (SELECT way, pos, (k * 32768 - ay) / (by_ - ay) AS t FROM g0, LATERAL (SELECT unnest(range(CAST(floor(least(ay, by_) / 32768.0) AS BIGINT) + 1, CAST(ceil(greatest(ay, by_) / 32768.0) AS BIGINT))) AS k) WHERE ay <> by_),
gt AS (SELECT way, pos, 0.0::DOUBLE AS t FROM g0 UNION SELECT way, pos, 1.0 FROM g0 UNION SELECT * FROM gx UNION SELECT * FROM gy),
gp AS (SELECT way, pos, t AS t0, lead(t) OVER (PARTITION BY way, pos ORDER BY t) AS t1 FROM gt),
gq AS (SELECT g0.way, edge, g0.pos, t0, name, ax + t0 * (bx - ax) AS px, ay + t0 * (by_ - ay) AS py, ax + t1 * (bx - ax) AS qx, ay + t1 * (by_ - ay) AS qy, floor((ax + (t0 + t1) / 2 * (bx - ax)) / 32768) AS cx, floor((ay + (t0 + t1) / 2 * (by_ - ay)) / 32768) AS cy FROM gp JOIN g0 ON g0.way = gp.way AND g0.pos = gp.pos WHERE t1 IS NOT NULL),
gm AS (SELECT *, CASE WHEN lag(cx) OVER w <> cx OR lag(cy) OVER w <> cy THEN 1 ELSE 0 END AS moved FROM gq WINDOW w AS (PARTITION BY way, edge ORDER BY pos, t0)),
gr AS (SELECT *, CAST(sum(moved) OVER (PARTITION BY way, edge ORDER BY pos, t0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS part, sqrt(pow(qx - px, 2) + pow(qy - py, 2)) AS size FROM gm),
pc AS (SELECT *, lpad(CAST(way AS VARCHAR), 12, '0') || ':' || lpad(CAST(edge AS VARCHAR), 5, '0') || ':' || lpad(CAST(part AS VARCHAR), 5, '0') AS piece, coalesce(sum(size) OVER (PARTITION BY way, edge, part ORDER BY pos, t0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_, sum(size) OVER (PARTITION BY way, edge, part) AS total FROM gr)"""


@query(PIECES + " SELECT piece, name, CAST(min(cx) AS BIGINT) AS cx, CAST(min(cy) AS BIGINT) AS cy, count(*) AS parts, round(max(total), 2) AS length FROM pc GROUP BY piece, name")
def street_pieces(spark, sf_dir):
    """ASM13: named roads of the classes 0 to 8 cut at junctions and at cell borders."""
    return pieces(spark, sf_dir).groupBy("piece", "name").agg(F.min("cx").alias("cx"), F.min("cy").alias("cy"), F.count("*").alias("parts"), F.round(F.max("total"), 2).alias("length"))


def numbers(spark, sf_dir):
    a = view(spark, sf_dir, "v_addr").withColumn("n", F.explode(text.house_numbers(F.col("hn"))))
    return a.select("id", "n", F.col("street_id").alias("name"), F.concat(F.lit("City "), F.col("city_id") % 7).alias("city"), grid.unit_x(F.col("lon")).alias("x"), grid.unit_y(F.col("lat")).alias("y"))


NUMBERS = """, hn AS (SELECT id, street_id, city_id, lon, lat, CASE WHEN regexp_matches(hn, '^[0-9]+-[0-9]+$') THEN [CAST(split_part(hn, '-', 1) AS BIGINT), CAST(split_part(hn, '-', 2) AS BIGINT)] WHEN regexp_matches(hn, '^[0-9]+[a-z]?$') THEN [CAST(regexp_extract(hn, '^([0-9]+)', 1) AS BIGINT)] ELSE []::BIGINT[] END AS ns FROM v_addr),
nm AS (SELECT id, unnest(ns) AS n, street_id AS name, """ + f"{X} AS x, {Y} AS y FROM hn)"


MATCHED = PIECES.replace("WITH ", ctes("v_addr") + ", ", 1) + NUMBERS + """, ds AS (SELECT nm.id, nm.n, pc.piece, pc.pos, pc.t0, pc.before_, pc.total, sqrt(pow(nm.x - px - t * dx, 2) + pow(nm.y - py - t * dy, 2)) AS d, t, dx, dy, dx * (nm.y - py) - dy * (nm.x - px) > 0 AS right_side FROM nm JOIN pc ON pc.name = nm.name,
LATERAL (SELECT qx - px AS dx, qy - py AS dy) l, LATERAL (SELECT least(1.0, greatest(0.0, ((nm.x - px) * dx + (nm.y - py) * dy) / greatest(dx * dx + dy * dy, 1e-9))) AS t) m WHERE abs(nm.x - px) < 400000),
mt AS (SELECT *, round(d, 6) AS distance, row_number() OVER (PARTITION BY id, n ORDER BY round(d, 6), piece, pos, t0) AS k FROM ds WHERE round(d, 6) <= 100 / 0.149),
hits AS (SELECT id, n, piece, distance, CASE WHEN total > 0 THEN (before_ + t * sqrt(greatest(dx * dx + dy * dy, 1e-9))) / total ELSE 0.5 END AS t, right_side FROM mt WHERE k = 1)"""


def hits(spark, sf_dir):
    """Segments of the fixture are as long as a cell, so they meet in cells of that size."""
    return addresses.match_numbers(numbers(spark, sf_dir), pieces(spark, sf_dir), grid.CELL)


@query(MATCHED + " SELECT id, n, piece, round(distance, 3) AS distance, round(t, 5) AS t, right_side FROM hits")
def matched_numbers(spark, sf_dir):
    """JON5: each house number's nearest piece of its street within 100 m, where along it and on which side."""
    return hits(spark, sf_dir).select("id", "n", "piece", F.round("distance", 3).alias("distance"), F.round("t", 5).alias("t"), "right_side")


@query("""WITH h AS (SELECT user_id AS piece, event_id % 2 = 0 AS right_side, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS t, CASE WHEN user_id % 3 = 0 THEN event_id * 31 % 30 * 2 + CASE WHEN event_id % 40 < 2 THEN 1 ELSE 0 END ELSE event_id * 31 % 60 END AS n, event_id FROM events),
c AS (SELECT piece, right_side, count(*) AS k, count(*) FILTER (WHERE n % 2 = 0) AS even, count(*) FILTER (WHERE n % 2 = 1) AS odd FROM h GROUP BY ALL),
f AS (SELECT h.*, least(even, odd) > 0.1 * k AS mixed, CASE WHEN least(even, odd) > 0.1 * k OR least(even, odd) = 0 THEN true ELSE n % 2 = CASE WHEN even >= odd THEN 0 ELSE 1 END END AS keep FROM h JOIN c USING (piece, right_side))
SELECT piece, right_side, min(n) AS lo, max(n) AS hi, bool_or(mixed) AS mixed, CASE WHEN count(DISTINCT t) > 1 AND min(n) <> max(n) THEN corr(t, n) >= -1e-12 ELSE true END AS ascending FROM f WHERE keep GROUP BY piece, right_side""")
def side_ranges(spark, sf_dir):
    """AGG11: range, parity and direction of the house numbers on each side of a piece; a third of the pieces have a few stray odd numbers."""
    e = F.col("event_id")
    n = F.when(F.col("user_id") % 3 == 0, e * 31 % 30 * 2 + F.when(e % 40 < 2, 1).otherwise(0)).otherwise(e * 31 % 60)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("piece"), (e % 2 == 0).alias("right_side"), ((e * 7919 % 1000) / 1000.0).alias("t"), n.alias("n"))
    return addresses.side_ranges(rows)


@query(MATCHED + """, c AS (SELECT piece, right_side, count(*) AS k, count(*) FILTER (WHERE n % 2 = 0) AS even, count(*) FILTER (WHERE n % 2 = 1) AS odd FROM hits GROUP BY ALL),
f AS (SELECT hits.*, least(even, odd) > 0.1 * k AS mixed, CASE WHEN least(even, odd) > 0.1 * k OR least(even, odd) = 0 THEN true ELSE n % 2 = CASE WHEN even >= odd THEN 0 ELSE 1 END END AS keep FROM hits JOIN c USING (piece, right_side))
SELECT piece, right_side, min(n) AS lo, max(n) AS hi, bool_or(mixed) AS mixed FROM f WHERE keep GROUP BY piece, right_side""")
def street_ranges(spark, sf_dir):
    """ASM13, JON5, AGG11 together: house-number ranges of street pieces from matched addresses."""
    return addresses.side_ranges(hits(spark, sf_dir)).drop("ascending")


RADII = addresses.SETTLEMENT_METRES


@query(ctes("v_place", "v_addr") + f""", p AS (SELECT id AS place_id, place, name_id, {X} AS px, {Y} AS py, CASE place WHEN 'city' THEN 12000 WHEN 'town' THEN 5000 WHEN 'village' THEN 2000 ELSE 800 END / (2 * pi() * 6371000.0 / 268435456) AS r FROM v_place),
q AS (SELECT id, {X} AS qx, {Y} AS qy FROM v_addr),
m AS (SELECT q.id, p.place_id, p.name_id, p.place, sqrt(pow((px - qx) * cos(radians(90.0 - qy / (268435456.0 / 360.0))), 2) + pow(py - qy, 2)) / r AS score, pow((px - qx) * cos(radians(54)), 2) + pow(py - qy, 2) AS d2, r FROM q, p),
k AS (SELECT *, row_number() OVER (PARTITION BY id, place ORDER BY d2, place_id) AS rk FROM m WHERE d2 <= 1.44 * r * r),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, CASE place WHEN 'city' THEN 0 WHEN 'town' THEN 1 WHEN 'village' THEN 2 ELSE 3 END, rk) AS best FROM k WHERE rk <= 8 AND score < 1)
SELECT id, place_id, round(score, 6) AS score FROM b WHERE best = 1""")
def best_places(spark, sf_dir):
    """JON6: the place with the smallest distance by radius, out of the eight nearest of each type."""
    a = view(spark, sf_dir, "v_addr").select(F.col("id").alias("q"), grid.unit_x(F.col("lon")).alias("x"), grid.unit_y(F.col("lat")).alias("y"))
    p = view(spark, sf_dir, "v_place").select(F.col("id").alias("p"), "place", grid.unit_x(F.col("lon")).alias("x"), grid.unit_y(F.col("lat")).alias("y"))
    best = addresses.best_place(a, p, RADII)
    return best.select(F.col("q").alias("id"), F.col("p").alias("place_id"), F.round("score", 6).alias("score"))


@query(ctes("v_place", "v_addr") + f""", p AS (SELECT id AS place_id, name_id, {X} * cos(radians(54)) AS px, {Y} AS py FROM v_place), q AS (SELECT id, city_id, {X} * cos(radians(54)) AS qx, {Y} AS qy FROM v_addr),
k AS (SELECT q.id, p.place_id, sqrt(pow(px - qx, 2) + pow(py - qy, 2)) * (2 * pi() * 6371000.0 / 268435456) AS d, row_number() OVER (PARTITION BY q.id ORDER BY pow(px - qx, 2) + pow(py - qy, 2), p.place_id) AS r FROM q JOIN p ON p.name_id = q.city_id)
SELECT id, place_id, round(d, 2) AS metres FROM k WHERE r = 1 AND d < 30000""")
def town_anchors(spark, sf_dir):
    """JON7: the nearest place node of a postal town's name, within 30 km."""
    scaled = lambda df, key, name: df.select(F.col("id").alias(key), F.col(name).alias("name"), (grid.unit_x(F.col("lon")) * F.cos(F.radians(F.lit(54.0)))).alias("x"), grid.unit_y(F.col("lat")).alias("y"))
    found = spatial.nearest(scaled(view(spark, sf_dir, "v_addr"), "q", "city_id"), scaled(view(spark, sf_dir, "v_place"), "p", "name_id"), 30000 / grid.METRES_PER_UNIT, 1, ["name"])
    return found.select(F.col("q").alias("id"), F.col("p").alias("place_id"), F.round(F.sqrt("d2") * grid.METRES_PER_UNIT, 2).alias("metres")).filter("metres < 30000")


@query(EDGES.replace("WITH ", ctes("v_way") + ", ", 1) + """, v AS (SELECT name_id AS street, CASE WHEN e.way % 9 < 3 THEN 'Town ' || e.way % 9 || ', Suburb ' || e.way % 2 ELSE 'Town ' || e.way % 9 END AS alt, sum(length + 1) AS weight FROM e JOIN v_way w ON w.way = e.way GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY street ORDER BY weight DESC, alt) AS k, sum(weight) OVER (PARTITION BY street) AS total, contains(alt, ', ') AS sub FROM v),
vq AS (SELECT *, row_number() OVER (PARTITION BY street, sub ORDER BY weight DESC, alt) AS n FROM r WHERE k = 1 OR weight >= 0.1 * total)
SELECT street, alt, CAST(k AS INTEGER) AS k, round(weight, 2) AS weight FROM vq WHERE CASE WHEN sub THEN n = 1 ELSE n <= 12 END""")
def street_places(spark, sf_dir):
    """AGG12: places of a street by length: the first, others with a tenth, at most twelve, one "Town, Suburb"."""
    e = roads.edge_measures(segments(spark, sf_dir)).join(view(spark, sf_dir, "v_way").select("way", "name_id"), "way")
    town = F.concat(F.lit("Town "), (F.col("way") % 9).cast("string"))
    alt = F.when(F.col("way") % 9 < 3, F.concat(town, F.lit(", Suburb "), (F.col("way") % 2).cast("string"))).otherwise(town)
    votes = e.groupBy(F.col("name_id").alias("street"), alt.alias("alt")).agg(F.sum(F.col("length") + 1).alias("weight"))
    return addresses.place_votes(votes, "street", "alt").select("street", "alt", "k", F.round("weight", 2).alias("weight"))


@query(ctes("v_place") + f""", c AS (SELECT name_id AS name, CAST(floor({X} / 131072) AS BIGINT) AS cx, CAST(floor({Y} / 131072) AS BIGINT) AS cy FROM v_place)
SELECT name, string_agg(DISTINCT cx || ':' || cy, ',' ORDER BY cx || ':' || cy) AS cells, count(*) AS n FROM c GROUP BY name""")
def place_results(spark, sf_dir):
    """AGG14, AGG16: results by name with the set of 4 by 4 cells that they reach."""
    c = view(spark, sf_dir, "v_place").select(F.col("name_id").alias("name"), grid.cell(grid.unit_x(F.col("lon")), 4 * grid.CELL).alias("cx"), grid.cell(grid.unit_y(F.col("lat")), 4 * grid.CELL).alias("cy"))
    return c.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "cx", "cy"))), ",").alias("cells"), F.count("*").alias("n"))


@query(ctes("v_addr") + r""", k AS (SELECT *, CASE WHEN regexp_matches(postcode, '^[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}$') THEN regexp_extract(postcode, '^([A-Z]{1,2}[0-9][A-Z0-9]?) ?[0-9][A-Z]{2}$', 1) WHEN regexp_matches(split_part(postcode, ' ', 1), '[0-9]') THEN split_part(postcode, ' ', 1) END AS district FROM v_addr)
SELECT district, count(*) AS n, count(DISTINCT street_id) AS streets, CAST(round_even(avg(lon), 0) AS BIGINT) AS lon, CAST(round_even(avg(lat), 0) AS BIGINT) AS lat FROM k WHERE district IS NOT NULL GROUP BY district""")
def postcode_districts(spark, sf_dir):
    """AGG15: postcode districts with their mean point and streets."""
    a = view(spark, sf_dir, "v_addr").withColumn("district", text.postcode_key(F.col("postcode"))).filter("district IS NOT NULL")
    return a.groupBy("district").agg(F.count("*").alias("n"), F.countDistinct("street_id").alias("streets"), F.rint(F.avg("lon")).cast("long").alias("lon"), F.rint(F.avg("lat")).cast("long").alias("lat"))


@query(ctes("v_name") + KEYS_SQL + ", p AS (SELECT DISTINCT substr(key, 1, n) AS prefix, id FROM k, LATERAL (SELECT unnest(range(1, 4)) AS n) WHERE length(key) >= n) SELECT prefix, count(*) AS results FROM p GROUP BY prefix")
def prefix_counts(spark, sf_dir):
    """AGG17, QRY1: distinct results below every prefix of up to three letters."""
    return addresses.prefix_counts(view(spark, sf_dir, "v_name").select("id", "name"), 3)


@query(ctes("v_name", "v_place") + KEYS_SQL + ", pq AS (SELECT DISTINCT substr(key, 1, 3) AS query FROM k WHERE length(key) >= 3 UNION SELECT DISTINCT key FROM k WHERE length(key) <= 5), h AS (SELECT query, id, bool_or(key = query) AS exact FROM pq JOIN k ON starts_with(key, query) GROUP BY ALL) SELECT query, id, exact FROM h")
def prefix_search(spark, sf_dir):
    """QRY2: batch prefix search for all three-letter prefixes and all whole keys of up to five letters."""
    index = addresses.search_index(view(spark, sf_dir, "v_name").select("id", "name"))
    q = index.filter("length(key) >= 3").select(F.substring("key", 1, 3).alias("query")).unionByName(index.filter("length(key) <= 5").select(F.col("key").alias("query"))).distinct()
    return addresses.prefix_search(index, q)


@query(ctes("v_addr") + """, r AS (SELECT place, name_id, w AS piece, 2 * (w % 40) AS lo, 2 * (w % 40) + 60 AS hi, w % 3 = 0 AS mixed, w % 2 = 0 AS ascending FROM (SELECT o_orderkey AS w, o_custkey % 40 AS name_id, o_custkey % 7 AS place FROM orders)),
n AS (SELECT id, street_id, id % 7 AS place, CASE WHEN id % 13 > 0 THEN id % 120 END AS n FROM v_addr), m AS (SELECT n.id, n.n, r.*, row_number() OVER (PARTITION BY n.id ORDER BY piece) AS k FROM n JOIN r ON r.place = n.place AND r.name_id = n.street_id AND (n.n IS NULL OR n.n BETWEEN lo AND hi AND (mixed OR n.n % 2 = lo % 2)))
SELECT id, piece, round(CASE WHEN n IS NULL THEN 0.5 WHEN ascending THEN (n - lo + 0.5) / (hi - lo + 1) ELSE 1 - (n - lo + 0.5) / (hi - lo + 1) END, 6) AS t FROM m WHERE k = 1""")
def geocoded(spark, sf_dir):
    """QRY3: place, street and number to the first piece whose range holds it, and the place along it."""
    w, c = F.col("o_orderkey"), F.col("o_custkey")
    ranges = spark.read.parquet(f"{sf_dir}/orders.parquet").select((c % 7).alias("place"), (c % 40).alias("street"), w.alias("piece"), (2 * (w % 40)).alias("lo"), (2 * (w % 40) + 60).alias("hi"), (w % 3 == 0).alias("mixed"), (w % 2 == 0).alias("ascending"))
    wanted = view(spark, sf_dir, "v_addr").select("id", (F.col("id") % 7).alias("place"), F.col("street_id").alias("street"), F.when(F.col("id") % 13 > 0, F.col("id") % 120).alias("n"))
    return addresses.geocode(wanted, ranges).select("id", "piece", F.round("t", 6).alias("t"))


@query(ctes("v_addr") + f""", i AS (SELECT id, id % 30 * 2 AS a, id % 30 * 2 + (id % 11 - 5) * 3 AS b, CASE id % 4 WHEN 0 THEN 'even' WHEN 1 THEN 'all' WHEN 2 THEN 'odd' ELSE 'none' END AS kind, {X} AS x, {Y} AS y FROM v_addr),
t AS (SELECT *, CASE kind WHEN 'all' THEN 1 WHEN 'none' THEN NULL ELSE 2 END AS step, abs(b - a) AS span FROM i), f AS (SELECT * FROM t WHERE span > step AND span <= 400 AND span % step = 0),
n AS (SELECT id, a + k * step * CASE WHEN b > a THEN 1 ELSE -1 END AS n, x, y, 150.0 * (k * step) / span AS d FROM f, LATERAL (SELECT unnest(range(1, span // step)) AS k))
SELECT id, n, round(CASE WHEN d <= 50 THEN x + 0.6 * d ELSE x + 30 END, 4) AS x, round(CASE WHEN d <= 50 THEN y + 0.8 * d ELSE y + 40 + (d - 50) END, 4) AS y FROM n""")
def interpolated_numbers(spark, sf_dir):
    """TXT14: the numbers strictly between the ends of an interpolation line, up or down, placed along a line of 50 and 100 units."""
    i = F.col("id")
    a = view(spark, sf_dir, "v_addr").select("id", (i % 30 * 2).alias("a"), (i % 30 * 2 + (i % 11 - 5) * 3).alias("b"), F.element_at(F.array(*map(F.lit, ("even", "all", "odd", "none"))), (i % 4 + 1).cast("int")).alias("kind"), grid.unit_x(F.col("lon")).alias("x"), grid.unit_y(F.col("lat")).alias("y"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    rows = addresses.interpolate(a.select("id", "a", "b", "kind", F.array(at(0, 0), at(30, 40), at(30, 140)).alias("points")))
    return rows.select("id", "n", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(ctes("v_place").replace("WITH", "WITH RECURSIVE", 1) + f""", p AS (SELECT id, name_id, {X} AS x, {Y} AS y FROM v_place), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.name_id = b.name_id AND a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 60000.0 * 60000.0),
r AS (SELECT id AS node, id AS c FROM p UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node), l AS (SELECT node, min(c) AS c FROM r GROUP BY node) SELECT name_id, count(DISTINCT c) AS places FROM l JOIN p ON p.id = l.node GROUP BY name_id""")
def same_name_places(spark, sf_dir):
    """ASM12: groups of places of one name that chains of near ones join."""
    p = view(spark, sf_dir, "v_place").select("id", "name_id", grid.unit_x(F.col("lon")).alias("x"), grid.unit_y(F.col("lat")).alias("y"))
    c = spatial.chained(p, 60000, by=["name_id"])
    return p.join(c.withColumnRenamed("node", "id"), "id").groupBy("name_id").agg(F.countDistinct("component").alias("places"))


@query()
def place_labels(spark, sf_dir):
    """AGG13: names that tell places of one name and region apart: clusters round first points, then the levels with the fewest clashes."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    area = lambda name, of: F.when(of % 5 != 4, F.concat(F.lit(name), of))
    levels = F.array(F.lit(None).cast("string"), area("District ", k % 8), area("Borough ", k % 19), area("Parish ", F.floor(k / 3)))
    name = F.concat(F.lit("Berg "), k % 97, F.when(k % 29 == 0, " (Old)").otherwise(""))
    return places.place_names(c.select(k.alias("id"), name.alias("name"), (k * 7919 % 400000).cast("double").alias("x"), (k * 6101 % 300000).cast("double").alias("y"), F.col("c_mktsegment").alias("region"), levels.alias("levels")))


@query(ctes("v_place", "v_addr") + f""", d AS (SELECT id % 50 AS city_id, CAST(floor({X} / 131072) AS BIGINT) AS cx, CAST(floor({Y} / 131072) AS BIGINT) AS cy FROM v_addr), a AS (SELECT name_id, min({X}) AS px, min({Y}) AS py FROM v_place GROUP BY 1)
SELECT DISTINCT city_id, CAST(round_even(coalesce(px, (cx + 0.5) * 131072), 0) AS BIGINT) AS x, CAST(round_even(coalesce(py, (cy + 0.5) * 131072), 0) AS BIGINT) AS y FROM d LEFT JOIN a ON a.name_id = d.city_id""")
def display_items(spark, sf_dir):
    """AGG23: distinct display items of places; one without a node takes its cell's centre."""
    big = 4 * grid.CELL
    d = view(spark, sf_dir, "v_addr").select((F.col("id") % 50).alias("city_id"), grid.cell(grid.unit_x(F.col("lon")), big).alias("cx"), grid.cell(grid.unit_y(F.col("lat")), big).alias("cy"))
    a = view(spark, sf_dir, "v_place").groupBy(F.col("name_id").alias("city_id")).agg(F.min(grid.unit_x(F.col("lon"))).alias("px"), F.min(grid.unit_y(F.col("lat"))).alias("py"))
    at = lambda p, c: F.rint(F.coalesce(F.col(p), (F.col(c) + 0.5) * big)).cast("long")
    return d.join(a, "city_id", "left").select("city_id", at("px", "cx").alias("x"), at("py", "cy").alias("y")).distinct()
