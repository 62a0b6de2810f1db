"""Grid, tag and text operators applied to the map views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grid, rules, seamarks, text
from ..operators import entities, spatial
from ..sources.fixtures import ctes, view
from .common import query

#: Boundary in degrees: an outer ring and a hole.
BOUNDARY = (("outer", False, ((8.5, 54.5), (11.5, 54.2), (12.0, 56.0), (10.5, 57.0), (8.2, 56.2))), ("hole", True, ((9.8, 55.2), (10.4, 55.2), (10.4, 55.8), (9.8, 55.8))))
X = "((lon / 1e7 + 180.0) * (268435456.0 / 360.0))"
Y = "((90.0 - lat / 1e7) * (268435456.0 / 360.0))"


def boundary_rings(spark):
    rows = [(name, hole, i, int(round(lon * 1e7)), int(round(lat * 1e7))) for name, hole, ring in BOUNDARY for i, (lon, lat) in enumerate(ring)]
    return spark.createDataFrame(rows, "ring string, hole boolean, pos int, x bigint, y bigint")


def boundary_sql(ring: int) -> str:
    """Crossing-number test of ``lon, lat`` against one ring."""
    points = [(int(round(a * 1e7)), int(round(b * 1e7))) for a, b in BOUNDARY[ring][2]]
    terms = []
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1]):
        terms.append(f"(CASE WHEN ({y0} > lat) <> ({y1} > lat) AND lon < ({x1} - {x0}) * (lat - {y0}) / ({y1 - y0})::DOUBLE + {x0} THEN 1 ELSE 0 END)" if y0 != y1 else "0")
    return f"(({' + '.join(terms)}) % 2 = 1)"


POI_CASE = "CASE WHEN k = 'amenity' AND v = 'cafe' THEN 2 WHEN k = 'amenity' AND v = 'restaurant' THEN 14 WHEN k = 'shop' AND v = 'supermarket' THEN 17 WHEN k = 'historic' THEN 72 END"


def tagged_nodes(spark, sf_dir):
    nodes = view(spark, sf_dir, "v_node")
    return nodes.withColumn("tags", F.when(F.col("k").isNotNull(), F.create_map("k", "v")))


@query(ctes("v_node") + f""", p AS (SELECT *, {POI_CASE} AS typ FROM v_node)
SELECT CAST(floor(floor({X} / 32768) / 4) AS BIGINT) AS tile_x, CAST(floor(floor({Y} / 32768) / 4) AS BIGINT) AS tile_y, typ, count(*) AS n
FROM p WHERE typ IS NOT NULL AND {boundary_sql(0)} AND NOT {boundary_sql(1)} GROUP BY ALL""")
def poi_tiles(spark, sf_dir):
    """TAG11, FLT1, GRD1, GRD4, SNK1's shape: points of interest inside the boundary per tile and type."""
    nodes = tagged_nodes(spark, sf_dir).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), rules.poi_type(F.col("tags"), F.lit(True)).alias("typ")).filter("typ IS NOT NULL")
    kept = spatial.inside_boundary(nodes, boundary_rings(spark), ["id"], 1_000_000)
    x, y = grid.unit_x(F.col("x")), grid.unit_y(F.col("y"))
    return kept.groupBy(grid.tile(grid.cell(x), 4).alias("tile_x"), grid.tile(grid.cell(y), 4).alias("tile_y"), "typ").agg(F.count("*").alias("n"))


@query(ctes("v_node") + f""", p AS (SELECT id, lon, lat, {X} AS x, {Y} AS y FROM v_node),
c AS (SELECT *, CAST(floor(x / 32768) AS BIGINT) AS cx, CAST(floor(y / 32768) AS BIGINT) AS cy, CAST(floor(x / 2 / 65536) AS BIGINT) AS gx FROM p)
SELECT id, CAST(round_even(x, 0) AS BIGINT) AS ux, CAST(round_even(y, 0) AS BIGINT) AS uy, cx, cy, CAST(floor(cx / 8.0) AS BIGINT) AS tile_x, ((cx % 8) + 8) % 8 * 8 + ((cy % 8) + 8) % 8 AS slot,
       CAST(round_even(y - cy * 32768, 0) AS BIGINT) * 65536 + CAST(round_even(x - cx * 32768, 0) AS BIGINT) AS packed, CAST(floor((x / 2 - gx * 65536) * (65535.0 / 65536)) AS BIGINT) AS graph_u,
       CAST(round_even((x / (268435456.0 / 360.0) - 180.0) * 1e7, 0) AS BIGINT) AS lon_back FROM c""")
def grid_positions(spark, sf_dir):
    """GRD1, GRD3, GRD4, GRD5, GRD7: units, cell, tile, slot and packed positions of nodes."""
    x, y = grid.unit_x(F.col("lon")), grid.unit_y(F.col("lat"))
    n = view(spark, sf_dir, "v_node").select("id", x.alias("x"), y.alias("y")).withColumns({"cx": grid.cell(F.col("x")), "cy": grid.cell(F.col("y")), "gx": grid.cell(F.col("x") / 2, grid.GRAPH_CELL)})
    whole = lambda c: F.rint(c).cast("long")
    return n.select("id", whole(F.col("x")).alias("ux"), whole(F.col("y")).alias("uy"), "cx", "cy", grid.tile(F.col("cx"), 8).alias("tile_x"), grid.slot(F.col("cx"), F.col("cy"), 8).alias("slot"),
                    grid.packed(F.rint(F.col("x") - F.col("cx") * 32768), F.rint(F.col("y") - F.col("cy") * 32768)).alias("packed"), grid.graph_position(F.col("x"), F.col("gx")).alias("graph_u"), whole(grid.to_lon(F.col("x")) * 1e7).alias("lon_back"))


@query(ctes("v_trace") + """, u AS (SELECT way, CAST(round_even((lon / 1e7 + 180.0) * (33554432.0 / 360.0), 0) AS INTEGER) AS x, CAST(round_even((90.0 - lat / 1e7) * (33554432.0 / 360.0), 0) AS INTEGER) AS y FROM v_trace),
b AS (SELECT way, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM u GROUP BY way), s AS (SELECT *, least(x1 - x0, y1 - y0) * 64 AS m FROM b)
SELECT way, x0, x1, y0, y1, CASE WHEN m >= 131072 THEN 9 WHEN m >= 65536 THEN 10 WHEN m >= 32768 THEN 11 WHEN m >= 16384 THEN 12 WHEN m >= 8192 THEN 13 ELSE 14 END AS level FROM s""")
def trace_boxes(spark, sf_dir):
    """GRD2, GRD8: bounding boxes in area units and their detail level (sides scaled by 64 to spread the levels)."""
    b = view(spark, sf_dir, "v_trace").select("way", grid.area_x(F.col("lon")).alias("x"), grid.area_y(F.col("lat")).alias("y")).groupBy("way").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return b.withColumn("level", grid.detail_level((F.col("x1") - F.col("x0")) * 64, (F.col("y1") - F.col("y0")) * 64))


SEGMENTS = f""", t AS (SELECT way, pos, CAST(round_even({X}, 0) AS BIGINT) AS x, CAST(round_even({Y}, 0) AS BIGINT) AS y FROM v_trace),
s AS (SELECT way, pos, lag(x) OVER w AS ax, lag(y) OVER w AS ay, x AS bx, y AS by_ FROM t WINDOW w AS (PARTITION BY way ORDER BY pos)), g AS (SELECT * FROM s WHERE ax IS NOT NULL)"""


def trace_segments(spark, sf_dir):
    """Segments of the traces in whole map units: ``way, pos, ax, ay, bx, by``."""
    t = view(spark, sf_dir, "v_trace").select("way", "pos", F.rint(grid.unit_x(F.col("lon"))).cast("long").alias("x"), F.rint(grid.unit_y(F.col("lat"))).cast("long").alias("y"))
    w = Window.partitionBy("way").orderBy("pos")
    return t.select("way", "pos", F.lag("x").over(w).alias("ax"), F.lag("y").over(w).alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by")).filter("ax IS NOT NULL")


@query(ctes("v_trace") + SEGMENTS + """, c AS (SELECT way, pos, unnest(range(CAST(floor((least(ax, bx) - 512) / 8192.0) AS BIGINT), CAST(floor((greatest(ax, bx) + 512) / 8192.0) AS BIGINT) + 1)) AS cx, ay, by_ FROM g),
d AS (SELECT way, pos, cx, unnest(range(CAST(floor((least(ay, by_) - 512) / 8192.0) AS BIGINT), CAST(floor((greatest(ay, by_) + 512) / 8192.0) AS BIGINT) + 1)) AS cy FROM c)
SELECT cx, cy, count(*) AS segments, count(DISTINCT way) AS ways FROM d GROUP BY ALL""")
def segment_cells(spark, sf_dir):
    """GRD6: cells (8192 units) that segments reach with a margin of 512."""
    c = grid.cells_touched(trace_segments(spark, sf_dir), F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by"), 8192, 512)
    return c.groupBy("cx", "cy").agg(F.count("*").alias("segments"), F.countDistinct("way").alias("ways"))


WAY_TAGS = "highway", "oneway", "surface", "lanes"


def tagged_ways(spark, sf_dir):
    ways = view(spark, sf_dir, "v_way")
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in WAY_TAGS]), lambda e: e.getField("value").isNotNull())
    return ways.withColumn("tags", F.map_from_entries(entries))


@query(ctes("v_way") + """, c AS (SELECT *, CASE highway WHEN 'motorway' THEN 0 WHEN 'primary' THEN 2 WHEN 'residential' THEN 7 WHEN 'footway' THEN 11 ELSE 12 END AS class FROM v_way)
SELECT way, class, CASE class WHEN 0 THEN 18 WHEN 2 THEN 18 WHEN 7 THEN 10 WHEN 11 THEN 16 ELSE 5 END AS category,
       CAST((CASE WHEN surface IS NULL THEN 3 WHEN surface = 'asphalt' THEN 1 ELSE 2 END) * 128 + 512 + (CASE WHEN oneway = 'yes' THEN 2048 ELSE 0 END) + least(7, CAST(lanes AS INTEGER)) * 8192 AS BIGINT) AS flags,
       coalesce(oneway <> '-1', true) AS forward, coalesce(oneway <> 'yes', true) AS backward FROM c""")
def road_tags(spark, sf_dir):
    """TAG1, TAG2, TAG3, TAG4, TAG6: class, category, attribute bits and directions of roads."""
    w = tagged_ways(spark, sf_dir).withColumn("class", rules.road_class(F.col("tags")))
    return w.select("way", "class", rules.road_category(F.col("class"), F.col("tags")).alias("category"), rules.tag_flags(F.col("tags")).alias("flags"),
                    rules.passable(F.col("tags"), F.col("class"))["forward"].alias("forward"), rules.passable(F.col("tags"), F.col("class"))["backward"].alias("backward"))


@query(ctes("v_member") + """SELECT way, bit_or(CAST(CASE WHEN route IN ('bicycle', 'mtb') THEN CASE network WHEN 'lcn' THEN 2 WHEN 'rcn' THEN 4 WHEN 'ncn' THEN 8 ELSE 134217728 END ELSE 262144 END AS BIGINT)) AS flags FROM v_member GROUP BY way""")
def route_flags(spark, sf_dir):
    """TAG5, JON3, AGG3: bits of the route relations of each way."""
    return entities.route_flags(view(spark, sf_dir, "v_member"))


LINE_TAGS = "SELECT c_custkey AS id, c_custkey % 9 AS m, c_name AS name, concat('de ', c_custkey % 3) AS de FROM customer"


@query(f"WITH b AS ({LINE_TAGS})" + """ SELECT id, CASE WHEN m IN (0, 1, 2, 3) THEN 'A3' WHEN m IN (4, 5) THEN 'A4' WHEN m = 6 THEN 'A4' WHEN m = 7 THEN 'A4' END AS kind,
CAST(CASE m WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 10 WHEN 4 THEN 7 WHEN 5 THEN 7 WHEN 6 THEN 8 WHEN 7 THEN 9 END AS INTEGER) AS type,
CASE WHEN m = 4 THEN concat('[DAN', name, '¦GER', de, ']') WHEN m = 5 THEN name WHEN m = 6 THEN '12(leading)' WHEN m = 7 THEN '(fixed_marks)' END AS name FROM b""")
def line_tags(spark, sf_dir):
    """TAG7, TAG8: line kinds and multilingual labels."""
    b = spark.sql(LINE_TAGS.replace("FROM customer", "FROM {c}"), c=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    m = F.col("m")
    lit = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    name = F.col("name")
    tags = (F.when(m == 0, lit("railway", "tram")).when(m == 1, lit("man_made", "pier")).when(m == 2, lit("man_made", "breakwater")).when(m == 3, lit("power", "line"))
            .when(m == 4, lit("waterway", "river", "name", name, "name:de", F.col("de"))).when(m == 5, lit("waterway", "ditch", "name", name))
            .when(m == 6, lit("seamark:type", "navigation_line", "seamark:navigation_line:orientation", "12.5")).when(m == 7, lit("seamark:type", "recommended_track")).otherwise(lit("waterway", "drain")))
    line = rules.line_type(tags)
    return b.select("id", line["kind"].alias("kind"), line["type"].alias("type"), line["name"].alias("name"))


AREA_TAGS = """SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'forest' WHEN 1 THEN 'reservoir' WHEN 2 THEN 'retail' WHEN 3 THEN 'residential' WHEN 4 THEN 'unknown' END AS landuse,
CASE p_partkey % 5 WHEN 0 THEN 'water' WHEN 1 THEN 'heath' WHEN 2 THEN 'wood' WHEN 3 THEN 'coastline' END AS nat, CASE WHEN p_partkey % 3 = 0 THEN 'river' END AS water, CASE WHEN p_partkey % 4 = 0 THEN 'no' END AS area,
CASE p_partkey % 11 WHEN 0 THEN 'building' WHEN 1 THEN 'military' WHEN 2 THEN 'aeroway' WHEN 3 THEN 'tourism' WHEN 4 THEN 'place' WHEN 5 THEN 'boundary' END AS other FROM part"""


@query(f"WITH b AS ({AREA_TAGS})" + """ SELECT id, CASE WHEN landuse IN ('forest', 'retail') THEN 'c5' WHEN landuse = 'residential' THEN 'c3' WHEN landuse = 'reservoir' THEN CASE WHEN water IS NULL THEN 'c6' END
WHEN nat = 'water' THEN CASE WHEN water IS NULL THEN 'c6' END WHEN nat = 'heath' THEN 'c5' END AS array_name,
CAST(CASE WHEN landuse = 'forest' THEN 6 WHEN landuse = 'retail' THEN 1 WHEN landuse IN ('residential', 'reservoir') THEN NULL WHEN nat = 'heath' THEN 6 END AS INTEGER) AS class,
CASE WHEN nat = 'water' THEN 'water' WHEN nat = 'heath' THEN 'heath' WHEN nat = 'wood' THEN 'forest' WHEN landuse = 'forest' THEN 'forest' WHEN landuse = 'reservoir' THEN 'water' WHEN landuse IN ('retail', 'residential') THEN 'urban' END AS cover,
(landuse IS NOT NULL OR nat IS NOT NULL OR water IS NOT NULL OR coalesce(other IN ('military', 'aeroway', 'tourism'), false)) AND area IS NULL AND nat IS DISTINCT FROM 'coastline' AS keeps FROM b""")
def area_tags(spark, sf_dir):
    """TAG9, TAG10, TAG21: area class, land cover of the first tag in order (natural before land use here), keep rule."""
    b = spark.sql(AREA_TAGS.replace("FROM part", "FROM {p}"), p=spark.read.parquet(f"{sf_dir}/part.parquet"))
    listed = lambda *kv: F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in kv]), lambda t: t.getField("v").isNotNull())
    other = F.when(F.col("other").isNotNull(), F.array(F.struct(F.col("other").alias("k"), F.lit("yes").alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    tags = F.map_from_entries(F.concat(listed(("landuse", "landuse"), ("natural", "nat"), ("water", "water"), ("area", "area")), other))
    found = rules.area_class(tags)
    return b.select("id", found["array"].alias("array_name"), found["class"].alias("class"), rules.cover_class(listed(("natural", "nat"), ("landuse", "landuse"))).alias("cover"), rules.keeps_area(tags).alias("keeps"))


@query(ctes("v_addr") + """SELECT id, concat('00Street ', street_id, ' ', hn, chr(10), postcode, ' City ', city_id, CASE WHEN id % 2 = 0 THEN '|02+45 1' ELSE '' END,
'|03Mo-Fr 08:00-18:00', chr(10), 'Sa 09:00-13:00', CASE WHEN id % 3 = 0 THEN '|74yes' ELSE '' END) AS attributes, id % 5 <> 4 AS is_address FROM v_addr""")
def poi_attributes(spark, sf_dir):
    """TAG12, TAG20: attribute strings by code, and what makes an address."""
    a = view(spark, sf_dir, "v_addr")
    pairs = [("addr:street", F.concat(F.lit("Street "), "street_id")), ("addr:housenumber", F.col("hn")), ("addr:postcode", F.col("postcode")), ("addr:city", F.concat(F.lit("City "), "city_id")),
             ("contact:phone", F.when(F.col("id") % 2 == 0, F.lit("+45 1"))), ("opening_hours", F.lit("Mo-Fr 08:00-18:00; Sa 09:00-13:00")), ("access", F.when(F.col("id") % 3 == 0, F.lit("yes"))), ("website", F.lit(""))]
    tags = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e.getField("value").isNotNull()))
    number = F.create_map(F.when(F.col("id") % 5 == 4, F.lit("name")).otherwise(F.lit("addr:housenumber")), F.col("hn"), F.lit("addr:place"), F.lit("x"))
    return a.select("id", rules.poi_attributes(tags).alias("attributes"), rules.is_address(number).alias("is_address"))


@query("""WITH b AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'multipolygon' WHEN 1 THEN 'boundary' ELSE 'route' END AS type, CAST(c_custkey % 11 AS VARCHAR) AS lvl,
CASE WHEN c_custkey % 4 < 3 THEN 'administrative' END AS boundary, CASE c_custkey % 5 WHEN 0 THEN 'city' WHEN 1 THEN 'farm' WHEN 2 THEN 'plot' END AS place FROM customer)
SELECT id, type <> 'route' AS multipolygon, CAST(CASE WHEN type <> 'route' AND boundary IS NOT NULL AND CAST(lvl AS INTEGER) BETWEEN 4 AND 8 THEN CAST(lvl AS INTEGER) END AS INTEGER) AS level, coalesce(place IN ('city', 'farm'), false) AS is_place FROM b""")
def region_tags(spark, sf_dir):
    """TAG20, TAG22: places, multipolygon relations and the admin levels of regions."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"))
    i = F.col("id")
    pairs = [("type", F.when(i % 3 == 0, "multipolygon").when(i % 3 == 1, "boundary").otherwise("route")), ("admin_level", F.concat(F.lit(" "), (i % 11).cast("string"))), ("name", F.lit("n")),
             ("boundary", F.when(i % 4 < 3, "administrative")), ("place", F.when(i % 5 == 0, "city").when(i % 5 == 1, "farm").when(i % 5 == 2, "plot"))]
    tags = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e.getField("value").isNotNull()))
    return c.select("id", rules.is_multipolygon(tags).alias("multipolygon"), rules.region_level(tags).alias("level"), rules.is_place(tags).alias("is_place"))


@query(ctes("v_addr") + r""", m AS (SELECT id, trim(hn) AS hn FROM v_addr),
e AS (SELECT id, CASE WHEN regexp_matches(hn, '^[0-9]+\s*[A-Za-z]?\s*[-–/]\s*[0-9]+\s*[A-Za-z]?$') THEN [CAST(regexp_extract(hn, '^([0-9]+)', 1) AS BIGINT), CAST(regexp_extract(hn, '[-–/]\s*([0-9]+)', 1) AS BIGINT)]
WHEN regexp_matches(hn, '^[0-9]+\s*[A-Za-z]{0,2}$') THEN [CAST(regexp_extract(hn, '^([0-9]+)', 1) AS BIGINT)] ELSE [] END AS ns FROM m)
SELECT id, unnest(CASE WHEN len(ns) = 0 THEN [NULL::BIGINT] ELSE ns END) AS n FROM e""")
def house_numbers(spark, sf_dir):
    """TXT1: numbers of an address, one row each (null: none)."""
    return view(spark, sf_dir, "v_addr").select("id", F.explode_outer(text.house_numbers(F.col("hn"))).alias("n"))


@query(ctes("v_addr") + r""", k AS (SELECT id, upper(trim(postcode)) AS p FROM v_addr) SELECT id, CASE WHEN regexp_matches(p, '^[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}$') THEN regexp_extract(p, '^([A-Z]{1,2}[0-9][A-Z0-9]?) ?[0-9][A-Z]{2}$', 1)
WHEN regexp_matches(split_part(p, ' ', 1), '^[A-Z0-9-]{1,10}$') AND regexp_matches(split_part(p, ' ', 1), '[0-9]') THEN split_part(p, ' ', 1) END AS district FROM k""")
def postcode_keys(spark, sf_dir):
    """TXT2: what postcodes are searched by."""
    return view(spark, sf_dir, "v_addr").select("id", text.postcode_key(F.col("postcode")).alias("district"))


FOLD = "strip_accents(replace(replace(replace(lower({0}), 'ø', 'o'), 'æ', '{1}'), 'ß', 'ss'))"


@query(ctes("v_name") + f"""SELECT id, {FOLD.format('name', 'a')} AS folded, {FOLD.format('name', 'ae')} AS sort_key, regexp_replace({FOLD.format('name', 'a')}, '[^a-z0-9]', '', 'g') AS loose FROM v_name""")
def name_folds(spark, sf_dir):
    """TXT3, TXT6: search fold, sort key and loose form of names."""
    n = F.col("name")
    return view(spark, sf_dir, "v_name").select("id", text.fold(n).alias("folded"), text.fold(n, "ae").alias("sort_key"), text.loose(n).alias("loose"))


@query(ctes("v_name") + f"""SELECT id, {FOLD.format('name', 'a')} AS folded FROM v_name""")
def name_folds_exact(spark, sf_dir):
    """TXT3: the exact fold (compatibility decomposition), an Arrow UDF."""
    return view(spark, sf_dir, "v_name").select("id", text.fold_exact("name").alias("folded"))


KEYS_SQL = f""", q AS (SELECT id, unnest(string_split(name, ', ')) AS part FROM (SELECT id, regexp_replace(name, '^(.*) \\(.*\\)$', '\\1') AS name FROM v_name)),
w AS (SELECT id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace({FOLD.format('part', 'a')}, '[''’]', '', 'g'), '[^a-z0-9]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM q),
k AS (SELECT DISTINCT id, key FROM (SELECT id, unnest(ws) AS key FROM w UNION ALL SELECT id, array_to_string(ws, ' ') FROM w WHERE len(ws) > 1))"""


@query(ctes("v_name") + KEYS_SQL + " SELECT id, key FROM k")
def name_search_keys(spark, sf_dir):
    """TXT4: search keys of names."""
    return view(spark, sf_dir, "v_name").select("id", F.explode(text.search_keys(F.col("name"))).alias("key"))


@query("""SELECT p_partkey AS id, concat(upper(substr(p_name, 1, 1)), lower(substr(p_name, 2))) AS capital, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '.5' ELSE p_size || 'x' END AS size,
array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '-7 ') || CASE WHEN p_partkey % 2 = 0 THEN ' (Ab''C)' ELSE '' END AS title FROM part""")
def text_forms(spark, sf_dir):
    """TXT5: capitals and numbers without a decimal zero."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), text.capitalize(F.col("p_name")).alias("capital"), text.bare_number(F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, (".00", ".50", "x"))), (F.col("p_partkey") % 3 + 1).cast("int")))).alias("size"),
        text.title(F.concat(F.replace("p_name", F.lit(" "), F.lit("-7_")), F.when(F.col("p_partkey") % 2 == 0, " (ab'c)").otherwise(""))).alias("title"))


HAVERSINE = "2 * 6371000.0 * (5 * 33554432 / (2 * pi() * 6371000.0)) * asin(sqrt(least(1.0, pow(sin(radians((ay - by_) / (268435456.0 / 360.0)) / 2), 2) + cos(radians(90.0 - ay / (268435456.0 / 360.0))) * cos(radians(90.0 - by_ / (268435456.0 / 360.0))) * pow(sin(radians((bx - ax) / (268435456.0 / 360.0)) / 2), 2))))"


@query(ctes("v_trace") + SEGMENTS + f""", l AS (SELECT way, pos, {HAVERSINE} AS len, sqrt(CAST((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS DOUBLE)) AS plain FROM g)
SELECT way, pos, round(sum(len) OVER (PARTITION BY way ORDER BY pos), 3) AS running, round(sum(plain) OVER (PARTITION BY way ORDER BY pos), 3) AS plain FROM l""")
def running_lengths(spark, sf_dir):
    """TXT7, TXT9, WIN2, WIN3: great-circle and planar lengths along each trace."""
    c = F.col
    length = grid.segment_length(c("ax"), c("ay"), c("bx"), c("by"))
    plain = F.sqrt(((c("bx") - c("ax")) * (c("bx") - c("ax")) + (c("by") - c("ay")) * (c("by") - c("ay"))).cast("double"))
    w = Window.partitionBy("way").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return trace_segments(spark, sf_dir).select("way", "pos", F.round(F.sum(length).over(w), 3).alias("running"), F.round(F.sum(plain).over(w), 3).alias("plain"))


@query(ctes("v_trace") + SEGMENTS + """, m AS (SELECT *, row_number() OVER (PARTITION BY way ORDER BY pos) AS r FROM g WHERE ax <> bx OR ay <> by_)
SELECT way, round(degrees(atan2(-(by_ - ay), (bx - ax) * cos(radians(90.0 - ay / (268435456.0 / 360.0))))), 6) AS heading FROM m WHERE r = 1""")
def start_headings(spark, sf_dir):
    """TXT8: direction of each trace's first step that isn't zero."""
    c = F.col
    first = trace_segments(spark, sf_dir).filter("ax <> bx OR ay <> by").groupBy("way").agg(F.min_by(F.struct("ax", "ay", "bx", "by"), "pos").alias("s")).select("way", "s.*")
    return first.select("way", F.round(grid.heading(c("bx") - c("ax"), c("by") - c("ay"), c("ay")), 6).alias("heading"))


@query(ctes("v_trace") + SEGMENTS + """, c AS (SELECT DISTINCT way, count(*) OVER (PARTITION BY way) + 1 AS n FROM g) SELECT way, n AS points FROM c""")
def local_point_lists(spark, sf_dir):
    """GRD9: cell-local point lists without consecutive repeats (traces have none, so all points stay)."""
    t = view(spark, sf_dir, "v_trace").select("way", "pos", F.rint(grid.unit_x(F.col("lon"))).alias("x"), F.rint(grid.unit_y(F.col("lat"))).alias("y"))
    lines = t.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p.getField("x").alias("x"), p.getField("y").alias("y"))).alias("points"), F.min("x").alias("ox"), F.min("y").alias("oy"))
    return lines.withColumn("l", grid.local_points(F.col("points"), F.col("ox"), F.col("oy"))).filter("l IS NOT NULL").select("way", F.size("l").cast("long").alias("points"))


SEAMARKS = """SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'conical' WHEN 1 THEN 'can' WHEN 2 THEN 'spherical' WHEN 3 THEN 'pillar' WHEN 4 THEN 'spar' WHEN 5 THEN 'barrel' ELSE 'odd' END AS shape,
CASE event_id % 6 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'red;white' WHEN 3 THEN 'yellow' WHEN 4 THEN 'black;yellow;black' ELSE 'mauve' END AS colour, CASE event_id % 5 WHEN 0 THEN '3' WHEN 1 THEN '4.0' WHEN 2 THEN '2.5' ELSE '' END AS period FROM events"""


@query(f"WITH b AS ({SEAMARKS})" + """ SELECT id, CAST(655360 + CASE shape WHEN 'conical' THEN 0 WHEN 'can' THEN 256 WHEN 'spherical' THEN 512 WHEN 'spar' THEN 1024 WHEN 'barrel' THEN 1280 ELSE 768 END AS BIGINT) AS category,
CAST(CASE colour WHEN 'red' THEN 16 + 3 * 128 WHEN 'green' THEN 16 + 4 * 128 WHEN 'red;white' THEN 32 + 3 * 128 + 2048 WHEN 'yellow' THEN 16 + 8 * 128 WHEN 'black;yellow;black' THEN 48 + 2 * 128 + 8 * 2048 ELSE 0 END AS BIGINT) AS colour_bits,
concat('Fl.', CASE colour WHEN 'red' THEN 'R' WHEN 'green' THEN 'G' WHEN 'red;white' THEN 'WR' WHEN 'mauve' THEN '' ELSE 'Y' END, CASE period WHEN '3' THEN '.3s' WHEN '4.0' THEN '.4s' WHEN '2.5' THEN '.2.5s' ELSE '' END) AS light FROM b""")
def seamark_codes(spark, sf_dir):
    """TAG13, TAG14, TAG16, TAG17: category, colour bits and light strings of lateral buoys."""
    b = spark.sql(SEAMARKS.replace("FROM events", "FROM {e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))
    tags = F.create_map(*[x if not isinstance(x, str) else F.lit(x) for kv in (("seamark:buoy_lateral:shape", F.col("shape")), ("seamark:buoy_lateral:colour", F.col("colour")), ("seamark:light:character", "Fl"),
                          ("seamark:light:colour", F.col("colour")), ("seamark:light:period", F.col("period"))) for x in kv])
    kind = F.lit("buoy_lateral")
    b = b.withColumn("tags", tags).withColumn("ls", seamarks.lights(F.col("tags")))
    return b.select("id", seamarks.category(kind, F.col("tags")).alias("category"), seamarks.body_colour(kind, F.col("tags")).alias("colour_bits"), seamarks.light_string(F.col("ls")).alias("light"))


MARKS = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'light_major' WHEN 1 THEN 'bridge' WHEN 2 THEN 'platform' ELSE 'radio_station' END AS kind, CASE event_id % 3 WHEN 0 THEN 'swing' WHEN 1 THEN 'dgps' END AS cat,
CASE WHEN event_id % 5 < 3 THEN 'red' ELSE 'white' END AS c1, CASE WHEN event_id % 7 < 3 THEN 'green' ELSE 'white' END AS c2, event_id * 37 % 360 AS a, event_id * 91 % 360 AS b, 3 + event_id % 4 AS period, 4 + event_id % 9 AS low, 15 + event_id % 6 AS high FROM events"""


@query(f"WITH m AS ({MARKS})" + """, l AS (SELECT id, unnest([0, 1]) AS seq, unnest([c1, c2]) AS c, unnest([a, b]) AS f, unnest([b, (a + b) % 360]) AS t, period FROM m),
s AS (SELECT id, CASE c WHEN 'white' THEN 1 WHEN 'red' THEN 3 ELSE 4 END AS code, seq, floor((f + 180) % 360 * 4096.0 / 360) / 10 AS f, floor((t + 180) % 360 * 4096.0 / 360) / 10 AS t, 'Fl.' || upper(c[1]) || '.' || period || 's' AS label FROM l),
g AS (SELECT id, string_agg(code || ':' || seq || ':' || round(f * 10) :: BIGINT || ':' || round(t * 10) :: BIGINT || ':370:' || label, ',' ORDER BY code, seq) AS sectors FROM s GROUP BY id),
d AS (SELECT *, CASE kind WHEN 'light_major' THEN 'Light major' WHEN 'bridge' THEN CASE cat WHEN 'swing' THEN 'Swing bridge' WHEN 'dgps' THEN 'Dgps bridge' ELSE 'Bridge' END WHEN 'platform' THEN CASE WHEN cat IS NULL THEN 'Platform' ELSE 'Platform(' || cat || ')' END ELSE CASE cat WHEN 'dgps' THEN 'Differential GPS' ELSE 'Radio station' END END AS description,
'Fl.' || CASE WHEN 'white' IN (c1, c2) THEN 'W' ELSE '' END || CASE WHEN 'red' IN (c1, c2) THEN 'R' ELSE '' END || CASE WHEN 'green' IN (c1, c2) THEN 'G' ELSE '' END || '.' || period || 's' || low || '-' || high || 'M' AS light FROM m)
SELECT id, description, sectors, '18Op ' || id % 10 || '|19' || description || '|24' || light || '|3612' AS attributes, CASE WHEN kind = 'bridge' THEN '4' || low || '.5|' ELSE '' END || '5' || light AS label FROM d JOIN g USING (id)""")
def seamark_texts(spark, sf_dir):
    """TAG15, TAG16, TAG17, TAG18, TAG19: descriptions, sectors of two numbered lights, attribute strings and label lines of four kinds of marks."""
    m = spark.sql(MARKS.replace("FROM events", "FROM {e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))
    text, kind = (lambda c: F.col(c).cast("string")), F.col("kind")
    light = lambda i, c, f, t, reach: [(f"seamark:light:{i}:character", F.lit("Fl")), (f"seamark:light:{i}:colour", F.col(c)), (f"seamark:light:{i}:sector_start", f.cast("string")), (f"seamark:light:{i}:sector_end", t.cast("string")),
                                       (f"seamark:light:{i}:period", text("period")), (f"seamark:light:{i}:range", text(reach)), (f"seamark:light:{i}:height", F.lit("12.0"))]
    a, b = F.col("a"), F.col("b")
    pairs = [(F.lit(k), v) for k, v in (*light(1, "c1", a, b, "low"), *light(2, "c2", b, (a + b) % 360, "high"), ("operator", F.concat(F.lit("Op "), F.col("id") % 10)), ("seamark:bridge:clearance_height", F.concat(text("low"), F.lit(".50"))))]
    tags = F.map_concat(F.create_map(*[x for pair in pairs for x in pair]), F.when(F.col("cat").isNotNull(), F.create_map(F.concat(F.lit("seamark:"), kind, F.lit(":category")), F.col("cat"))).otherwise(F.create_map().cast("map<string,string>")))
    m = m.withColumn("tags", tags).withColumn("ls", seamarks.lights(F.col("tags")))
    tenths = lambda v: F.rint(v * 10).cast("long")
    sector = lambda s: F.concat_ws(":", s.getField("colour"), s.getField("seq"), tenths(s.getField("start")), tenths(s.getField("end")), s.getField("radius"), s.getField("label"))
    return m.select("id", seamarks.description(kind, F.col("tags")).alias("description"), F.array_join(F.transform(seamarks.sectors(F.col("ls")), sector), ",").alias("sectors"),
                    seamarks.attributes(kind, F.col("tags"), F.col("ls")).alias("attributes"), seamarks.label(kind, F.col("tags"), F.col("ls")).alias("label"))


@query("SELECT user_id, round(fsum(value * 1e6 + event_id), 3) AS total, round(fsum(value * 1e6 + event_id) / count(*), 6) AS mean FROM events GROUP BY user_id")
def compensated_sums(spark, sf_dir):
    """TXT12: compensated sums and means in a fixed order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.struct("event_id", (F.col("value") * 1e6 + F.col("event_id")).alias("v")).alias("x"))
    listed = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.getField("v")).alias("vs"))
    return listed.select("user_id", F.round(grid.compensated_sum(F.col("vs")), 3).alias("total"), F.round(grid.compensated_mean(F.col("vs")), 6).alias("mean"))
