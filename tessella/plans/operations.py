"""Layer operations: builds, digests, comparisons, work lists, region codes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grid, rules
from ..sources import layers
from ..sources.fixtures import ctes, view
from .basics import POI_CASE, X, Y, tagged_nodes
from .common import query

OBJECTS = ctes("v_node") + f""", o AS (SELECT id, {POI_CASE} AS typ, CAST(floor({X} / 32768) AS BIGINT) AS cx, CAST(floor({Y} / 32768) AS BIGINT) AS cy, name_id FROM v_node),
ob AS (SELECT 'poi' AS layer, cx // 4 AS tile_x, cy // 4 AS tile_y, cx, cy, typ || ':' || id AS item, id, typ, name_id FROM o WHERE typ IS NOT NULL)"""


def objects(spark, sf_dir):
    n = tagged_nodes(spark, sf_dir).withColumn("typ", rules.poi_type(F.col("tags"), F.lit(True))).filter("typ IS NOT NULL")
    n = n.withColumns({"cx": grid.cell(grid.unit_x(F.col("lon"))), "cy": grid.cell(grid.unit_y(F.col("lat")))})
    return n.select(F.lit("poi").alias("layer"), grid.tile(F.col("cx"), 4).alias("tile_x"), grid.tile(F.col("cy"), 4).alias("tile_y"), "cx", "cy", F.concat_ws(":", "typ", "id").alias("item"), "id", "typ", "name_id")


@query(OBJECTS + " SELECT layer, tile_x, tile_y, cx, cy, md5(string_agg(item, chr(10) ORDER BY item)) AS digest FROM ob GROUP BY ALL")
def layer_digests(spark, sf_dir):
    """SNK1, SNK5: cells of a layer with their digests."""
    return layers.digests(layers.cells(objects(spark, sf_dir)))


@query(OBJECTS + " SELECT layer, count(DISTINCT (tile_x, tile_y)) AS tiles, count(DISTINCT (cx, cy)) AS cells, count(*) AS items FROM ob GROUP BY layer")
def layer_statistics(spark, sf_dir):
    """SNK4: tiles, cells and items of a layer."""
    return layers.statistics(layers.cells(objects(spark, sf_dir)))


@query(OBJECTS + """, a AS (SELECT cx, cy, tile_x, tile_y, string_agg(item, chr(10) ORDER BY item) AS d FROM ob WHERE name_id <> 3 GROUP BY ALL), b AS (SELECT cx, cy, tile_x, tile_y, string_agg(item, chr(10) ORDER BY item) AS d FROM ob WHERE name_id <> 4 GROUP BY ALL)
SELECT 'poi' AS layer, tile_x, tile_y, cx, cy, CASE WHEN b.d IS NULL THEN 'missing' WHEN a.d IS NULL THEN 'extra' ELSE 'changed' END AS status FROM a FULL JOIN b USING (tile_x, tile_y, cx, cy) WHERE a.d IS DISTINCT FROM b.d""")
def layer_differences(spark, sf_dir):
    """SNK6: two builds compared cell by cell."""
    o = objects(spark, sf_dir)
    return layers.compare(layers.cells(o.filter("name_id <> 3")), layers.cells(o.filter("name_id <> 4")))


@query(OBJECTS + """, n AS (SELECT * FROM ob WHERE typ = 72), k AS (SELECT * FROM n UNION ALL SELECT * FROM ob WHERE typ = 2 AND (tile_x, tile_y) NOT IN (SELECT (tile_x, tile_y) FROM n)) SELECT tile_x, tile_y, count(*) AS items, min(typ) AS typ FROM k GROUP BY ALL""")
def tiles_with_fallback(spark, sf_dir):
    """JON16, SRC9: an older build's tiles where the new build has none."""
    o = objects(spark, sf_dir)
    both = layers.with_older_tiles(o.filter("typ = 2"), o.filter("typ = 72"))
    return both.groupBy("tile_x", "tile_y").agg(F.count("*").alias("items"), F.min("typ").alias("typ"))


@query(ctes("v_name") + r"""SELECT concat_ws(chr(9), id, regexp_replace(name, '[\t\n\r]', ' ', 'g'), coalesce(lang, '')) AS line FROM v_name""")
def canonical_lines(spark, sf_dir):
    """SNK2: one canonical line per object."""
    return layers.dump(view(spark, sf_dir, "v_name"), ["id", "name", "lang"])


@query("""SELECT n_name AS region, n_nationkey * 100 AS size FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND n_nationkey * 100 <= 1500""")
def work_list(spark, sf_dir):
    """SNK7: regions still to build."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    report = n.select(F.col("n_name").alias("region"), F.when(F.col("n_regionkey") == 2, "ok").otherwise("failed").alias("status"))
    return layers.work_list(n.select(F.col("n_name").alias("region"), (F.col("n_nationkey") * 100).alias("size")), report, 1500)


@query(OBJECTS + """, a AS (SELECT id, typ, name_id FROM ob WHERE id % 3 <> 0), b AS (SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE typ END AS typ, CASE WHEN id % 7 = 0 THEN NULL ELSE name_id END AS name_id FROM ob WHERE id % 4 <> 0)
SELECT count(*) AS matched, round(avg(CASE WHEN a.typ IS NOT DISTINCT FROM b.typ THEN 1.0 ELSE 0 END), 6) AS same_typ, round(avg(CASE WHEN a.name_id IS NOT DISTINCT FROM b.name_id THEN 1.0 ELSE 0 END), 6) AS same_name_id FROM a JOIN b USING (id)""")
def build_match_rates(spark, sf_dir):
    """AGG22: share of equal values at equal objects of two builds."""
    o = objects(spark, sf_dir).select("id", "typ", "name_id")
    other = o.filter("id % 4 <> 0").withColumns({"typ": F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("typ")), "name_id": F.when(F.col("id") % 7 == 0, None).otherwise(F.col("name_id"))})
    return layers.match_rates(o.filter("id % 3 <> 0"), other, ["id"], ["typ", "name_id"])


@query("""WITH r AS (SELECT n_name AS name, lower(n_name) AS id, CASE WHEN n_regionkey < 3 THEN r_name END AS parent, n_nationkey AS k FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, r_name, NULL, 100 + r_regionkey FROM region),
c AS (SELECT id, parent, CASE WHEN parent IS NOT NULL AND parent <> 'AMERICA' THEN upper(substr(name, 1, 2)) WHEN parent = 'AMERICA' AND k % 2 = 1 THEN upper(substr(name, 1, 2)) WHEN parent = 'AMERICA' AND k % 4 = 0 THEN 'A' || k WHEN k >= 100 THEN 'R' || (k - 100) END AS code FROM r),
s AS (SELECT parent FROM c WHERE parent IS NOT NULL GROUP BY parent HAVING bool_and(code IS NOT NULL))
SELECT id, code FROM c WHERE parent IS NULL AND code IS NOT NULL AND id NOT IN (SELECT parent FROM s) UNION ALL SELECT id, code FROM c WHERE parent IN (SELECT parent FROM s)""")
def coded_regions(spark, sf_dir):
    """JON14, JON15: region codes by chained lookups; parents replaced by children that all have codes."""
    n, r = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    kids = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.lower("n_name").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") < 3, F.col("r_name")).alias("parent"), F.col("n_nationkey").alias("k"))
    tops = r.select(F.col("r_name").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"), (100 + F.col("r_regionkey")).alias("k"))
    known = kids.filter("parent IS NOT NULL AND (parent <> 'AMERICA' OR k % 2 = 1)")
    codes = known.select(F.col("id").alias("key"), F.upper(F.substring("name", 1, 2)).alias("code")).unionByName(tops.select(F.col("name").alias("key"), F.concat(F.lit("R"), F.col("k") - 100).alias("code")))
    aliases = kids.filter("parent = 'AMERICA' AND k % 4 = 0").select(F.col("name").alias("key"), F.concat(F.lit("A"), F.col("k")).alias("code"))
    return layers.replaced_parents(layers.region_codes(kids.unionByName(tops).select("id", "name", "parent"), codes, aliases))


@query("SELECT n_name AS name, substr(n_name, 1, 1) AS code, count(*) OVER (PARTITION BY substr(n_name, 1, 1)) AS uses FROM nation")
def shared_codes(spark, sf_dir):
    """AGG20, SNK3: codes and how many regions use them."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.substring("n_name", 1, 1).alias("code"))
    return n.withColumn("uses", F.count("*").over(Window.partitionBy("code")))


@query(ctes("v_parcel_seg") + """SELECT cls AS class, count(DISTINCT area) AS polygons, CAST(count(DISTINCT area) * 1000000 AS DOUBLE) AS size, min(xa) AS x0, max(xa) AS x1 FROM v_parcel_seg GROUP BY cls""")
def class_statistics(spark, sf_dir):
    """AGG21, AGG24, AGG25: polygons, total area and box of each class."""
    s = view(spark, sf_dir, "v_parcel_seg")
    twice = F.col("xa") * F.col("yb") - F.col("xb") * F.col("ya")
    by_area = s.groupBy("cls", "area").agg((F.abs(F.sum(twice)) / 2).alias("size"), F.min("xa").alias("x0"), F.max("xa").alias("x1"))
    return by_area.groupBy(F.col("cls").alias("class")).agg(F.count("*").alias("polygons"), F.sum("size").alias("size"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query("""WITH c AS (SELECT event_id AS id, event_id % 18 AS class FROM events), o AS (SELECT class, CASE class WHEN 4 THEN 0 WHEN 3 THEN 1 WHEN 10 THEN 2 WHEN 1 THEN 3 WHEN 0 THEN 4 WHEN 9 THEN 5 WHEN 11 THEN 6 WHEN 2 THEN 7 WHEN 5 THEN 8 WHEN 17 THEN 9 WHEN 8 THEN 10 WHEN 6 THEN 11 WHEN 7 THEN 12 WHEN 16 THEN 13 END AS place, count(*) AS n FROM c GROUP BY ALL)
SELECT class, CAST(place AS INTEGER) AS place, n FROM o WHERE place IS NOT NULL""")
def draw_orders(spark, sf_dir):
    """SRT2: draw order of area classes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.col("event_id") % 18).alias("class")).agg(F.count("*").alias("n"))
    return e.select("class", rules.draw_order(F.col("class").cast("int")).alias("place"), "n").filter("place IS NOT NULL")
