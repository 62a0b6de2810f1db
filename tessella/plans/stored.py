"""Files written from the views and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import raster, roads
from ..operators.tables import shared_dir
from ..sources import files
from .common import query
from .places import PIECES, pieces
from .roads import segments
from .surfaces import pixels, tiles


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


@query("""WITH r AS (SELECT n_nationkey AS nation, 80000000 + n_nationkey % 5 * 8000000 AS x, 540000000 + n_nationkey // 5 * 6000000 AS y FROM nation), s AS (SELECT nation, 0 AS ring, false AS hole, x, y, 7000000 AS side FROM r UNION ALL SELECT nation, 1, true, x + 1000000, y + 1000000, 2000000 FROM r WHERE nation % 2 = 0)
SELECT nation, CAST(ring AS INTEGER) AS ring, hole, CAST(pos AS INTEGER) AS pos, CAST(x + dx * side AS BIGINT) AS x, CAST(y + dy * side AS BIGINT) AS y FROM s, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) AS c(pos, dx, dy)""")
def stored_boundaries(spark, sf_dir):
    """SRC2: boundaries written as text files, a file for each nation, every second one with a hole, and read again."""
    k = F.col("n_nationkey")
    x, y = 80000000 + k % 5 * 8000000, 540000000 + F.floor(k / 5) * 6000000
    degrees = lambda v: (v / 1e7).cast("decimal(12,7)").cast("string")

    def section(name: str, x, y, side: int):
        corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
        return F.concat(F.lit(f"{name}\n"), *[F.concat(F.lit("   "), degrees(x + dx * side), F.lit("   "), degrees(y + dy * side), F.lit("\n")) for dx, dy in corners], F.lit("END\n"))

    hole = F.when(k % 2 == 0, section("!2", x + 1000000, y + 1000000, 2000000)).otherwise("")
    text = F.concat(F.lit("area\n"), section("1", x, y, 7000000), hole, F.lit("END"))
    path = folder(spark, "boundaries")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("nation"), text.alias("value")).write.partitionBy("nation").text(path)
    rows = files.boundary(spark, path)
    return rows.select(F.regexp_extract("file", r"nation=(\d+)", 1).cast("long").alias("nation"), "ring", "hole", "pos", "x", "y")


@query("""WITH r AS (SELECT 'R' || s_suppkey % 60 AS code, s_name AS name, 'europe/' || s_nationkey || '/' || s_suppkey AS path FROM supplier)
SELECT code, name, path, count(*) OVER (PARTITION BY code) > 1 AS shared FROM r""")
def stored_regions(spark, sf_dir):
    """SRC6, SNK3: a region list written with the marks of shared codes, and read again."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    path = folder(spark, "regions")
    files.write_region_table(s.select(F.concat(F.lit("R"), F.col("s_suppkey") % 60).alias("code"), F.col("s_name").alias("name"), F.concat_ws("/", F.lit("europe"), "s_nationkey", "s_suppkey").alias("path")), path)
    return files.region_table(spark, path)


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'region-' || n_regionkey AS parent, 'https://example.org/r' || n_regionkey || '/' || lower(n_name) || '-latest.osm.pbf' AS pbf, 'r' || n_regionkey || '/' || lower(n_name) AS path FROM nation""")
def stored_index(spark, sf_dir):
    """SRC5: an index of extracts written as GeoJSON, a document for each region, and read again."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    url = F.concat(F.lit("https://example.org/r"), "n_regionkey", F.lit("/"), F.lower("n_name"), F.lit("-latest.osm.pbf"))
    feature = F.struct(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("region-"), "n_regionkey").alias("parent"), F.struct(url.alias("pbf")).alias("urls")).alias("properties"))
    documents = n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("value"))  # the nations of one region
    path = folder(spark, "index")
    documents.write.partitionBy("n_regionkey").text(path)
    return files.region_index(spark, path)


@query("""SELECT vec_id // 25 AS tile_row, vec_id % 25 AS tile_col, CAST(i - 1 AS INTEGER) AS i, round(CAST(embedding[i] AS DOUBLE), 5) AS v FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i) WHERE vec_id // 25 BETWEEN 2 AND 9 AND vec_id % 25 BETWEEN 4 AND 20""")
def stored_grid(spark, sf_dir):
    """SRC7: a height grid written in the order of its tiles, and a box of it read again."""
    path = folder(spark, "grid")
    raster.write_grid(tiles(spark, sf_dir), path)
    return pixels(raster.read_grid(spark, path, (2, 9, 4, 20)))


@query(PIECES + """, pl AS (SELECT way, edge, piece, part, max(total) AS total FROM pc GROUP BY ALL), pe AS (SELECT *, sum(total) OVER (PARTITION BY way, edge) AS planar, max(part) OVER (PARTITION BY way, edge) AS final FROM pl)
SELECT piece, CAST(round_even(CASE WHEN planar <> 0 THEN length * total / planar ELSE 0 END, 0) AS BIGINT) AS length, CASE WHEN part = 0 THEN a END AS first_node, CASE WHEN part = final THEN b END AS last_node FROM pe JOIN e ON e.way = pe.way AND e.edge = pe.edge""")
def piece_measures(spark, sf_dir):
    """ASM13: lengths of street pieces, shares of their edges' great-circle lengths, and end nodes, null at cell borders."""
    return roads.piece_measures(pieces(spark, sf_dir), roads.edge_measures(segments(spark, sf_dir))).select("piece", "length", "first_node", "last_node")
