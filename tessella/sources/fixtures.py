"""Map tables as views over the driver's tables, in SQL that Spark and DuckDB both run unchanged.

Integer arithmetic only, so that both engines agree exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

VIEWS = {
    "v_node": """
SELECT event_id AS id,
       80000000 + (event_id * 7919 + user_id * 104729) % 40000000 AS lon,
       540000000 + (event_id * 6101 + user_id * 15485863) % 30000000 AS lat,
       CASE event_type WHEN 'view' THEN 'amenity' WHEN 'click' THEN 'amenity' WHEN 'purchase' THEN 'shop' WHEN 'signup' THEN 'historic' END AS k,
       CASE event_type WHEN 'view' THEN 'cafe' WHEN 'click' THEN 'restaurant' WHEN 'purchase' THEN 'supermarket' WHEN 'signup' THEN 'castle' END AS v,
       user_id % 10 AS name_id, ts, user_id
FROM events
""",
    "v_node_dense": """
SELECT event_id AS id, 80000000 + (event_id * 7919 + user_id * 104729) % 400000 AS lon,
       540000000 + (event_id * 6101 + user_id * 15485863) % 300000 AS lat,
       event_type AS typ, user_id % 10 AS name_id
FROM events
""",
    "v_way_ref": """
SELECT l_orderkey AS way, l_partkey * 100 + l_suppkey % 100 AS node,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS pos
FROM lineitem
""",
    "v_way_node": """
SELECT node AS id, 90000000 + (node * 7919) % 2000000 AS lon, 555000000 + (node * 6101) % 1500000 AS lat
FROM (SELECT DISTINCT l_partkey * 100 + l_suppkey % 100 AS node FROM lineitem) q
WHERE node % 97 <> 0
""",
    "v_way": """
SELECT o_orderkey AS way,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'motorway' WHEN '2' THEN 'primary' WHEN '3' THEN 'residential' WHEN '4' THEN 'footway' ELSE 'track' END AS highway,
       CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN '-1' END AS oneway,
       CASE WHEN o_custkey % 3 = 0 THEN 'asphalt' WHEN o_custkey % 3 = 1 THEN 'sett' END AS surface,
       CAST(o_orderkey % 9 AS VARCHAR(4)) AS lanes, o_custkey % 40 AS name_id
FROM orders
""",
    "v_member": """
SELECT o_custkey AS rel, o_orderkey AS way,
       CASE o_custkey % 4 WHEN 0 THEN 'lcn' WHEN 1 THEN 'rcn' WHEN 2 THEN 'ncn' ELSE 'icn' END AS network,
       CASE o_custkey % 3 WHEN 0 THEN 'bicycle' WHEN 1 THEN 'mtb' ELSE 'hiking' END AS route
FROM orders
""",
    "v_trace": """
SELECT user_id AS way, event_id AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
       80000000 + (event_id * 7919 + user_id * 104729) % 400000 AS lon,
       540000000 + (event_id * 6101 + user_id * 15485863) % 300000 AS lat
FROM events
""",
    "v_place": """
SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' ELSE 'hamlet' END AS place,
       s_suppkey % 40 AS name_id,
       90000000 + (s_suppkey * 15485863) % 2000000 AS lon, 555000000 + (s_suppkey * 3246599) % 1500000 AS lat
FROM supplier
""",
    "v_addr": """
SELECT c_custkey AS id, c_custkey % 40 AS street_id,
       CASE c_custkey % 5 WHEN 0 THEN concat(CAST(c_custkey % 200 AS VARCHAR(8)), 'a') WHEN 1 THEN concat(CAST(c_custkey % 200 AS VARCHAR(8)), '-', CAST(c_custkey % 200 + 4 AS VARCHAR(8)))
            WHEN 2 THEN concat('Flat ', CAST(c_custkey % 9 AS VARCHAR(8))) ELSE CAST(c_custkey % 200 AS VARCHAR(8)) END AS hn,
       CASE c_custkey % 4 WHEN 0 THEN concat('SW', CAST(c_custkey % 10 AS VARCHAR(2)), 'A 1AA') WHEN 1 THEN concat(CAST(1000 + c_custkey % 50 AS VARCHAR(8)), ' AB') WHEN 2 THEN 'London' ELSE CAST(40000 + c_custkey % 50 AS VARCHAR(8)) END AS postcode,
       c_custkey % 40 AS city_id,
       90000000 + (c_custkey * 7919) % 2000000 AS lon, 555000000 + (c_custkey * 6101) % 1500000 AS lat
FROM customer
""",
    "v_admin": """
SELECT n_nationkey AS id, n_regionkey AS parent,
       80000000 + (n_nationkey % 5) * 8000000 AS x0, 88000000 + (n_nationkey % 5) * 8000000 AS x1,
       540000000 + CAST(floor(n_nationkey / 5.0) AS BIGINT) * 6000000 AS y0, 546000000 + CAST(floor(n_nationkey / 5.0) AS BIGINT) * 6000000 AS y1
FROM nation
""",
    "v_parcel_seg": """
SELECT c_custkey AS area, c_mktsegment AS cls, e.n AS pos,
       1000 * (c_custkey % 50 + CASE WHEN e.n IN (1, 2) THEN 1 ELSE 0 END) AS xa, 1000 * (CAST(floor(c_custkey / 50.0) AS BIGINT) + CASE WHEN e.n IN (2, 3) THEN 1 ELSE 0 END) AS ya,
       1000 * (c_custkey % 50 + CASE WHEN e.n IN (0, 1) THEN 1 ELSE 0 END) AS xb, 1000 * (CAST(floor(c_custkey / 50.0) AS BIGINT) + CASE WHEN e.n IN (1, 2) THEN 1 ELSE 0 END) AS yb
FROM customer CROSS JOIN (VALUES (0), (1), (2), (3)) AS e(n)
""",
    "v_tile": """
SELECT CAST(floor(vec_id / 25.0) AS BIGINT) AS tile_row, vec_id % 25 AS tile_col, embedding AS z, label AS cls
FROM embeddings
""",
    "v_name": """
SELECT doc_id AS id, text AS name, lang, source FROM documents
""",
}


#: The windows of views: whose rows they order, within which column.
WINDOWS = {"v_way_ref": ("lineitem", "l_orderkey"), "v_trace": ("events", "user_id")}


def rows_of(spark: SparkSession, sf_dir: str, table: str) -> int:
    """Rows of a table, as its files' footers have them."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the Parquet tables in ``sf_dir``."""
    found = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", VIEWS[name])]
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(found)})\b", r"\1 {\2}", VIEWS[name])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in found}
    if name in WINDOWS:
        table, key = WINDOWS[name]
        tables[table] = spread(tables[table], rows_of(spark, sf_dir, table), key)
    return spark.sql(text, **tables)


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the views for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
