"""Extracts: what each layer takes from the entities, one narrow projection per layer of the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def _kept(rows: DataFrame, condition: Column, *columns: str | Column) -> DataFrame:
    return rows.filter(F.coalesce(condition, F.lit(False))).select("id", *columns)


def points_of_interest(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """``kind, id, typ, name, attributes`` of nodes, ways and area relations with a type."""
    tags, parts = F.col("tags"), []
    for kind, rows in (("n", nodes), ("w", ways), ("r", relations.filter(rules.is_multipolygon(tags)))):
        typed = rows.withColumn("typ", rules.poi_type(tags, F.lit(kind == "n")))
        parts.append(_kept(typed, F.col("typ").isNotNull(), F.lit(kind).alias("kind"), "typ", rules.tag(tags, "name").alias("name"), rules.poi_attributes(tags).alias("attributes")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def streets(ways: DataFrame) -> DataFrame:
    """``id, refs, class, category, flags, name`` of the ways that are roads."""
    tags = F.col("tags")
    classed = ways.withColumn("class", rules.road_class(tags))
    return _kept(classed, F.col("class").isNotNull(), "refs", "class", rules.road_category(F.col("class"), tags).alias("category"), rules.tag_flags(tags).alias("flags"), rules.tag(tags, "name").alias("name"))


def areas(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """``kind, id, tags`` of ways and area relations that are areas."""
    tags = F.col("tags")
    w = _kept(ways, rules.keeps_area(tags), F.lit("w").alias("kind"), "tags")
    return w.unionByName(_kept(relations, rules.keeps_area(tags) & rules.is_multipolygon(tags), F.lit("r").alias("kind"), "tags"))


def coast(ways: DataFrame) -> DataFrame:
    """``id, refs, islet`` of coast ways."""
    return _kept(ways, rules.is_coastline(F.col("tags")), "refs", (F.coalesce(rules.tag(F.col("tags"), "place"), F.lit("")) == "islet").alias("islet"))


def addresses(nodes: DataFrame) -> DataFrame:
    """``id, lon, lat, hn, street, postcode, city, place, suburb`` of address nodes, in canonical order by position and tags."""
    tags = F.col("tags")
    named = [rules.tag(tags, f"addr:{k}").alias(c) for c, k in (("hn", "housenumber"), ("street", "street"), ("postcode", "postcode"), ("city", "city"), ("place", "place"), ("suburb", "suburb"))]
    return _kept(nodes, rules.is_address(tags), "lon", "lat", *named)


def places(nodes: DataFrame) -> DataFrame:
    """``id, lon, lat, place, name`` of place nodes."""
    tags = F.col("tags")
    return _kept(nodes, rules.is_place(tags), "lon", "lat", rules.tag(tags, "place").alias("place"), rules.tag(tags, "name").alias("name"))


def seamarks(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """``kind, id, seamark, tags`` of nodes, ways and area relations that are sea marks, with all their tags."""
    tags = F.col("tags")
    of = lambda kind, rows: _kept(rows, F.coalesce(rules.tag(tags, "seamark:type"), F.lit("")) != "", F.lit(kind).alias("kind"), rules.tag(tags, "seamark:type").alias("seamark"), "tags")
    return of("n", nodes).unionByName(of("w", ways)).unionByName(of("r", relations.filter(rules.is_multipolygon(tags)))).select("kind", "id", "seamark", "tags")


def admin_regions(relations: DataFrame) -> DataFrame:
    """``id, level, name, members`` of administrative areas of the levels that addresses use, with their member ways, each once."""
    tags = F.col("tags")
    ways = F.array_distinct(F.transform(F.filter("members", lambda m: m.getField("type") == "way"), lambda m: m.getField("ref")))
    level = relations.withColumn("level", rules.region_level(tags))
    return _kept(level, F.col("level").isNotNull(), "level", rules.tag(tags, "name").alias("name"), ways.alias("members"))


def member_ways(area_relations: DataFrame, ways: DataFrame) -> DataFrame:
    """``relation, id, refs``: the ways that make the outlines of area relations (``id, members`` of way ids), whatever tags they have."""
    wanted = area_relations.select(F.col("id").alias("relation"), F.explode("members").alias("id")).distinct()
    return wanted.join(ways.select("id", "refs"), "id").select("relation", "id", "refs")


def interpolations(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, kind, street, points`` of interpolation ways: their nodes in order (``x, y`` as longitude and latitude, ``hn, street``, null at nodes
    without a number); ways of fewer than two known nodes are left out. A row holds the nodes of one way."""
    tags = F.col("tags")
    lines = _kept(ways, F.coalesce(rules.tag(tags, "addr:interpolation"), F.lit("")) != "", "refs", rules.tag(tags, "addr:interpolation").alias("kind"), rules.tag(tags, "addr:street").alias("street"))
    hn = rules.tag(tags, "addr:housenumber")
    spots = nodes.select(F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y"), hn.alias("hn"), F.when(hn.isNotNull(), rules.tag(tags, "addr:street")).alias("node_street"))
    met = lines.select("id", F.posexplode("refs").alias("pos", "node")).join(spots, "node")
    point = F.struct("pos", F.struct("x", "y", "hn", F.col("node_street").alias("street")).alias("p"))
    points = met.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p.getField("p")).alias("points")).filter(F.size("points") > 1)
    return lines.select("id", "kind", "street").join(points, "id")
