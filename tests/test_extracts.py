"""What layers take from the entities: sea marks, administrative areas with their ways, interpolation ways with the numbers of their nodes."""

from tessella.sources import extracts

NODE, WAY = "id bigint, lon bigint, lat bigint, tags map<string,string>", "id bigint, refs array<bigint>, tags map<string,string>"
RELATION = "id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>"


def test_sea_marks_and_regions(spark):
    nodes = spark.createDataFrame([(1, 0, 0, {"seamark:type": "buoy_lateral", "a": "b"}), (2, 0, 0, {"seamark:type": ""}), (3, 0, 0, None)], NODE)
    ways = spark.createDataFrame([(7, [1, 2], {"seamark:type": "bridge"}), (8, [2, 3], {}), (9, [3, 1], {"highway": "path"})], WAY)
    admin = {"type": "boundary", "boundary": "administrative", "admin_level": "6", "name": "K"}
    members = [("way", 8, "outer"), ("node", 8, "label"), ("way", 9, "inner"), ("way", 8, ""), ("way", 99, "")]
    relations = spark.createDataFrame([(20, members, admin), (21, members, admin | {"admin_level": "2"}), (22, [], {"type": "route", "seamark:type": "fairway"}), (23, [], {"type": "multipolygon", "seamark:type": "harbour"})], RELATION)
    assert sorted((r.kind, r.id, r.seamark) for r in extracts.seamarks(nodes, ways, relations).collect()) == [("n", 1, "buoy_lateral"), ("r", 23, "harbour"), ("w", 7, "bridge")]
    regions = extracts.admin_regions(relations)
    assert [(r.id, r.level, r.name, r.members) for r in regions.collect()] == [(20, 6, "K", [8, 9, 99])]
    assert sorted((r.relation, r.id, r.refs) for r in extracts.member_ways(regions, ways).collect()) == [(20, 8, [2, 3]), (20, 9, [3, 1])]


def test_interpolations(spark):
    nodes = spark.createDataFrame([(1, 10, 20, {"addr:housenumber": "2", "addr:street": "S"}), (2, 11, 21, {"addr:street": "not a number"}), (3, 12, 22, {"addr:housenumber": "8"})], NODE)
    ways = spark.createDataFrame([(7, [3, 2, 99, 1, 3], {"addr:interpolation": "even", "addr:street": "Way"}), (8, [1, 99], {"addr:interpolation": "odd"}), (9, [1, 2], {"highway": "path"})], WAY)
    (row,) = extracts.interpolations(ways, nodes).collect()
    assert (row.id, row.kind, row.street) == (7, "even", "Way")
    assert [tuple(p) for p in row.points] == [(12, 22, "8", None), (11, 21, None, None), (10, 20, "2", "S"), (12, 22, "8", None)]
