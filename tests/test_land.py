"""Land polygons by ranges of records: many records in several tasks, with and without the index file, and the clip to whole tiles."""

import struct

import pytest
from pyspark.sql import functions as F

from tessella.sources import files, land


def record(number, rings):
    xy = [p for r in rings for p in r]
    x, y = [p[0] for p in xy], [p[1] for p in xy]
    starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
    body = struct.pack("<i4dii", 5, min(x), min(y), max(x), max(y), len(rings), len(xy)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in xy)
    return struct.pack(">ii", number, len(body) // 2) + body


def square(x, y, side, hole=False):
    ring = [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]
    return ring[::-1] if hole else ring


@pytest.fixture(scope="module")
def shapefile(tmp_path_factory):
    """20,000 squares on a lattice, every tenth with a hole, and one shape without points."""
    parts = [record(i + 1, [square(i % 200 * 0.5, i // 200 * 0.5, 0.4)] + ([square(i % 200 * 0.5 + 0.1, i // 200 * 0.5 + 0.1, 0.2, True)] if i % 10 == 0 else [])) for i in range(20_000)]
    parts.insert(7, struct.pack(">ii", 20_001, 2) + struct.pack("<i", 0))
    folder = tmp_path_factory.mktemp("land")
    head = struct.pack(">i", land.MAGIC).ljust(land.HEADER_BYTES, b"\0")
    (folder / "a.shp").write_bytes(head + b"".join(parts))
    (folder / "b.shp").write_bytes(head + b"".join(parts))
    at, index = land.HEADER_BYTES, b""
    for p in parts:
        index += struct.pack(">ii", at // 2, (len(p) - 8) // 2)
        at += len(p)
    (folder / "a.shx").write_bytes(head + index)
    return folder


@pytest.mark.parametrize("name", ["a", "b"])
def test_ranges_of_records(spark, shapefile, name):
    rings = land.read_rings(spark, str(shapefile / f"{name}.shp"), task_bytes=400_000)
    assert rings.rdd.getNumPartitions() > 5
    got = rings.agg(F.count("*").alias("n"), F.countDistinct("record").alias("records"), F.count_if("hole").alias("holes"), F.sum(F.size("points")).alias("points")).first()
    assert tuple(got) == (22_000, 20_000, 2_000, 110_000)
    few = files.land_rings(spark, f"file:{shapefile}/{name}.shp", (10.0, 10.0, 10.9, 10.4))
    assert {(r.x, r.y) for r in few.filter("pos = 0 AND NOT hole").collect()} == {(10.0, 10.0), (10.5, 10.0)}


def test_clip_to_whole_tiles(spark, shapefile):
    assert land.whole_tiles((10.05, 10.05, 10.6, 10.2), 0.25) == (10.0, 10.0, 10.75, 10.25)
    rows = land.land_in_tiles(spark, str(shapefile / "a.shp"), (10.05, 10.05, 10.6, 10.2), 0.25).collect()
    area = lambda p: sum(a.x * b.y - b.x * a.y for a, b in zip(p, [*p[1:], p[0]])) / 2
    assert sorted((round(abs(area(r.points)), 6), r.hole) for r in rows) == [(0.03, True), (0.0625, False), (0.1, False)]
    assert all(10.0 <= p.x <= 10.75 and 10.0 <= p.y <= 10.25 for r in rows for p in r.points)
