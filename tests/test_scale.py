"""Cases that only larger tables showed."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import addresses, areas, entities, roads, spatial, tables
from tessella.plans import registry


def test_cells_full_of_roads_that_stay(spark):
    """A cell that is full without all that its levels drop keeps the rest, if that is wished."""
    rows = [(w, 0, n, 0, 0, w % 6 if w % 6 in (1, 2, 3, 4) else None) for w in range(60) for n in (w, w + 1)] + [(99, 0, n, 5, 5, 1) for n in (1, 2)]
    ends = spark.createDataFrame(rows, "way long, edge int, node long, bx long, by long, rank int")
    assert {r.way for r in roads.shed(ends, 30, strict=False).collect()} == {w for w in range(60) if w % 6 in (0, 5)} | {99}
    with pytest.raises(ValueError):
        roads.shed(ends, 30)


def test_geocoding_a_long_street(spark):
    """Numbers on streets with any ranges, against the rule; a number meets few rows, however many pieces a street has."""
    rng = random.Random(3)
    ranges = [(0, rng.randrange(2), i, lo, lo + rng.choice([0, 1, 2, 7, 60, 300]), rng.random() < 0.4, rng.random() < 0.5) for i in range(300) for lo in [rng.randrange(400)]]
    rng.shuffle(ranges)
    asked = [(i, 0, rng.randrange(3), rng.choice([None, rng.randrange(800)])) for i in range(400)]
    got = addresses.geocode(spark.createDataFrame(asked, "id long, place int, street int, n long"), spark.createDataFrame(ranges, "place int, street int, piece long, lo long, hi long, mixed boolean, ascending boolean"))
    want = {}
    for i, _, street, n in asked:
        fit = [r for r in ranges if r[1] == street and (n is None or r[3] <= n <= r[4] and (r[5] or n % 2 == r[3] % 2))]
        if fit:
            _, _, piece, lo, hi, _, up = min(fit, key=lambda r: r[2])
            t = 0.5 if n is None else (n - lo + 0.5) / (hi - lo + 1)
            want[i] = (piece, round(t if up or n is None else 1 - t, 9))
    assert {r.id: (r.piece, round(r.t, 9)) for r in got.collect()} == want


def test_geocoding_makes_no_pairs(spark):
    w = F.col("id")
    ranges = spark.range(200_000).select(F.lit(1).alias("place"), F.lit(1).alias("street"), w.alias("piece"), (w % 40).alias("lo"), (w % 40 + 60).alias("hi"), F.lit(True).alias("mixed"), F.lit(True).alias("ascending"))
    asked = spark.range(200_000).select("id", F.lit(1).alias("place"), F.lit(1).alias("street"), (w % 90).alias("n"))
    began = time.time()  # as pairs of a number and a piece these are 4e10
    assert addresses.geocode(asked, ranges).agg(F.count("*"), F.sum("piece")).first()[0] == 200_000
    assert time.time() - began < 30


def test_points_on_borders(spark):
    """Of points on the sides and corners of two touching squares none is inside, or all are; else each is in one."""
    rings = [(a, 0, k, x + 10 * a, y) for a in (0, 1) for k, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10)])]
    edges = spatial.ring_edges(spark.createDataFrame(rings, "area int, ring int, pos int, x long, y long"), ["area"])
    points = spark.createDataFrame([(x * 100 + y, x, y) for x in range(0, 21) for y in range(0, 11)], "id long, x long, y long")
    inside = lambda border: {(r.id, r.area) for r in spatial.containing_areas(points, edges, ["id"], ["area"], 4, border).collect()}
    assert inside(False) == {(x * 100 + y, a) for a in (0, 1) for x in range(10 * a + 1, 10 * a + 10) for y in range(1, 10)}
    assert inside(True) == {(x * 100 + y, a) for a in (0, 1) for x in range(10 * a, 10 * a + 11) for y in range(11)}
    assert len(inside(None)) == 200


def test_numbers_meet_segments_across_cells(spark):
    """Cells of any size, smaller than the reach too, give the nearest segment within it."""
    rng = random.Random(5)
    pieces = [(f"p{i}", 0, "A", 0.0, 100.0, x, y, x + rng.uniform(-900, 900), y + rng.uniform(-900, 900)) for i in range(60) for x, y in [(rng.uniform(-9000, 9000), rng.uniform(-9000, 9000))]]
    numbers = [(i, i % 5, "A", rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for i in range(120)]
    rows = spark.createDataFrame(pieces, "piece string, pos int, name string, before double, total double, ax double, ay double, bx double, by double")
    asked = spark.createDataFrame(numbers, "id long, n int, name string, x double, y double")

    def away(x, y, ax, ay, bx, by):
        t = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    want = {i: best[1] for i, _, _, x, y in numbers if (best := min((away(x, y, *p[5:]), p[0]) for p in pieces))[0] <= addresses.NUMBER_REACH}
    for size in (256, 1024, 32768):
        assert {r.id: r.piece for r in addresses.match_numbers(asked, rows, size).collect()} == want, size


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_that_can_be_nearest_are_few(seed):
    """Of many segments beside a number those at the smallest distance are found, ties too, and hardly others."""
    rng = np.random.default_rng(seed)
    points = np.vstack([rng.uniform(0, 30_000, (900, 2)), np.full((40, 2), 7000.0), rng.normal(9000, 5, (60, 2))])
    start = rng.uniform(-5000, 35_000, (3000, 2))
    segments = np.hstack([start, start + rng.normal(0, 4000, (3000, 2))])
    segments = np.vstack([segments, segments[:50], [[7000, 7000, 7000, 7000], [7000, 7000, 8000, 7000], [9000, 9000, 9000, 9000]]])
    for reach in (addresses.NUMBER_REACH, 30.0):
        step = segments[:, 2:] - segments[:, :2]
        off = points[:, None] - segments[:, :2]
        t = np.clip((off * step).sum(2) / np.maximum((step * step).sum(1), 1e-9), 0, 1)
        d = np.hypot(*np.moveaxis(off - t[:, :, None] * step, 2, 0))
        want = set(zip(*np.nonzero((d <= d.min(1)[:, None] + 1e-6) & (d <= reach))))
        got = set(zip(*addresses.nearest_segments(points, segments, reach)))
        assert want <= got and len(got) <= len(want) + 5


def test_numbers_of_full_cells(spark, monkeypatch):
    """Cells with many pairs and cells with few give the same rows."""
    rng = random.Random(8)
    pieces = [(f"p{i}", i % 3, rng.choice("AB"), 5.0, 100.0, x, y, x + rng.uniform(-900, 900), y + rng.uniform(-900, 900)) for i in range(90) for x, y in [(rng.uniform(-4000, 4000), rng.uniform(-4000, 4000))]]
    numbers = [(i, i % 5, rng.choice(["A", "B", None]), rng.uniform(-4000, 4000), rng.uniform(-4000, 4000)) for i in range(150)]
    rows = spark.createDataFrame(pieces, "piece string, pos int, name string, before double, total double, ax double, ay double, bx double, by double")
    asked = spark.createDataFrame(numbers, "id long, n int, name string, x double, y double")
    found = []
    for most in (0, 20, 10**9):
        monkeypatch.setattr(addresses, "MOST_PAIRS", most)
        found.append(sorted(map(tuple, addresses.match_numbers(asked, rows, 2048).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 50


def test_a_touched_cell_has_no_part(spark):
    """A line that turns where a cell's margin ends has no part there, along either axis."""
    line = [(1, 1, 50, 150, 50, 110), (1, 2, 50, 110, 50, 150), (1, 3, 50, 150, 50, 50)]
    for points in (line, [(w, p, ay, ax, by, bx) for w, p, ax, ay, bx, by in line]):
        got = spatial.cut_with_margin(spark.createDataFrame(points, "way int, pos int, ax long, ay long, bx long, by long"), ["way"], 100, 10)
        assert {(r.part, r.pos) for r in got.collect() if (r.cx, r.cy) == (0, 0)} == {(1, 3)}


WIDE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["way_points_dropped", "way_points_whole", "way_means", "candidates"])
def test_large_way_tables_take_more_tasks(spark, monkeypatch, name):
    """Tables with more rows than the session's partitions are meant for go to more tasks, with the same rows."""
    rounded = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
    usual = rounded(registry.QUERIES[name](spark, WIDE))
    monkeypatch.setattr(tables, "PER_PARTITION", 500)
    dealt = registry.QUERIES[name](spark, WIDE)
    assert rounded(dealt) == usual and "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()


def test_points_of_ways_meet_in_as_many_tasks_as_they_need(spark):
    refs = spark.range(3_000_000).select((F.col("id") / 5).cast("long").alias("way"), F.col("id").alias("pos"), F.col("id").alias("node"))
    nodes = spark.range(3_000_000).select("id", F.col("id").alias("lon"), F.col("id").alias("lat"))
    for missing in ("drop_point", "drop_way", "keep"):
        got = entities.way_points(refs, nodes, missing, 3_000_000)
        assert got.rdd.getNumPartitions() == 6 and got.count() == 3_000_000, missing


def test_many_areas_take_more_tasks(spark, monkeypatch):
    """Areas are assembled in more tasks where their segments are many, with the same rows."""
    dealt, spread = [], tables.spread
    rows = lambda: sorted(map(str, registry.QUERIES["assembled_areas"](spark, WIDE).collect()))
    usual = rows()
    monkeypatch.setattr(tables, "PER_PARTITION", 300)
    monkeypatch.setattr(areas, "spread", lambda df, n, *keys: dealt.append(keys) or spread(df, n, *keys))
    assert rows() == usual and ("area", "x", "y") in dealt


def test_search_bounds_distances_by_a_sample(monkeypatch):
    """Of many segments across a cell a number meets a small share."""
    rng, met, hypot = np.random.default_rng(3), [0], np.hypot
    points, segments = rng.uniform(0, 32_768, (1600, 2)), rng.uniform(0, 32_768, (72_000, 4))

    def counted(a, b):
        met[0] += max(np.size(a), np.size(b))
        return hypot(a, b)

    monkeypatch.setattr(addresses.np, "hypot", counted)
    found, _ = addresses.nearest_segments(points, segments, addresses.NUMBER_REACH)
    assert set(found) == set(range(1600)) and met[0] < 0.1 * 1600 * 72_000


def test_segments_are_placed_once(spark, monkeypatch):
    """The cells of a segment are made distinct in its row and written; numbers meet the table, not the steps that make it."""
    seen, write = {}, addresses.materialize

    def kept(df, name):
        seen[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(addresses, "materialize", kept)
    rows = spark.createDataFrame([(f"p{i}", 0, "A", 0.0, 9.0, i * 50.0, 0.0, i * 50.0 + 5000, 4000.0) for i in range(20)], "piece string, pos int, name string, before double, total double, ax double, ay double, bx double, by double")
    numbers = spark.createDataFrame([(1, 5, "A", 2500.0, 2000.0), (2, 6, "A", 90_000.0, 0.0)], "id long, n int, name string, x double, y double")
    assert [r.id for r in addresses.match_numbers(numbers, rows, 2048).collect()] == [1]
    assert "Exchange" not in seen["segments_placed"]


def test_few_queries_are_sent_to_keys(spark):
    """Keys stay where they are, and no more of a long one goes along than queries can tell apart."""
    index = spark.createDataFrame([(i, "abc" + "x" * i) for i in range(50)], "id long, key string")
    found = addresses.prefix_search(index, spark.createDataFrame([("ab",), ("abc",), ("abcx",), ("ab",)], "query string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan and "substring(key" in plan
    assert {(r.query, r.id, r.exact) for r in found.collect()} == {(q, i, q == "abc" + "x" * i) for q in ("ab", "abc", "abcx") for i in range(50) if q != "abcx" or i}
