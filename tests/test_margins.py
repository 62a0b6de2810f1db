"""Lines cut with a margin, boundaries with a buffer and raster windows against plain loops."""

import math
import random

import numpy as np

from tessella.operators import raster, spatial


def test_lines_stand_in_every_cell_whose_margin_they_touch(spark):
    rng = random.Random(2)
    lines = {0: [(0.0, 0.0), (0.0, 400.0)], 1: [(95.0, 5.0), (95.0, 305.0), (105.0, 305.0)], 2: [(200.0, 200.0), (200.0, 200.0)], 3: [(-50.0, -50.0), (350.0, 350.0)], 4: [(0.0, 100.0), (300.0, 100.0)]}
    lines |= {i: [(rng.uniform(-300, 300), rng.uniform(-300, 300)) for _ in range(6)] for i in range(5, 15)}
    rows = [(k, i, *a, *b) for k, p in lines.items() for i, (a, b) in enumerate(zip(p, p[1:]), 1)]
    got = {(r.line, r.cx, r.cy, r.pos) for r in spatial.cut_with_margin(spark.createDataFrame(rows, "line int, pos int, ax double, ay double, bx double, by double"), ["line"], 100, 10.0).collect()}

    def touches(ax, ay, bx, by, x0, y0, x1, y1):
        t0, t1 = 0.0, 1.0
        for p, q in ((ax - bx, ax - x0), (bx - ax, x1 - ax), (ay - by, ay - y0), (by - ay, y1 - ay)):
            if p == 0 and q < 0:
                return False
            if p:
                t0, t1 = (max(t0, q / p), t1) if p < 0 else (t0, min(t1, q / p))
        return t0 <= t1

    assert got == {(k, cx, cy, i) for k, i, *s in rows for cx in range(-5, 6) for cy in range(-5, 6) if touches(*s, cx * 100 - 10, cy * 100 - 10, cx * 100 + 110, cy * 100 + 110)}


def test_packed_lines_and_parts(spark):
    rows = [(1, i, *a, *b) for i, (a, b) in enumerate([((15.0, 15.0), (250.0, 15.0)), ((250.0, 15.0), (250.0, 50.0)), ((250.0, 50.0), (15.0, 50.0))], 1)] + [(2, 1, 7.2, 7.2, 7.4, 7.4)]
    got = {(r.line, r.cx, r.cy, r.part): r.points for r in spatial.placed_lines(spark.createDataFrame(rows, "line int, pos int, ax double, ay double, bx double, by double"), ["line"], 100, 10).collect()}
    assert sorted(got) == [(1, 0, 0, 1), (1, 0, 0, 2), (1, 1, 0, 1), (1, 1, 0, 2), (1, 2, 0, 1)]  # nothing is left of line 2
    assert [(p >> 16, p & 0xFFFF) for p in got[1, 0, 0, 1]] == [(25, 25), (25, 120)] and len(got[1, 2, 0, 1]) == 4


def test_cells_near_a_boundary(spark):
    rings = [(0, False, [(120.0, 120.0), (980.0, 180.0), (860.0, 930.0), (150.0, 700.0)]), (1, True, [(300.0, 300.0), (800.0, 320.0), (760.0, 780.0), (310.0, 600.0)]), (2, False, [(1500.0, 1500.0), (1500.0, 1503.0), (1503.0, 1500.0)])]
    rows = [(k, h, i, *p) for k, h, pts in rings for i, p in enumerate(pts)]
    got = {(r.cx, r.cy) for r in spatial.buffered_cells(spark.createDataFrame(rows, "ring int, hole boolean, pos int, x double, y double"), 50, 60.0).collect()}
    edges = [(a, b) for _, _, pts in rings for a, b in zip(pts, pts[1:] + pts[:1])]

    def inside(x, y, pts):
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1])) % 2 == 1

    def near(cx, cy):
        for (ax, ay), (bx, by) in edges:
            n = max(2, int(math.hypot(bx - ax, by - ay)) * 4)
            for k in range(n + 1):
                x, y = ax + (bx - ax) * k / n, ay + (by - ay) * k / n
                if math.hypot(max(cx * 50 - x, x - cx * 50 - 50, 0), max(cy * 50 - y, y - cy * 50 - 50, 0)) <= 60:
                    return True
        x, y = cx * 50 + 25, cy * 50 + 25
        return any(inside(x, y, p) for _, h, p in rings if not h) and not any(inside(x, y, p) for _, h, p in rings if h)

    assert got == {(cx, cy) for cx in range(-2, 36) for cy in range(-2, 36) if near(cx, cy)} and (11, 10) not in got


def test_filtered_levels_of_a_whole_image(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (32, 32))
    tiles = [(r, c, image[r * 4 : r * 4 + 4, c * 4 : c * 4 + 4].ravel().tolist()) for r in range(8) for c in range(8)]
    got = raster.filtered_levels(spark.createDataFrame(tiles, "tile_row long, tile_col long, z array<int>"), 4).collect()
    for level in (1, 2, 3):
        w = raster.lanczos_weights(32, 1 << level)
        assert np.allclose(w.sum(1) / (1 << raster.WEIGHT_BITS), 1, atol=1e-5)
        clip = lambda v: np.clip((v + (1 << 21)) >> 22, 0, 255)
        want = clip(w @ clip(image @ w.T))
        side = 8 >> level
        assert sum(r.level == level for r in got) == side * side
        for r in got:
            if r.level == level:
                assert r.z == want[r.tile_row * 4 : r.tile_row * 4 + 4, r.tile_col * 4 : r.tile_col * 4 + 4].ravel().tolist()


def test_profiles_take_the_edge_and_windows_are_zero_off_the_grid(spark):
    tiles = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0, 4.0]), (0, 1, [5.0, 6.0, 7.0, 8.0])], "tile_row long, tile_col long, z array<double>")
    points = spark.createDataFrame([("a", 2, 0.0, 0.0), ("a", 1, -9.0, 9.0), ("a", 3, 0.0, 0.5)], "line string, pos int, r double, c double")
    got = [(r.pos, round(r.cm, 1), round(r.up, 1), round(r.down, 1)) for r in raster.height_profile(points, tiles, 2, 2, 4, "line").orderBy("pos").collect()]
    assert got == [(1, 599.9, 0.0, 0.0), (2, 100.0, 0.0, 499.9), (3, 150.0, 50.0, 0.0)]
    regions = spark.createDataFrame([(7, 0.0, 0.0, 1.0, 1.0), (8, 90.0, 90.0, 1.0, 1.0)], "region int, r0 double, c0 double, dr double, dc double")
    windows = {r.region: np.reshape(r.z, (4, 4)) for r in raster.region_windows(regions, tiles, 2, 2, 4, 2).collect()}
    assert not windows[8].any() and not windows[7][0].any() and not windows[7][:, 0].any() and windows[7][1, 1] == 1.0 and abs(windows[7][1, 2] - 2.0) < 1e-9
