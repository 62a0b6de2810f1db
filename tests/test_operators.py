"""Rules, text and assembly on single cases; file sources on files made here."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import grid, rules, text
from tessella.operators import areas, lines, places, raster, spatial
from tessella.operators.components import components
from tessella.sources import files, osm


def one(spark, column, **values):
    row = spark.createDataFrame([(1,)], "i int")
    return row.select(column.alias("x")).first().x


def tags(**kv):
    return F.create_map(*[F.lit(x) for k, v in kv.items() for x in (k.replace("__", ":"), v)])


@pytest.mark.parametrize("kv,node,want", [
    (dict(amenity="cafe", shop="bicycle"), True, 1), (dict(amenity="place_of_worship", shop="bicycle"), True, None), (dict(amenity="place_of_worship", religion="jewish"), True, 0x24),
    (dict(aeroway="aerodrome"), True, 0x27), (dict(aeroway="aerodrome"), False, None), (dict(historic="wall"), True, None), (dict(historic="ruins"), True, 0x48), (dict(aerialway="t-bar"), True, 0x2D),
    (dict(man_made="tower", tower__type="observation"), True, 0x0F), (dict(amenity="charging_station", bicycle="yes"), True, 0x28)])
def test_poi_type(spark, kv, node, want):
    assert one(spark, rules.poi_type(tags(**kv), F.lit(node))) == want


def test_road_rules(spark):
    road = tags(highway="residential", surface="asphalt", lanes="2", oneway="yes")
    assert one(spark, rules.road_class(road)) == 7
    assert one(spark, rules.tag_flags(road)) == 1 << 7 | 1 << 9 | 1 << 11 | 2 << 13
    assert one(spark, rules.tag_flags(tags(foot="yes", bicycle="dismount", cycleway="lane"))) == 3 << 7 | 3 << 9 | 1 << 29 | 1 << 30 | 1 << 31
    assert one(spark, rules.road_class(tags(highway="steps", area="yes"))) is None and one(spark, rules.road_class(tags(route="ferry"))) == 9
    assert tuple(one(spark, rules.passable(tags(oneway="yes", cycleway="opposite"), F.lit(7)))) == (True, True)
    assert tuple(one(spark, rules.area_class(tags(landuse="forest", natural="water")))) == ("c5", 6)
    assert one(spark, rules.area_class(tags(natural="water", water="river"))) is None


@pytest.mark.parametrize("value,want", [("12a", [12]), ("12 – 14", [12, 14]), ("12-16", [12, 16]), ("Flat 3", []), ("12abc", []), ("", []), ("\u00a012a\t", [12])])
def test_house_numbers(spark, value, want):
    assert one(spark, text.house_numbers(F.lit(value))) == want


@pytest.mark.parametrize("value,want", [("SW1A 1AA", "SW1A"), ("1234 AB", "1234"), ("London", None), ("46325;46326", None), ("k1a 0b1", "K1A")])
def test_postcodes(spark, value, want):
    assert one(spark, text.postcode_key(F.lit(value))) == want


@pytest.mark.parametrize("value,want", [("King's Lynn", ["kings", "kings lynn", "lynn"]), ("Borken (Nordrhein-Westfalen)", ["borken"]), ("Ærø, Søby", ["aro", "soby"]), ("Đà Nẵng ﬁn Ｔｏｋｙｏ", ["a", "a nang fin tokyo", "fin", "nang", "tokyo"])])
def test_search_keys(spark, value, want):
    assert one(spark, text.search_keys(F.lit(value))) == want


def test_units(spark):
    assert one(spark, grid.unit_x(F.lit(0))) == 2**27 and one(spark, grid.unit_y(F.lit(0))) == 2**26


def square(x, y, n=2):
    p = [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    return [(min(a, b), max(a, b)) for a, b in zip(p, p[1:] + p[:1])]


def test_rings(spark):
    """Outlines of random unions of unit squares: rings are simple and closed, depths alternate, areas and segments add up."""
    rng = np.random.default_rng(6)
    shapes, rows = {}, []
    for area in range(12):
        grid_ = rng.random((9, 9)) < 0.55
        shapes[area] = grid_
        for x, y in zip(*np.nonzero(grid_)):
            rows += [(area, *map(int, (*p, *q))) for p, q in square(x, y, 1)]
    rows += [(50, *p, *q) for p, q in square(0, 0, 9) + square(1, 1, 5) + square(2, 2, 1)] + [(60, *p, *q) for p, q in square(0, 0)[:3]] + [(70, *p, *q) for p, q in square(0, 0) + square(2, 2)]
    df = spark.createDataFrame(rows, "area int, xa bigint, ya bigint, xb bigint, yb bigint")
    rings, open_ = areas.assemble(df, "area")
    assert [r.area for r in open_.collect()] == [60]
    got = {}
    for r in rings.collect():
        got.setdefault(r.area, []).append((r.depth, r.parent, r.ring, [tuple(p) for p in r.points]))
    assert sorted((d, p) for d, p, _, _ in got[50]) == [(0, -1), (1, 0), (2, 1)] and [len(p) for *_, p in got[70]] == [4, 4]
    for area, shape in shapes.items():
        assert sum(areas.twice_area(p) for *_, p in got[area]) == 2 * int(shape.sum())
        used = [tuple(sorted(s)) for *_, p in got[area] for s in zip(p, p[1:] + p[:1])]
        pairs = {}
        for row in (r for r in rows if r[0] == area):
            s = tuple(sorted((row[1:3], row[3:5])))
            pairs[s] = pairs.get(s, 0) + 1
        assert sorted(used) == sorted(s for s, n in pairs.items() if n % 2)
        by_number = {ring: d for d, _, ring, _ in got[area]}
        for depth, parent, _, p in got[area]:
            assert len(p) == len(set(p)) >= 4 and p[0] == min(p) and (areas.twice_area(p) > 0) == (depth % 2 == 0)
            assert (parent == -1) == (depth == 0) and (parent == -1 or by_number[parent] == depth - 1)
    assert areas.twice_area(areas.normal_ring([(0, 0), (0, 2), (2, 2), (2, 0)], True)) == 8


def test_clipping(spark):
    assert areas.twice_area(areas.clip_ring_to_box([(0, 0), (10, 0), (10, 10), (0, 10)], 5, 5, 20, 20)) / 2 == 25
    s = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 50.0), (1, 2, 100.0, 50.0, 0.0, 50.0), (1, 3, -5.0, -5.0, -1.0, -1.0)], "way int, pos int, ax double, ay double, bx double, by double")
    parts = spatial.chain_parts(spatial.clip_segments(s, F.lit(10), F.lit(0), F.lit(80), F.lit(60)), ["way"]).collect()
    assert [(r.pos, r.part, round(r.t0, 3), round(r.t1, 3)) for r in sorted(parts, key=lambda r: r.pos)] == [(1, 1, 0.1, 0.8), (2, 2, 0.2, 0.9)]


def test_pairs_and_components(spark):
    rng = np.random.default_rng(1)
    xy = rng.integers(-500, 500, (300, 2))
    df = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(xy)] + [(300, 0, 0), (301, 0, 0)], "id int, x int, y int")
    full = np.vstack([xy, [[0, 0], [0, 0]]])
    got = {(r.a, r.b) for r in spatial.close_pairs(df, 40).collect()}
    assert got == {(i, j) for i in range(302) for j in range(i + 1, 302) if ((full[i] - full[j]) ** 2).sum() <= 1600}
    names = ["a", "b", None, ""]
    named = df.withColumn("name", F.element_at(F.array(*map(F.lit, names)), F.col("id") % 4 + 1))
    kept = sorted(r.id for r in places.drop_repeats(named, 40, ["name"], name="name").collect())
    want = []
    for i in range(302):
        if i % 4 > 1 or all(np.abs(full[i] - full[j]).max() >= 40 for j in want if j % 4 == i % 4):
            want.append(i)
    assert kept == want
    assert places.drop_repeats(named.filter("id = 0"), 40, ["name"]).count() == 1
    label = {r.node: r.component for r in components(df.select(F.col("id").alias("node")), spark.createDataFrame([(5, 3), (3, 9), (9, 1)], "a int, b int")).collect()}
    assert [label[i] for i in (1, 3, 5, 9, 7)] == [1, 1, 1, 1, 7]


def test_place_names(spark):
    """The rule written out point by point: clusters round first points, then the first choice of levels with the fewest clashes."""
    rng = np.random.default_rng(9)
    items = [(i, f"Berg {rng.integers(6)}" + (" (Old)" if i % 31 == 0 else ""), float(rng.integers(0, 150_000)), float(rng.integers(0, 150_000)), ["North", "South", None][i % 3],
              [None if rng.random() < 0.3 else f"L{k} {rng.integers(2 + 3 * k)}" for k in range(4)]) for i in range(200)]
    got = {r.id: r.label for r in places.place_names(spark.createDataFrame(items, "id int, name string, x double, y double, region string, levels array<string>")).collect()}
    extra, groups = {i: [] for i, *_ in items}, {}
    for i, name, *_, region, _ in items:
        if not name.endswith(")"):
            groups.setdefault((name, region), []).append(i)
    for (name, region), members in groups.items():
        openers, cluster = [], {}
        for i in members:
            near = [o for o in openers if np.hypot(items[o][2] - items[i][2], items[o][3] - items[i][3]) < places.SAME_PLACE]
            if not near:
                openers.append(i)
            cluster[i] = near[0] if near else i
        if len(openers) < 2:
            continue
        below = {i: [n if n not in (name, region) else None for n in items[i][5]] for i in members}
        def clashes(choice):
            seen, n = {}, 0
            for i in members:
                label = tuple(below[i][k] for k in choice)
                n += all(x is None for x in label) or seen.setdefault(label, cluster[i]) != cluster[i]
            return n
        best = min(places.LEVEL_CHOICES, key=clashes)
        for i in members:
            for k in best:
                if below[i][k] is not None and extra[i][-1:] != [below[i][k]]:
                    extra[i].append(below[i][k])
    for i, name, *_, region, _ in items:
        parts = [p for p in [region, *extra[i]] if p is not None]
        assert got[i] == (name if name.endswith(")") or not parts else f"{name} ({', '.join(parts)})")


def test_shedding_stops_or_fails(spark):
    from tessella.operators import roads

    ends = spark.createDataFrame([(w, 0, 2 * w + k, 0, 0, None if w < 5 else 1 + w % 4) for w in range(20) for k in (0, 1)], "way int, edge int, node int, bx int, by int, rank int")
    assert {r.way for r in roads.shed(ends, 27, 100).collect()} == {w for w in range(20) if w < 5 or w % 4 > 1}
    assert {r.way for r in roads.shed(ends, 11, 100).collect()} == set(range(5))
    with pytest.raises(ValueError):
        roads.shed(ends, 10, 100)


def test_simplification():
    assert lines.douglas_peucker(np.array([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)], float), 1.0).tolist() == [True, False, True, True, True]


def test_smoothing(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(24, 16))
    tiles = spark.createDataFrame([(r, c, z[r * 8 : r * 8 + 8, c * 8 : c * 8 + 8].ravel().tolist()) for r in range(3) for c in range(2) if (r, c) != (1, 1)], raster.TILE_SCHEMA)
    z[8:16, 8:16] = 0
    w = raster.kernel(1.0)
    pad = np.pad(z, 4, mode="symmetric")
    v = sum(k * pad[i : i + 24] for i, k in enumerate(w))
    want = sum(k * v[:, i : i + 16] for i, k in enumerate(w))
    for t in raster.smooth(tiles, 8, 3, 2).collect():
        assert np.allclose(np.reshape(t.z, (8, 8)), want[t.tile_row * 8 : t.tile_row * 8 + 8, t.tile_col * 8 : t.tile_col * 8 + 8])


def test_quantisation(spark):
    z = [-3.5, 0.0, 812.25, 4000.125]
    q = one(spark, raster.quantised(F.array(*map(F.lit, z))))
    assert np.allclose([(v / q.a0 + q.a1) / 6 - 1000 for v in q.v], z, atol=1 / 6 / q.a0)


def test_compensated_sum(spark):
    rng = np.random.default_rng(3)
    values = [1e16, 1.0, -1e16, *(rng.normal(size=200) * 10.0 ** rng.integers(-8, 9, 200)).tolist()]
    got = spark.createDataFrame([(values,), ([],)], "v array<double>").select(grid.compensated_sum(F.col("v")).alias("s"), grid.compensated_mean(F.col("v")).alias("m")).collect()
    assert got[0].s == sum(values) and got[0].m == sum(values) / len(values) and got[1].s == 0 and got[1].m is None  # sum() compensates alike


def test_rasterise_star_and_grid(spark, tmp_path):
    """A self-crossing ring by the even-odd rule at pixel centres, and a small one left out; stored tiles read by box."""
    star = [(50 + 45 * np.sin(4 * np.pi * k / 5), 50 - 45 * np.cos(4 * np.pi * k / 5)) for k in range(5)]
    rows = [(1, 7, star), (2, 8, [(3.0, 3.0), (3.4, 3.0), (3.2, 3.4)])]
    df = spark.createDataFrame([(p, i, [{"x": float(x), "y": float(y)} for x, y in r]) for p, i, r in rows], "paint int, ink int, points array<struct<x:double,y:double>>")
    want = set()
    for r in range(-5, 105):
        for c in range(-5, 105):
            x, y = c + 0.5, r + 0.5
            n = sum((ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in zip(star, star[1:] + star[:1]))
            if n % 2:
                want.add((r, c, 7))
    assert {tuple(r) for r in raster.rasterise(df, 1.0).collect()} == want
    tiles = spark.createDataFrame([(r, c, [float(r * 10 + c)]) for r in range(4) for c in range(4)], raster.TILE_SCHEMA)
    raster.write_grid(tiles, str(tmp_path / "grid"))
    assert {(r.tile_row, r.tile_col) for r in raster.read_grid(spark, str(tmp_path / "grid"), (1, 2, 0, 1)).collect()} == {(1, 0), (1, 1), (2, 0), (2, 1)}


def test_overview_chains_by_class(spark):
    """Every line is a path of one class whose inner nodes have two edges of that class; every edge is in one line; thinning keeps the ends."""
    rng = np.random.default_rng(8)
    edges = [(w, 0, int(w % 3), int(a), int(b)) for w, (a, b) in enumerate(rng.integers(0, 60, (70, 2))) if a != b]
    nodes = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 1000, (60, 2)))]
    e, n = spark.createDataFrame(edges, "way int, edge int, class int, a bigint, b bigint"), spark.createDataFrame(nodes, "node bigint, x double, y double")
    paths = {}
    for r in lines.simplified_chains(e, n, -1.0).orderBy("class", "chain", "line", "pos").collect():
        paths.setdefault((r["class"], r.chain, r.line), []).append(r.node)
    degree = {}
    for _, _, cls, a, b in edges:
        for v in (a, b):
            degree[(cls, v)] = degree.get((cls, v), 0) + 1
    used = sorted((cls, *sorted(p)) for (cls, _, _), path in paths.items() for p in zip(path, path[1:]))
    assert used == sorted((cls, *sorted((a, b))) for _, _, cls, a, b in edges)
    for (cls, _, _), path in paths.items():
        assert all(degree[(cls, v)] == 2 for v in path[1:-1]) and (path[0] == path[-1] or degree[(cls, path[0])] != 2 and degree[(cls, path[-1])] != 2)
    thin = {}
    for r in lines.simplified_chains(e, n, 300.0).orderBy("class", "chain", "line", "pos").collect():
        thin.setdefault((r["class"], r.chain, r.line), []).append(r.node)
    assert set(thin) == set(paths) and all(thin[k][0] == p[0] and thin[k][-1] == p[-1] and len(thin[k]) <= len(p) for k, p in paths.items())


def test_layers_are_built_and_read(spark, tmp_path):
    from tessella.sources import extracts, layers

    nodes = spark.createDataFrame([(1, 10, 20, {"amenity": "cafe", "name": "A"}), (2, 11, 21, {"addr:housenumber": "5", "addr:street": "S"}), (3, 12, 22, {"place": "town", "name": "T"}), (4, 13, 23, {})], "id bigint, lon bigint, lat bigint, tags map<string,string>")
    ways = spark.createDataFrame([(7, [1, 2], {"highway": "residential", "name": "R"}), (8, [2, 3], {"natural": "coastline", "place": "islet"}), (9, [1, 2, 3, 1], {"landuse": "forest"}), (10, [1], {"building": "yes"})], "id bigint, refs array<bigint>, tags map<string,string>")
    relations = spark.createDataFrame([(20, {"type": "multipolygon", "tourism": "zoo"}), (21, {"type": "route", "landuse": "forest"})], "id bigint, tags map<string,string>")
    builders = {"poi": lambda i: extracts.points_of_interest(i["n"], i["w"], i["r"]), "street": lambda i: extracts.streets(i["w"]), "area": lambda i: extracts.areas(i["w"], i["r"]), "coast": lambda i: extracts.coast(i["w"]),
                "address": lambda i: extracts.addresses(i["n"]), "place": lambda i: extracts.places(i["n"]), "none": lambda i: extracts.places(i["n"].limit(0))}
    path = str(tmp_path / "build")
    report = layers.build({"n": nodes, "w": ways, "r": relations}, builders, path)
    assert dict(report) == {k: "empty" if k == "none" else "ok" for k in builders} and layers.build({"n": nodes}, builders, path, only=["place"]) == [("place", "ok")]
    of = lambda name, *cs: {tuple(r) for r in spark.read.parquet(f"{path}/{name}").select(*cs).collect()}
    assert of("poi", "kind", "id") == {("n", 1), ("r", 20)} and of("street", "id", "class", "name") == {(7, 7, "R")} and of("area", "kind", "id") == {("w", 9), ("r", 20)}
    assert of("coast", "id", "islet") == {(8, True)} and of("address", "id", "hn", "street") == {(2, "5", "S")} and of("place", "id", "place") == {(3, "town")}
    objects = spark.createDataFrame([("poi", x // 4, y // 4, x, y, f"{x}:{y}:{k}") for x in range(6) for y in range(6) for k in range(2)], "layer string, tile_x int, tile_y int, cx int, cy int, item string")
    layers.write(layers.cells(objects), str(tmp_path / "layer"))
    back = layers.read(spark, str(tmp_path / "layer"), "poi")
    assert layers.compare(layers.cells(objects), back).count() == 0 and layers.statistics(back).first()[1:] == (4, 36, 72)
    layers.write_dump(nodes.withColumn("name", F.col("tags")["name"]), ["id", "name", "lon"], str(tmp_path / "dump"))
    assert [r.value for r in spark.read.text(str(tmp_path / "dump")).coalesce(1).collect()] == sorted(["1\tA\t10", "2\t\t11", "3\tT\t12", "4\t\t13"])
    order = layers.canonical_order(spark.createDataFrame([(2, 1, "b"), (1, 5, None), (1, 5, "a"), (2, 1, "a")], "x int, y int, t string"), ["t"]).collect()
    assert [tuple(r) for r in order] == [(1, 5, None), (1, 5, "a"), (2, 1, "a"), (2, 1, "b")]
    layers.append_report(spark.createDataFrame([("A", "ok")], "region string, status string"), str(tmp_path / "report"))
    layers.append_report(spark.createDataFrame([("B", "failed")], "region string, status string"), str(tmp_path / "report"))
    left = layers.work_list(spark.createDataFrame([("A", 1), ("B", 1), ("C", 99)], "region string, size int"), spark.read.parquet(str(tmp_path / "report")), 50)
    assert [r.region for r in left.collect()] == ["B"]


def test_boundary_file(spark, tmp_path):
    (tmp_path / "a.poly").write_text("name\n1\n   1.0E+01 5.5E+01\n   11.0 55.0\n   11.0 56.0\nEND\n!2\n   10.5 55.2\n   10.6 55.2\n   10.6 55.3\nEND\nEND\n")
    rows = files.boundary(spark, str(tmp_path / "a.poly")).orderBy("ring", "pos").collect()
    assert [(r.ring, r.hole, r.pos, r.x) for r in rows] == [(0, False, 0, 100000000), (0, False, 1, 110000000), (0, False, 2, 110000000), (1, True, 0, 105000000), (1, True, 1, 106000000), (1, True, 2, 106000000)]


def test_region_files(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"features": [{"properties": {"id": "de", "name": "Germany", "urls": {"pbf": "https://x.org/europe/de-latest.osm.pbf"}}}, {"properties": {"id": "by", "parent": "de", "name": "B"}}]}')
    got = {r.id: r for r in files.region_index(spark, str(tmp_path / "i.json")).collect()}
    assert got["de"].path == "europe/de" and got["by"].parent == "de"
    table = spark.createDataFrame([("DE", "North", "p/n"), ("DE", "South", "p/s"), ("FR", "France", "p/f")], "code string, name string, path string")
    files.write_region_table(table, str(tmp_path / "t"))
    assert {(r.code, r.name, r.shared) for r in files.region_table(spark, str(tmp_path / "t")).collect()} == {("DE", "North", True), ("DE", "South", True), ("FR", "France", False)}


def test_elevation_file(spark, tmp_path):
    z = np.arange(12, dtype="<f4").reshape(3, 4)
    entries = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 32), (259, 3, 1, 8), (273, 4, 1, 200), (278, 3, 1, 3), (279, 4, 1, len(zlib.compress(z.tobytes())))]
    head = b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0" * 4
    (tmp_path / "a.tif").write_bytes(head.ljust(200, b"\0") + zlib.compress(z.tobytes()))
    row = files.elevation(spark, str(tmp_path / "a.tif")).first()
    assert (row.rows, row.cols) == (3, 4) and row.z == z.ravel().tolist()


def test_land_file(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    body = struct.pack("<i4dii", 5, 0, 0, 2, 2, 1, 5) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    (tmp_path / "l.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    rows = files.land_rings(spark, str(tmp_path / "l.shp")).orderBy("pos").collect()
    assert [(r.x, r.y) for r in rows] == ring and not rows[0].hole
    assert files.land_rings(spark, str(tmp_path / "l.shp"), (5, 5, 6, 6)).count() == 0


def message(*parts):
    def varint(v):
        v &= (1 << 64) - 1
        out = b""
        while True:
            out += bytes([v & 127 | (128 if v > 127 else 0)])
            v >>= 7
            if not v:
                return out
    out = b""
    for number, value in parts:
        if isinstance(value, list):
            value = b"".join(varint(v) for v in value)
        out += varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)
    return out


def test_entity_source(spark, tmp_path):
    zig = lambda v: v << 1 if v >= 0 else (-v << 1) - 1
    strings = message(*[(1, s) for s in (b"", b"amenity", b"cafe", b"outer")])
    dense = message((1, [zig(10), zig(5)]), (8, [zig(550000000), zig(100)]), (9, [zig(90000000), zig(-50)]), (10, [1, 2, 0, 0]))
    way = message((1, 77), (2, [1]), (3, [2]), (8, [zig(10), zig(5)]))
    relation = message((1, 99), (8, [3]), (9, [zig(77)]), (10, [1]))
    block = message((1, strings), (2, message((2, dense))), (2, message((3, way))), (2, message((4, relation))))
    blob = message((3, zlib.compress(block)), (2, len(block)))
    header = message((1, b"OSMData"), (3, len(blob)))
    path = tmp_path / "x.pbf"
    path.write_bytes(struct.pack(">I", len(header)) + header + blob)
    osm.ingest(spark, str(path), str(tmp_path / "some"), F.col("tags")["amenity"] == "bar")
    assert [x.count() for x in osm.read_entities(spark, str(tmp_path / "some"))] == [2, 0, 0]
    osm.ingest(spark, str(path), str(tmp_path / "out"))
    nodes, ways, relations = osm.read_entities(spark, str(tmp_path / "out"))
    assert sorted((r.id, r.lon, r.lat, r.tags) for r in nodes.collect()) == [(10, 90000000, 550000000, {"amenity": "cafe"}), (15, 89999950, 550000100, {})]
    assert ways.first().refs == [10, 15] and relations.first().members[0].ref == 77 and relations.first().members[0].role == "outer"


def test_seamarks(spark):
    from tessella.functions import seamarks

    def seamark(**kv):
        row = spark.createDataFrame([({k.replace("__", ":"): v for k, v in kv.items()},)], "tags map<string,string>").withColumn("kind", F.col("tags")["seamark:type"])
        kind, t = F.col("kind"), F.col("tags")
        row = row.withColumn("ls", seamarks.lights(t))
        ls = F.col("ls")
        return row.select(seamarks.category(kind, t).alias("category"), seamarks.body_colour(kind, t).alias("colour"), seamarks.topmark(t).alias("top"), seamarks.attributes(kind, t, ls).alias("attributes"),
                          seamarks.label(kind, t, ls).alias("label"), seamarks.sectors(ls).alias("sectors")).first()

    buoy = seamark(seamark__type="buoy_lateral", seamark__buoy_lateral__shape="can", seamark__buoy_lateral__colour="red", seamark__buoy_lateral__category="port", seamark__topmark__shape="cylinder",
                   seamark__topmark__colour="red", seamark__light__character="Fl", seamark__light__colour="red", seamark__light__period="3", seamark__light__range="4.0")
    assert (buoy.category, buoy.colour, buoy.top) == (0x0A0100, 0x190, 0x685)
    assert buoy.attributes == "19Port-hand Lateral Buoy|24Fl.R.3s4M" and buoy.label == "5Fl.R.3s4M"
    light = seamark(seamark__type="light_minor", seamark__light__1__character="Oc", seamark__light__1__colour="red", seamark__light__1__period="12", seamark__light__1__range="9", seamark__light__1__sector_start="10",
                    seamark__light__1__sector_end="20", seamark__light__2__colour="white", seamark__light__2__range="12", seamark__light__2__character="Oc", seamark__light__3__colour="green", seamark__fog_signal__category="horn")
    assert light.attributes == "19Light minor|23Horn|24Oc.WRG.12s9-12M" and light.label == "0Horn|5Oc.WRG.12s9-12M"
    assert [(s.colour, s.radius, s.label) for s in light.sectors] == [(1, 0, ""), (3, 370, "Oc.R.12s"), (4, 0, "")]
    assert seamark(seamark__type="rock").attributes == "19Rock|45submerged" and seamark(seamark__type="nothing").category is None
