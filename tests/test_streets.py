"""Streets, their places and the search index against the rules written out row by row."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.functions.grid import CELL, METRES_PER_UNIT
from tessella.operators import addresses, streets

PIECE = "piece string, name string, cx long, cy long, x0 double, y0 double, x1 double, y1 double, x double, y double, length long"


def random_pieces(seed, n=150):
    rng = random.Random(seed)
    spots = [(rng.uniform(0, 40_000), rng.uniform(0, 3000)) for _ in range(60)]
    out = []
    for i in range(n):
        (ax, ay), (bx, by) = rng.choice(spots), rng.choice(spots)
        bx, by = bx + rng.choice([0, 0, 200, 390, 403]), by + rng.choice([0, 0, 100])
        out.append((f"p{i:04}", rng.choice(["A", "B of C", "D  E", None]), int(ax // CELL) + rng.choice([0, 8]), 0, ax, ay, bx, by, (ax + bx) / 2, (ay + by) / 2, rng.randrange(100)))
    return out


def brute_streets(pieces, reach=streets.JOIN_REACH):
    root = {p[0]: p[0] for p in pieces if p[1] is not None}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    ends = lambda p: ((p[4], p[5]), (p[6], p[7]))
    for p in pieces:
        for q in pieces:
            if p[0] < q[0] and p[1] is not None and (p[1], p[2] // 8, p[3] // 8) == (q[1], q[2] // 8, q[3] // 8) and any(math.dist(a, b) <= reach for a in ends(p) for b in ends(q)):
                a, b = sorted((of(p[0]), of(q[0])))
                root[b] = a
    return {p: of(p) for p in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_streets_by_ends(spark, seed):
    pieces = random_pieces(seed)
    got = streets.streets(spark.createDataFrame(pieces, PIECE))
    assert {r.piece: r.street for r in got.collect()} == brute_streets(pieces)


@pytest.mark.parametrize("seed", [3, 4])
def test_streets_by_tables(spark, monkeypatch, seed):
    """Names with too many pieces for a task give the same streets, beside names with few."""
    pieces = random_pieces(seed)
    monkeypatch.setattr(streets, "MOST_PIECES", 28)
    assert {r.piece: r.street for r in streets.streets(spark.createDataFrame(pieces, PIECE)).collect()} == brute_streets(pieces)


def test_streets_take_no_rounds_of_tables(spark):
    """A street of 6000 pieces in a row, which tables join in rounds, and dense ends that don't touch."""
    chain = [(f"p{(i * 7) % 6000:05}", "Long", 0, 0, i * 40.0, 0.0, i * 40.0 + 40, 0.0, 0.0, 0.0, 1) for i in range(6000)]
    rng = random.Random(6)
    dense = [(f"q{s}{i:05}", "Dense", 0, 0, *[(s * 900 + rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(2)]) for s in (0, 1) for i in range(1500)]
    dense = [(*r[:4], *r[4], *r[5], 0.0, 0.0, 1) for r in dense]
    rows = spark.createDataFrame(chain + dense, PIECE)
    assert {(r.street, r.n) for r in streets.streets(rows).groupBy("street").agg(F.count("*").alias("n")).collect()} == {("p00000", 6000), ("q000000", 1500), ("q100000", 1500)}
    plan = streets.streets(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # pieces move once, and twelve-fold copies of their ends never


def test_many_ends_in_one_place(spark):
    """A star of pieces makes no pairs of its own."""
    star = [(f"p{i:05}", "Star", 0, 0, 1000.0, 1000.0, 1000.0 + 900 * math.cos(i), 1000.0 + 900 * math.sin(i), 0.0, 0.0, 1) for i in range(3000)]
    assert {r.street for r in streets.streets(spark.createDataFrame(star, PIECE)).collect()} == {"p00000"}
    assert streets.streets(spark.createDataFrame([], PIECE)).count() == 0


def brute_places(members, alternatives, most, share):
    """The rule, an alternative at a time."""
    weight, seen, total = Counter(), {}, 0
    for piece, length in members:
        total += length + 1
        for k, alt in enumerate(alternatives.get(piece, [])):
            weight[alt] += length + 1
            seen.setdefault(alt, (piece, k))
    names, plain, suburb = set(), [], None
    for k, (alt, n) in enumerate(sorted(weight.items(), key=lambda x: (-x[1], seen[x[0]]))):
        if alt[0] in names or len(plain) >= most or (k > 0 and n < share * total):
            continue
        if ", " in alt[0]:
            if suburb is None:
                suburb = alt
                names.add(alt[0])
            continue
        names.add(alt[0])
        plain.append(alt)
    return ([suburb] if suburb else []) + sorted(plain, key=lambda a: a[0])


@pytest.mark.parametrize(("most", "share"), [(12, 0.1), (2, 0.0)])
def test_places_of_streets(spark, most, share):
    rng = random.Random(4)
    members, alternatives = defaultdict(list), {}
    for i in range(200):
        piece = f"p{i:04}"
        members[f"s{rng.randrange(12)}"].append((piece, rng.choice([0, 0, 5, 5, 40])))
        names = rng.sample(["T", "U", "V", "T, a", "T, b", "U, a", "W"], rng.randrange(5))
        alternatives[piece] = [(n, *rng.choice([(1.0, 2.0), (3.0, 4.0), (None, None)])) for n in names]
    rows = spark.createDataFrame([(p, n) for m in members.values() for p, n in m], "piece string, length long")
    street = spark.createDataFrame([(p, s) for s, m in members.items() for p, _ in m], "piece string, street string")
    alts = spark.createDataFrame([(p, k, *a) for p, al in alternatives.items() for k, a in enumerate(al)], "piece string, k int, alt string, ax double, ay double")
    got = defaultdict(list)
    for r in streets.street_places(rows, street, alts, most, share).orderBy("street", "i").collect():
        got[r.street].append((r.alt, r.ax, r.ay))
    assert got == {s: p for s, m in members.items() if (p := brute_places(sorted(m), alternatives, most, share))}


def test_alternatives(spark):
    metres = lambda m: m / METRES_PER_UNIT
    y = 2.0**28 / 4  # the equator, where x and y have one scale
    at = lambda i, x: (f"p{i}", "A", 8 * i, 0, 0.0, 0.0, 0.0, 0.0, x, y, 1)
    pieces = spark.createDataFrame([at(0, 0.0), at(1, metres(4000)), at(2, metres(90_000)), at(3, metres(200_000))], PIECE)
    places = [(1, "town", "Town", 0.0, y), (2, "suburb", "Sub", metres(100), y), (3, "suburb", "Town", metres(90_000), y), (4, "city", "Far", metres(230_000), y), (5, "farm", "Post", metres(20_000), y)]
    hits = [("p0", "Post", 1), ("p0", "Post ", 2), ("p0", "Town", 3), ("p1", "Far", 4), ("p1", None, 5), ("p3", "None", 6), ("p3", "B", 7), ("p3", "A", 8), ("p3", "C", 9), ("p3", "D", 10)]
    got = defaultdict(list)
    for r in streets.place_alternatives(pieces, spark.createDataFrame(places, "p int, place string, name string, x double, y double"), spark.createDataFrame(hits, "piece string, city string, seq int")).orderBy("piece", "k").collect():
        got[r.piece].append((r.alt, None if r.ax is None else round(r.ax * METRES_PER_UNIT)))
    assert got == {"p0": [("Town, Sub", 100), ("Town", 0), ("Post", 20_000)], "p1": [("Town", 0), ("Far", None)], "p2": [("Town", 90_000)]}


def test_groups_and_results(spark):
    pieces = spark.createDataFrame([("a", "Main Street", 0, 0), ("b", "Mill", 1, 0), ("c", "Main Street", 9, 0), ("d", "Zoo", 1, 1)], "piece string, name string, cx long, cy long")
    street = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("d", "d")], "piece string, street string")
    places = spark.createDataFrame([("a", 0, "T, S", 5.0, 6.0), ("a", 1, "T", 1.0, 2.0), ("b", 0, "T", 1.0, 2.0), ("c", 0, "T, S", 5.0, 6.0), ("c", 1, "P", None, None)], "street string, i int, alt string, ax double, ay double")
    groups = streets.grouped_names(pieces, street, places, F.lower("name"))
    got = {(r.ix, r.grp, tuple(a.alt for a in r.alts), r.name, r.offset) for r in groups.collect()}
    assert got == {(0, 0, (), "Zoo", 0), (0, 1, ("T",), "Mill", 4), (0, 2, ("T, S", "T"), "Main Street", 8), (1, 0, ("T, S", "P"), "Main Street", 0)}
    assert {(r.piece, r.offset) for r in streets.piece_offsets(pieces, street, places, F.lower("name")).collect()} == {("a", 8), ("b", 4), ("c", 0), ("d", 0)}
    nodes = spark.createDataFrame([("T", 1.0, 2.0), ("T", 1.0, 3.0), ("T", 1.0, 3.0)], "name string, x double, y double")
    districts = spark.createDataFrame([("SW1", 1.0, 1.0, 1, 0, 8), ("SW1", 2.0, 4.0, 0, 0, 4), ("SW1", 3.0, 1.0, 0, 0, 0)], "pc string, x double, y double, ix long, iy long, offset long")
    found = {(r.typ, r.name, r.x, r.y, tuple((c.ix, c.iy, tuple(c.offsets)) for c in r.cells)) for r in streets.search_results(groups, nodes, districts).collect()}
    assert found == {(0, "T, S", 5.0, 6.0, ((0, 0, ()), (1, 0, ()))), (0, "T", 1.0, 2.0, ((0, 0, ()),)), (0, "P", 1.5 * streets.INDEX_CELL, 0.5 * streets.INDEX_CELL, ((1, 0, ()),)),
                     (1, "SW1", 2.0, 2.0, ((0, 0, (0, 4)), (1, 0, (8,)))), (2, "T", 1.0, 3.0, ())}


def test_find_folds_as_the_index_does(spark):
    names = ["Đà Nẵng", "Ｆｕｌｌ", "St. John's", "Åby (Jylland)", "Town, Suburb", "Town", "Suburb", "東京"]
    index = addresses.search_index(spark.createDataFrame([(i, n, i % 3) for i, n in enumerate(names)], "id int, name string, typ int"))
    for i, n in enumerate(names[:-1]):
        best = addresses.find(index, n).first()
        assert (best.id, best.typ, best.exact) == (i, i % 3, True), n
    assert [r.name for r in addresses.find(index, "to").collect()] == ["Town", "Town, Suburb"]
    assert [r.exact for r in addresses.find(index, "town, sub").collect()] == [False]
    assert addresses.find(index, "town, john").isEmpty() and addresses.find(index, "").isEmpty() and addresses.find(index, "東京").isEmpty()


def test_queries_of_every_length(spark):
    keys = ["a" * n for n in (1, 2, 3, 150, 290, 400)] + ["b"]
    index = spark.createDataFrame(list(enumerate(keys)), "id int, key string")
    for asked in (["", "a", "aa", "b", "c", None, "a"], ["a" * n for n in range(1, 301)]):
        got = addresses.prefix_search(index, spark.createDataFrame([(q,) for q in asked], "query string")).collect()
        assert sorted((r.query, r.id, r.exact) for r in got) == sorted({(q, i, q == k) for q in asked if q is not None for i, k in enumerate(keys) if k.startswith(q)})
    assert addresses.prefix_search(index, spark.createDataFrame([], "query string")).count() == 0


def test_alternatives_look_up_places_once(spark):
    """The result reads the places that were found and written; it doesn't search for them again."""
    rows = spark.createDataFrame([r for r in random_pieces(9, 9) if r[1]], PIECE)
    nodes = spark.createDataFrame([(1, "city", "T", 900.0, 10.0), (2, "suburb", "S", 900.0, 10.0)], "p long, place string, name string, x double, y double")
    found = streets.place_alternatives(rows, nodes, rows.select("piece", F.lit("T").alias("city"), F.lit(1).alias("seq")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
