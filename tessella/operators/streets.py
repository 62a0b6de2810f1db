"""Streets from pieces, the places they are looked up under, place groups of index cells and typed search results."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.grid import CELL, METRES_PER_UNIT
from .addresses import SETTLEMENT_METRES, SUBURB_METRES, best_places
from .components import components
from .spatial import BLOCK, with_nearest
from .tables import materialize

# Fixed values of the map model.
#: Side of the cells of the search index, in cells and in map units.
INDEX_CELLS = 8
INDEX_CELL = INDEX_CELLS * CELL
#: Ends of one street's pieces are no farther apart, in map units (60 m).
JOIN_REACH = 60.0 / 0.149
#: Postal towns of a street in an index cell: so many, with so large a share of its addresses.
MOST_TOWNS, TOWN_SHARE = 3, 0.25
#: Farthest node of a postal town, in metres.
TOWN_METRES = 30000.0
#: Places of a street: so many, with so large a share of its length.
MOST_PLACES, PLACE_SHARE = 12, 0.1
#: Middle latitude at which distances between places are compared.
MIDDLE_LATITUDE = 54.0
# ---- end of fixed values ----
#: Pieces of one name in an index cell that a task joins; more are joined by tables.
MOST_PIECES = 1_000_000
#: Offsets of half of the cells around one: with all of them each pair of cells meets once.
_HALF = [(dx, dy) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]


def index_cell(c: Column) -> Column:
    """The index cell of a cell, along one axis."""
    return F.floor(c / INDEX_CELLS).cast("long")


def streets(pieces: DataFrame, reach: float = JOIN_REACH, carry: tuple[str, ...] = ()) -> DataFrame:
    """``piece, street`` and the columns of ``pieces`` named by ``carry``: pieces (``piece, name, cx, cy`` and ends ``x0, y0, x1, y1``) of one name and index cell that chains of ends within
    ``reach`` join; the street is its smallest piece. Pieces without a name are left out.

    Ends in one square whose diagonal is ``reach`` belong together anyway, so squares are joined, not ends: by the pieces between them
    and by pairs of ends in squares near each other. Ends that coincide count once, so junctions make no pairs. The pieces of a name in an
    index cell, which no street leaves, are one group; groups of more than ``MOST_PIECES`` are joined by tables."""
    keys = ["name", "ix", "iy"]
    own = pieces.filter("name IS NOT NULL").select("piece", "name", index_cell(F.col("cx")).alias("ix"), index_cell(F.col("cy")).alias("iy"), "cx", "cy", "x0", "y0", "x1", "y1", *(c for c in carry if c not in ("name", "cx", "cy", "x0", "y0", "x1", "y1")))
    large = materialize(own.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > MOST_PIECES).select(*keys), "large_names")
    schema = StructType([StructField("piece", own.schema["piece"].dataType), StructField("street", own.schema["piece"].dataType), *(own.schema[c] for c in carry)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        at = np.column_stack([table.column(c).to_numpy().astype(float) for c in ("x0", "y0", "x1", "y1")])
        piece = table.column("piece")
        return pa.Table.from_arrays([piece, piece.take(pa.array(first_joined(at, reach))), *(table.column(c) for c in carry)], ["piece", "street", *carry])

    if large.isEmpty():
        return own.groupBy(*keys).applyInArrow(run, schema)
    small = own.join(large, keys, "left_anti").groupBy(*keys).applyInArrow(run, schema)
    rest = own.join(large, keys, "left_semi")
    joined = _streets_by_tables(rest, reach)
    return small.unionByName(joined.join(rest.select("piece", *carry), "piece") if carry else joined)


def first_joined(ends: np.ndarray, reach: float) -> np.ndarray:
    """For each piece (``x0, y0, x1, y1``) the place of the first one that chains of ends within ``reach`` join to it."""
    spots, at = np.unique(ends.reshape(-1, 2), axis=0, return_inverse=True)
    squares, of = np.unique(np.floor(spots / (reach / math.sqrt(2))).astype(np.int64), axis=0, return_inverse=True)
    at, of = at.reshape(-1), of.reshape(-1)
    order = np.argsort(of, kind="stable")
    size = np.bincount(of, minlength=len(squares))
    start = np.cumsum(size) - size
    squares = squares - squares.min(0) + 2  # so that no square beside one is negative
    width = int(squares[:, 1].max()) + 3
    code = squares[:, 0] * width + squares[:, 1]  # rising, as the squares are sorted
    root = np.arange(len(squares))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
            while (root[root] != root).any():
                root = root[root]

    of_ends = of[at].reshape(-1, 2)
    join(of_ends[:, 0], of_ends[:, 1])
    for dx, dy in _HALF:
        other = code + dx * width + dy
        found = np.minimum(np.searchsorted(code, other), len(code) - 1)
        a = np.flatnonzero(code[found] == other)
        b = found[a]
        # the pairs of ends of two squares, some at a time, as one that is near is enough
        done, most = np.zeros(len(a), np.int64), 64
        while len(a):
            open_ = (root[a] != root[b]) & (done < size[a] * size[b])
            a, b, done = a[open_], b[open_], done[open_]
            for lo in range(0, len(a), max(1, BLOCK // most)):
                part = slice(lo, lo + max(1, BLOCK // most))
                u, v, n = a[part], b[part], np.minimum(most, size[a[part]] * size[b[part]] - done[part])
                pair = np.repeat(np.arange(len(u)), n)
                k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + done[part][pair]
                p, q = spots[order[start[u[pair]] + k // size[v[pair]]]], spots[order[start[v[pair]] + k % size[v[pair]]]]
                near = np.unique(pair[((p - q) ** 2).sum(1) <= reach * reach])
                join(u[near], v[near])
            done, most = done + most, min(most * 8, BLOCK)
    label = root[of_ends[:, 0]]
    first = np.full(len(squares), len(ends))
    np.minimum.at(first, label, np.arange(len(ends)))
    return first[label]


def _streets_by_tables(pieces: DataFrame, reach: float) -> DataFrame:
    """``streets`` for a name with any number of pieces in an index cell: squares are nodes of a graph that is contracted."""
    side = reach / math.sqrt(2)
    at = [F.concat_ws("\x1f", F.col("name").cast("string"), "ix", "iy", "gx", "gy").alias("spot")]
    square = {"gx": F.floor(F.col("end.x") / side), "gy": F.floor(F.col("end.y") / side)}
    own = pieces.filter("name IS NOT NULL").select("piece", "name", index_cell(F.col("cx")).alias("ix"), index_cell(F.col("cy")).alias("iy"), F.posexplode(F.array(
        F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("which", "end")).withColumns(square)
    ends = own.select("name", "ix", "iy", "gx", "gy", "end.x", "end.y").distinct()
    home = ends.select("name", "ix", "iy", "gx", "gy", F.col("x").alias("ax"), F.col("y").alias("ay"), *at)
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _HALF])
    other = ends.select("name", "ix", "iy", "x", "y", at[0].alias("other"), "gx", "gy", F.explode(steps).alias("s"))
    other = other.withColumns({"gx": F.col("gx") + F.col("s.dx"), "gy": F.col("gy") + F.col("s.dy")})
    dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    near = home.join(other, ["name", "ix", "iy", "gx", "gy"]).filter(dx * dx + dy * dy <= reach * reach).select(F.col("spot").alias("a"), F.col("other").alias("b")).distinct()
    spots = own.groupBy("piece").agg(F.min_by(at[0], "which").alias("a"), F.max_by(at[0], "which").alias("b"))
    label = components(ends.select(at[0].alias("node")), near.unionByName(spots.select("a", "b")))
    joined = spots.select("piece", F.col("a").alias("node")).join(label, "node")
    first = joined.groupBy("component").agg(F.min("piece").alias("street"))
    return joined.join(first, "component").select("piece", "street")


def postal_towns(hits: DataFrame, pieces: DataFrame, most: int = MOST_TOWNS, share: float = TOWN_SHARE) -> DataFrame:
    """``name, ix, iy, city, rank``: the most frequent postal towns of a street name in an index cell.

    ``hits``: ``piece, city, seq`` for each matched number, and ``name, cx, cy`` of its piece, where they are at hand; towns that are as frequent come in the order in
    which ``seq`` shows them first."""
    at = hits.filter("city IS NOT NULL")
    if "name" not in hits.columns:
        at = at.join(pieces.select("piece", "name", "cx", "cy"), "piece")
    n = at.groupBy("name", index_cell(F.col("cx")).alias("ix"), index_cell(F.col("cy")).alias("iy"), F.trim("city").alias("city")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    w = Window.partitionBy("name", "ix", "iy")
    ranked = n.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "first", "city")), "total": F.sum("n").over(w)})
    return ranked.filter((F.col("rank") <= most) & (F.col("n") >= share * F.col("total"))).select("name", "ix", "iy", "city", "rank")


def place_alternatives(pieces: DataFrame, places: DataFrame, hits: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``piece, k, alt, ax, ay``: the places that a piece can be looked up under, in order, with the node that each is anchored at.

    First "Town, Suburb" (anchored at the suburb), if a settlement and a suburb of another name are within their radii, then the
    settlement, or else the suburb; then the postal towns of the street, anchored at the nearest node of that name within ``TOWN_METRES`` of
    the piece's middle, if there is one. ``pieces``: ``piece, name, cx, cy`` and the middle ``x, y``; ``places``: ``p, place, name, x, y``; ``hits``: as in
    ``postal_towns``. ``carry``: columns of ``pieces`` that go along, so that nothing is joined by piece again: pieces move once for their settlement and
    suburb, and once for each postal town."""
    node = F.struct(F.col("name").cast("string").alias("alt"), F.col("x").alias("ax"), F.col("y").alias("ay")).alias("node")
    points = pieces.select(F.col("piece").alias("q"), *carry, "name", index_cell(F.col("cx")).alias("ix"), index_cell(F.col("cy")).alias("iy"), "x", "y")
    rows = best_places(points, places.select("p", "place", "x", "y", node), {"town": SETTLEMENT_METRES, "suburb": SUBURB_METRES})
    rows = rows.withColumnsRenamed({"q": "piece"}).withColumns({"town": F.col("town.node"), "suburb": F.col("suburb.node")})
    full = F.when(F.col("town.alt") != F.col("suburb.alt"), F.struct(F.concat("town.alt", F.lit(", "), "suburb.alt").alias("alt"), F.col("suburb.ax").alias("ax"), F.col("suburb.ay").alias("ay")))
    # a table of names and cells, written so that it can be sent out where it is small
    known = materialize(postal_towns(hits, pieces).groupBy("name", "ix", "iy").agg(F.array_sort(F.collect_list(F.struct("rank", "city"))).alias("towns")), "towns")
    rows = rows.withColumn("own", F.array_compact(F.array(full, F.coalesce("town", "suburb")))).join(known, ["name", "ix", "iy"], "left")
    other = F.filter("towns", lambda t: ~F.array_contains(F.transform("own", lambda o: o.getField("alt")), t.getField("city")))
    rows = materialize(rows.select("piece", *carry, "x", "y", "own", F.coalesce(F.transform(other, lambda t: t.getField("city")), F.array().cast("array<string>")).alias("towns")), "pieces_placed")
    squeezed = F.cos(F.radians(F.lit(MIDDLE_LATITUDE)))
    asked = rows.select("piece", *carry, F.size("own").alias("n"), F.posexplode("towns").alias("t", "alt"), (F.col("x") * squeezed).alias("x"), "y").select("piece", *carry, (F.col("n") + F.col("t")).alias("k"), "alt", "x", "y")
    known = places.select("p", F.col("name").cast("string").alias("alt"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") * squeezed).alias("x"), "y")
    met = with_nearest(asked, known, TOWN_METRES / METRES_PER_UNIT, ["alt"], "piece")
    near = F.sqrt("d2") * METRES_PER_UNIT < TOWN_METRES
    met = met.select("piece", *carry, "k", "alt", F.when(near, F.col("ax")).alias("ax"), F.when(near, F.col("ay")).alias("ay"))
    own = rows.select("piece", *carry, F.posexplode("own").alias("k", "o")).select("piece", *carry, "k", "o.alt", "o.ax", "o.ay")
    return own.unionByName(met)


def street_places(pieces: DataFrame, street: DataFrame, alternatives: DataFrame, most: int = MOST_PLACES, share: float = PLACE_SHARE) -> DataFrame:
    """``street, i, alt, ax, ay, weight``: the places of each street in their order, weighed by the lengths of its pieces.

    ``pieces``: ``piece, length``; ``street``: ``piece, street``, or none where ``pieces`` has it; ``alternatives``: ``piece, k, alt, ax, ay``, and ``street, length`` where they
    went along. By falling weight (ties: first seen, in the order of pieces
    and alternatives) each name is taken once, with the anchor that weighs most; the first one, and others with ``share`` of the street's length.
    Of names "Town, Suburb" only the first is taken, while there is room; it stands before the others (``most``), which go by name."""
    weight = F.col("length").cast("long") + 1
    members = pieces.select("piece", "length", "street") if street is None else pieces.select("piece", "length").join(street, "piece")
    totals = members.groupBy("street").agg(F.sum(weight).alias("total"))
    voting = alternatives if "street" in alternatives.columns else members.join(alternatives, "piece")
    # dealt by street once: sums, ranks and totals then meet where they lie
    votes = voting.repartition("street").groupBy("street", "alt", "ax", "ay").agg(F.sum(weight).alias("weight"), F.min(F.struct("piece", "k")).alias("seen"))
    whole = Window.partitionBy("street")
    order = (F.desc("weight"), "seen")
    ranked = votes.join(totals, "street").withColumns({
        "rank": F.row_number().over(whole.orderBy(*order)), "again": F.row_number().over(Window.partitionBy("street", "alt").orderBy(*order)), "suburb": F.contains("alt", F.lit(", "))})
    ranked = ranked.filter((F.col("again") == 1) & ((F.col("rank") == 1) | (F.col("weight") >= share * F.col("total"))))
    before = F.coalesce(F.count_if(~F.col("suburb")).over(whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumns({"before": before, "n": F.row_number().over(Window.partitionBy("street", "suburb").orderBy("rank"))})
    kept = ranked.filter((F.col("before") < most) & (~F.col("suburb") | (F.col("n") == 1)))
    return kept.withColumn("i", F.row_number().over(whole.orderBy(F.desc("suburb"), "alt")) - 1).select("street", "i", "alt", "ax", "ay", "weight")


def grouped_names(pieces: DataFrame, street: DataFrame, places: DataFrame, sort_key: Column) -> DataFrame:
    """``ix, iy, grp, alts, name, offset``: street names by index cell and group. A group is a set of places (of ``street_places``) that streets
    of the cell share; groups are numbered by their places, the empty one first, and names go by ``sort_key`` (an expression of ``name``).
    ``offset``: four bytes for every word before a name, in all groups of its cell."""
    return groups_of(named_streets(pieces, street, places), sort_key)


def groups_of(named: DataFrame, sort_key: Column) -> DataFrame:
    """``grouped_names`` of streets with their places (``named_streets``). Sets of places are numbered by themselves, names then go by numbers."""
    cell = Window.partitionBy("ix", "iy")
    sets = named.select("ix", "iy", "alts").distinct()
    sets = sets.withColumn("grp", F.row_number().over(cell.orderBy(F.transform("alts", lambda a: a.getField("alt")), "alts")) - 1)
    rows = named.select("ix", "iy", "alts", "name").distinct().join(sets, ["ix", "iy", "alts"]).withColumn("_key", sort_key)
    words = F.size(F.split(F.trim("name"), r"\s+"))
    # words of the groups before one, and in it those before a name: a task holds the numbers of a cell's groups and the names of one group
    inside = Window.partitionBy("ix", "iy", "grp")
    total = rows.groupBy("ix", "iy", "grp").agg(F.sum(words).alias("_words"))
    total = total.select("ix", "iy", "grp", (F.sum("_words").over(cell.orderBy("grp").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_words")).alias("_before"))
    before = F.coalesce(F.sum(words).over(inside.orderBy("_key", "name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(total, ["ix", "iy", "grp"]).withColumn("offset", (4 * (F.col("_before") + before)).cast("long"))
    return rows.select("ix", "iy", "grp", "alts", "name", "offset")


def piece_offsets(pieces: DataFrame, street: DataFrame, places: DataFrame, sort_key: Column) -> DataFrame:
    """``piece, grp, offset``: where each piece's name stands in the table of its index cell."""
    named = materialize(named_streets(pieces, street, places), "streets_named")
    return offsets_of(pieces, street, named, groups_of(named, sort_key)).select("piece", "grp", "offset")


def offsets_of(pieces: DataFrame, street: DataFrame | None, named: DataFrame, groups: DataFrame) -> DataFrame:
    """``pieces`` with the cell, group and offset of their names: sets of places meet by street, pieces only by the number of theirs."""
    of = ["street", "name", "ix", "iy"]
    at = named.join(groups, ["ix", "iy", "name", "alts"]).select(*of, "grp", "offset")
    return _celled(pieces, street).join(at, of)


def _celled(pieces: DataFrame, street: DataFrame | None) -> DataFrame:
    rows = pieces if street is None else pieces.join(street, "piece")
    return rows.withColumns({"ix": index_cell(F.col("cx")), "iy": index_cell(F.col("cy"))})


def named_streets(pieces: DataFrame, street: DataFrame | None, places: DataFrame) -> DataFrame:
    """``street, name, ix, iy, alts``: streets with their places, at most ``MOST_PLACES`` and one. ``street``: ``piece, street``, or none where ``pieces`` has it."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "alt", "ax", "ay"))), lambda p: F.struct(*[p.getField(c).alias(c) for c in ("alt", "ax", "ay")]))
    rows = _celled(pieces, street).select("street", "name", "ix", "iy").distinct().join(places.groupBy("street").agg(listed.alias("alts")), "street", "left")
    none = F.array().cast("array<struct<alt:string,ax:double,ay:double>>")
    return rows.select("street", "name", "ix", "iy", F.coalesce("alts", none).alias("alts"))


def search_results(groups: DataFrame, nodes: DataFrame, districts: DataFrame) -> DataFrame:
    """``typ, name, x, y, cells``: what the search index holds. ``cells``: sorted, with the offsets of street names where a result has some.

    0: a place with streets, for each name and anchor in ``groups`` (of ``grouped_names``), at its anchor or else the mean of its cells.
    1: a postcode district, for each ``pc`` in ``districts`` (``pc, x, y, ix, iy, offset`` for each number), at the mean of the numbers' points.
    2: a place node (``nodes``: ``name, x, y``) that no street is looked up under, each name and point once."""
    centre = lambda c: (F.avg(c) + 0.5) * INDEX_CELL
    cell = lambda offsets: F.struct("ix", "iy", offsets.alias("offsets"))
    none = F.array().cast("array<long>")
    at = groups.select("ix", "iy", F.explode("alts").alias("a")).select("a.*", "ix", "iy").distinct()
    with_streets = at.groupBy("alt", "ax", "ay").agg(F.array_sort(F.collect_list(cell(none))).alias("cells"), centre("ix").alias("mx"), centre("iy").alias("my"))
    with_streets = with_streets.select(F.lit(0).alias("typ"), F.col("alt").alias("name"), F.coalesce("ax", "mx").alias("x"), F.coalesce("ay", "my").alias("y"), "cells")
    tables = districts.groupBy("pc", "ix", "iy").agg(F.array_sort(F.collect_set("offset")).alias("offsets"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    mean = lambda s: F.sum(s) / F.sum("n")
    codes = tables.groupBy("pc").agg(F.array_sort(F.collect_list(cell(F.col("offsets")))).alias("cells"), mean("sx").alias("x"), mean("sy").alias("y"))
    codes = codes.select(F.lit(1).alias("typ"), F.col("pc").alias("name"), "x", "y", "cells")
    used = at.filter("ax IS NOT NULL").select(F.col("alt").alias("name"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    alone = nodes.select(F.col("name").cast("string").alias("name"), "x", "y").distinct().join(used, ["name", "x", "y"], "left_anti")
    alone = alone.select(F.lit(2).alias("typ"), "name", "x", "y", F.array().cast(with_streets.schema["cells"].dataType).alias("cells"))
    return with_streets.unionByName(codes).unionByName(alone)
