"""Points with names: order-dependent deduplication, names that tell places apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import close_pairs
from .tables import drop_table, materialize


def greedy_kept(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node`` kept and ``node`` dropped among the ends of ``pairs`` (``a < b``), going in order: a node goes if an earlier kept one is
    paired with it.

    In rounds: nodes without an undecided earlier partner stay, what is paired with them goes. Nothing is gathered in one
    task; the number of rounds is the longest run of decisions that wait for each other."""
    left = materialize(pairs.select("a", "b").distinct(), "pairs")
    kept = dropped = None
    while not left.isEmpty():
        keep = left.select(F.col("a").alias("node")).distinct().join(left.select(F.col("b").alias("node")), "node", "left_anti")
        keep = materialize(keep, "kept")
        drop = materialize(left.join(keep.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct(), "dropped")
        decided = keep.unionByName(drop)
        rest = left.join(decided.withColumnRenamed("node", "a"), "a", "left_anti").join(drop.withColumnRenamed("node", "b"), "b", "left_anti")
        kept, dropped = (keep, drop) if kept is None else (kept.unionByName(keep), dropped.unionByName(drop))
        rest = materialize(rest.select("a", "b"), "pairs")
        drop_table(left)
        left = rest
    drop_table(left)
    if kept is None:
        none = pairs.select(F.col("a").alias("node")).limit(0)
        return none, none
    return kept, dropped


def drop_repeats(points: DataFrame, distance: int, by: list[str], key: str = "id", name: str | None = None) -> DataFrame:
    """Drop each point (in ``key`` order) less than ``distance`` on both axes from an earlier kept one that is equal in ``by``.

    With ``name``, points whose column of that name is null or empty stay and make no other go."""
    named = points if name is None else points.filter(F.coalesce(F.col(name) != "", F.lit(False)))
    _, dropped = greedy_kept(close_pairs(named, distance, key, by, "open_box"))
    return points.join(dropped.withColumnRenamed("node", key), key, "left_anti")


#: Farthest apart that points of one name count as one place, in map units (5 km); fixed value.
SAME_PLACE = 5000.0 / 0.149
#: Choices of levels (of 5, 6, 7, 8, counted from 0) in the order in which they are tried; fixed values.
LEVEL_CHOICES = ((1,), (2,), (3,), (0,), (1, 3), (2, 3), (0, 3), (1, 2))


def first_point_clusters(items: DataFrame, by: list[str], distance: float = SAME_PLACE) -> DataFrame:
    """``items`` (``id, x, y``) with ``cluster``: the id of the first point, in id order, that opened a cluster nearer than ``distance``;
    a point without one opens its own."""
    pairs = close_pairs(items, distance, "id", by, "open")
    openers_dropped = greedy_kept(pairs)[1]
    opens = items.join(openers_dropped.withColumnRenamed("node", "id"), "id", "left_anti").select(F.col("id").alias("a"))
    joins = pairs.join(opens, "a").join(openers_dropped.withColumnRenamed("node", "b"), "b").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("_opener"))
    return items.join(joins, "id", "left").withColumn("cluster", F.coalesce("_opener", "id")).drop("_opener")


def place_names(items: DataFrame) -> DataFrame:
    """``id, label``: the names under which places are shown.

    ``items``: ``id, name, x, y, region`` and ``levels``, the names of the four admin areas below the region around the point. A name
    gets its region in brackets; where a region holds several places of a name (clusters of ``SAME_PLACE``), also the areas of the first
    choice of levels with the fewest clashes. Names that end in a bracket stay as they are. A clash is a point without any area, or
    one whose areas were first seen in another cluster of the name."""
    plain = items.filter(~F.endswith("name", F.lit(")")))
    below = F.transform("levels", lambda n: F.when((n != F.col("name")) & ~n.eqNullSafe(F.col("region")), n))
    clusters = materialize(first_point_clusters(plain.withColumn("levels", below), ["name", "region"]), "clusters")
    several = clusters.groupBy("name", "region").agg(F.min("cluster").alias("_l"), F.max("cluster").alias("_m")).filter("_l <> _m").select("name", "region")
    many = clusters.alias("c").join(several.alias("s"), F.col("c.name").eqNullSafe(F.col("s.name")) & F.col("c.region").eqNullSafe(F.col("s.region")), "left_semi")
    label = lambda choice: F.array(*[F.get("levels", F.lit(i)) for i in choice])
    tried = many.select("id", "name", "region", "cluster", F.posexplode(F.array(*[F.struct(label(c).alias("areas")) for c in LEVEL_CHOICES])).alias("choice", "x")).select("id", "name", "region", "cluster", "choice", "x.areas")
    owner = tried.groupBy("name", "region", "choice", "areas").agg(F.min_by("cluster", "id").alias("owner"), F.count("*").alias("n"))
    met = tried.groupBy("name", "region", "choice", "areas", "cluster").agg(F.count("*").alias("n"))
    null_safe = lambda l, r, cs: [F.col(f"{l}.{c}").eqNullSafe(F.col(f"{r}.{c}")) for c in cs]
    joined = met.alias("m").join(owner.alias("o"), null_safe("m", "o", ["name", "region", "choice", "areas"]))
    none = F.forall(F.col("m.areas"), lambda a: a.isNull())
    clashes = joined.groupBy("m.name", "m.region", "m.choice").agg(F.sum(F.when(none | (F.col("m.cluster") != F.col("o.owner")), F.col("m.n")).otherwise(0)).alias("clashes"))
    best = clashes.groupBy("name", "region").agg(F.min_by("choice", F.struct("clashes", "choice")).alias("choice"))
    chosen = tried.alias("t").join(best.alias("b"), null_safe("t", "b", ["name", "region", "choice"]), "left_semi").select("id", "areas")
    parts = F.array_compact(F.concat(F.array("region"), F.coalesce("areas", F.array().cast("array<string>"))))
    distinct = F.filter(parts, lambda p, i: (i == 0) | (p != F.get(parts, i - 1)))
    shown = F.when(F.endswith("name", F.lit(")")) | (F.size(distinct) == 0), F.col("name")).otherwise(F.concat("name", F.lit(" ("), F.array_join(distinct, ", "), F.lit(")")))
    return items.join(chosen, "id", "left").select("id", shown.alias("label"))
