"""Layer tables: write by tile, read back, describe, compare, keep older tiles, choose what to build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["layer", "tile_x", "tile_y", "cx", "cy"]


def cells(objects: DataFrame) -> DataFrame:
    """Rows of ``KEY`` and ``item`` (a text form of an object) to one row per cell with its items in order; a cell is bounded."""
    return objects.groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("items"))


def write(layer: DataFrame, path: str) -> None:
    """Partitioned by layer and tile; neighbouring tiles share files' tasks, so that no tile is spread over many files."""
    layer.repartitionByRange("layer", "tile_x", "tile_y").sortWithinPartitions(*KEY).write.partitionBy("layer", "tile_x", "tile_y").mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if layer is None else rows.filter(F.col("layer") == layer)


def statistics(layer: DataFrame) -> DataFrame:
    """Tiles, cells and items by layer."""
    return layer.groupBy("layer").agg(F.countDistinct("tile_x", "tile_y").alias("tiles"), F.count("*").alias("cells"), F.sum(F.size("items")).cast("long").alias("items"))


def digests(layer: DataFrame) -> DataFrame:
    return layer.select(*KEY, F.md5(F.array_join("items", "\n")).alias("digest"))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells that two builds don't share: missing, extra or changed."""
    both = digests(old).withColumnRenamed("digest", "old").join(digests(new).withColumnRenamed("digest", "new"), KEY, "full_outer")
    status = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "extra").when(F.col("old") != F.col("new"), "changed")
    return both.withColumn("status", status).filter("status IS NOT NULL").select(*KEY, "status")


def with_older_tiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new build, and the old build's tiles where the new one has none."""
    tile = KEY[:3]
    return new.unionByName(old.join(new.select(*tile).distinct(), tile, "left_anti").select(*new.columns))


def dump(objects: DataFrame, columns: list[str]) -> DataFrame:
    """One canonical line per object: fields without tabs and line breaks, tab-joined."""
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\n\r]", " ") for c in columns]
    return objects.select(F.concat_ws("\t", *clean).alias("line"))


def write_dump(objects: DataFrame, columns: list[str], path: str) -> None:
    """The canonical dump: all lines of ``dump``, sorted over all files, so that two builds can be compared line by line."""
    dump(objects, columns).orderBy("line").write.mode("overwrite").text(path)


def canonical_order(objects: DataFrame, tags: list[str]) -> DataFrame:
    """Objects (``x, y`` and tag columns) in their canonical order: by position, then by tags, an absent tag before all others."""
    return objects.orderBy("x", "y", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tags])


def append_report(report: DataFrame, path: str) -> None:
    """Add rows (``region, status``) to the report of runs that ``work_list`` reads."""
    report.write.mode("append").parquet(path)


def work_list(regions: DataFrame, report: DataFrame, largest: int) -> DataFrame:
    """Regions (``region, size``) not yet built (``region, status``) and not too large."""
    return regions.join(report.filter("status = 'ok'").select("region").distinct(), "region", "left_anti").filter(F.col("size") <= largest)


def build(inputs: dict[str, DataFrame], builders: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], path: str, only: list[str] | None = None) -> list[tuple[str, str]]:
    """Write the chosen layers, each from the shared inputs; the report says which came out empty."""
    report = []
    for name, builder in builders.items():
        if only is None or name in only:
            layer = builder(inputs)
            layer.write.mode("overwrite").parquet(f"{path}/{name}")
            report.append((name, "empty" if layer.sparkSession.read.parquet(f"{path}/{name}").isEmpty() else "ok"))
    return report


def match_rates(ours: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Objects at equal positions, and the share with equal values by column."""
    both = ours.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns]).join(other.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns]), keys)
    return both.agg(F.count("*").alias("matched"), *[F.round(F.avg(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).cast("double")), 6).alias(f"same_{c}") for c in columns])


def region_codes(regions: DataFrame, codes: DataFrame, aliases: DataFrame) -> DataFrame:
    """``id, code``: by the region's own id, else its alias, else its full name, else the name's first word."""
    by = lambda source, key, name: source.select(F.col(key).alias(name), F.col("code").alias(f"c_{name}"))
    r = regions.withColumn("head", F.get(F.split("name", " "), 0))
    r = r.join(by(codes, "key", "id"), "id", "left").join(by(aliases, "key", "name"), "name", "left").withColumn("full", F.col("name")).join(by(codes, "key", "full"), "full", "left").join(by(codes, "key", "head"), "head", "left")
    return r.select("id", "parent", F.coalesce("c_id", "c_name", "c_full", "c_head").alias("code"))


def replaced_parents(coded: DataFrame) -> DataFrame:
    """Regions to build: a parent gives way to its children if every one of them has a code."""
    children = coded.filter("parent IS NOT NULL").groupBy("parent").agg(F.bool_and(F.col("code").isNotNull()).alias("complete"))
    split = children.filter("complete").select(F.col("parent").alias("id"))
    tops = coded.filter("parent IS NULL").join(split, "id", "left_anti").filter("code IS NOT NULL")
    parts = coded.join(split.withColumnRenamed("id", "parent"), "parent", "left_semi")
    return tops.select("id", "code").unionByName(parts.select("id", "code"))
