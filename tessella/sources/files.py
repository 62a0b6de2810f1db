"""File sources: boundary text files, region tables and indexes, elevation rasters, land polygons, entity blobs.

Text and JSON go through Spark's own readers; binary formats are read as whole rows of ``binaryFile`` and decoded in Arrow
batches, so that every file (or blob) is a row of its own and the rest of the work reads Parquet.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import land


def boundary(spark: SparkSession, path: str) -> DataFrame:
    """``file, ring, hole, pos, x, y`` (decimicrodegrees) of ``.poly`` files: a ring per section, ``!`` marks a hole."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    # a section runs from its name to END; the file ends with one END more
    body = F.regexp_replace("value", r"^[^\n]*\n", "")
    sections = text.select("file", F.posexplode(F.split(body, r"\n\s*END\s*(?:\n|$)")).alias("ring", "section")).filter(F.trim("section") != "")
    lines = sections.select("file", "ring", F.startswith(F.trim("section"), F.lit("!")).alias("hole"), F.posexplode(F.split(F.trim("section"), r"\n")).alias("pos", "line")).filter("pos > 0")
    number = lambda i: F.rint(F.regexp_extract(F.trim("line"), r"^(\S+)\s+(\S+)", i).try_cast("double") * 1e7).cast("long")
    return lines.select("file", "ring", "hole", (F.col("pos") - 1).alias("pos"), number(1).alias("x"), number(2).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")


def region_index(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, parent, pbf, path`` of a GeoJSON index of extracts."""
    doc = spark.read.schema("features array<struct<properties:struct<id:string,name:string,parent:string,urls:struct<pbf:string>>>>").json(path, multiLine=True)
    p = doc.select(F.explode("features").alias("f")).select("f.properties.*")
    return p.select("id", "name", "parent", F.col("urls.pbf").alias("pbf"), F.regexp_extract("urls.pbf", r"^[a-z]+://[^/]+/(.*)-latest\.osm\.pbf$", 1).alias("path"))


def region_table(spark: SparkSession, path: str) -> DataFrame:
    """``code, name, path, shared`` of a region list: tab-separated, ``#`` comments, ``*`` before a code that regions share."""
    rows = spark.read.schema("code string, name string, path string").csv(path, sep="\t", comment="#")
    return rows.select(F.ltrim(F.col("code"), F.lit("*")).alias("code"), "name", "path", F.startswith("code", F.lit("*")).alias("shared"))


def write_region_table(regions: DataFrame, path: str) -> None:
    """The list that ``region_table`` reads; codes used more than once get their ``*``."""
    uses = regions.groupBy("code").agg(F.count("*").alias("_n"))
    marked = regions.join(uses, "code").select(F.concat(F.when(F.col("_n") > 1, "*").otherwise(""), "code").alias("code"), "name", "path")
    marked.repartitionByRange(8, "path").sortWithinPartitions("path").write.csv(path, sep="\t", quote="")


def _tiff(data: bytes) -> tuple[int, int, np.ndarray]:
    """Float raster of a tiled or striped GeoTIFF, plain or deflated, with or without the floating-point predictor."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack(order + "I", data[4:8])[0]
    sizes, kinds = {1: 1, 2: 1, 3: 2, 4: 4, 12: 8}, {1: "B", 2: "B", 3: "H", 4: "I", 12: "d"}
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind in sizes:
            place = at + 10 + 12 * i
            if sizes[kind] * n > 4:
                place = struct.unpack(order + "I", data[place : place + 4])[0]
            tags[tag] = struct.unpack(f"{order}{n}{kinds[kind]}", data[place : place + sizes[kind] * n])
    cols, rows = tags[256][0], tags[257][0]
    width, height = (tags[322][0], tags[323][0]) if 322 in tags else (cols, tags.get(278, (rows,))[0])
    offsets, counts = (tags[324], tags[325]) if 324 in tags else (tags[273], tags[279])
    across, out = -(-cols // width), np.zeros((rows, cols), np.float32)
    for i, (a, n) in enumerate(zip(offsets, counts)):
        raw = data[a : a + n] if tags.get(259, (1,))[0] == 1 else zlib.decompress(data[a : a + n])
        r, c = i // across * height, i % across * width
        h = height if 322 in tags else min(height, rows - r)
        if tags.get(317, (1,))[0] == 3:
            planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(h, 4 * width), axis=1, dtype=np.uint8).reshape(h, 4, width)
            block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(">f4").reshape(h, width)
        else:
            block = np.frombuffer(raw, order + "f4").reshape(h, width)
        out[r : r + h, c : c + width] = block[: rows - r, : cols - c]
    return rows, cols, out


def elevation(spark: SparkSession, path: str) -> DataFrame:
    """``file, rows, cols, z`` of float GeoTIFF tiles."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_tiff(bytes(x)) for x in pdf["content"]]
            yield pd.DataFrame({"file": pdf["path"], "rows": [g[0] for g in got], "cols": [g[1] for g in got], "z": [g[2].ravel() for g in got]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, rows int, cols int, z array<float>")


def land_rings(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``record, ring, hole, pos, x, y`` (degrees) of polygon shapefiles; records outside ``box`` (x0, y0, x1, y1) are skipped
    by their stored boxes. Outer rings run clockwise, holes counter-clockwise. A file on a mounted disk is read by ranges of records,
    files in a store one to a task."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in map(bytes, pdf["content"]):
                at, out = land.HEADER_BYTES, []
                while at + 12 <= len(data):
                    record, words = struct.unpack(">ii", data[at : at + 8])
                    out += land.rings_of(record, data[at + 8 : at + 8 + 2 * words], box)
                    at += 8 + 2 * words
                yield pd.DataFrame([(*r[:3], [{"x": x, "y": y} for x, y in r[3]]) for r in out], columns=["record", "ring", "hole", "points"])

    if land.local_path(path):
        rings = land.read_rings(spark, path, box)
    else:
        rings = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, land.RINGS)
    return rings.select("record", "ring", "hole", F.posexplode("points").alias("pos", "p")).select("record", "ring", "hole", "pos", "p.x", "p.y")
