"""Land polygons from shapefiles, read by ranges of records, and their clip to whole tiles.

A Python data source plans a partition for a run of records with about ``TASK_BYTES``; where they begin is in the index file beside
the polygons (``.shx``), or else in the headers of the records, over which the driver steps. A task reads its own range only. The
folder must be mounted on all executors, as for entity extracts; files elsewhere are read whole by ``files.land_rings``.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.areas import clip_ring_to_box

#: Bytes of polygons that a task reads.
TASK_BYTES = 8_000_000
RINGS = "record int, ring int, hole boolean, points array<struct<x:double,y:double>>"

# Fixed values of the format.
HEADER_BYTES, MAGIC, POLYGON = 100, 9994, 5
# ---- end of fixed values ----


def local_path(path: str) -> str | None:
    """The path on this machine's disk, or None for one in a store."""
    bare = path.removeprefix("file://").removeprefix("file:")
    return bare if os.path.isfile(bare) else None


def rings_of(record: int, body: bytes, box: tuple[float, float, float, float] | None) -> Iterator[tuple]:
    """``record, ring, hole, points`` of one record, none if it is no polygon or its stored box lies outside ``box``."""
    if len(body) < 44 or struct.unpack("<i", body[:4])[0] != POLYGON:
        return
    x0, y0, x1, y1 = struct.unpack("<4d", body[4:36])
    if box and (x1 < box[0] or x0 > box[2] or y1 < box[1] or y0 > box[3]):
        return
    parts, points = struct.unpack("<ii", body[36:44])
    starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
    xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    for ring, (a, b) in enumerate(zip(starts, starts[1:])):
        p = xy[a:b] - xy[a]
        hole = bool((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() > 0)
        yield record, ring, hole, [(float(x), float(y)) for x, y in xy[a:b]]


class Records(InputPartition):
    def __init__(self, path: str, places: list[tuple[int, int]]):
        self.path, self.places = path, places


class LandReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.task_bytes = options["path"], int(options.get("taskbytes", TASK_BYTES))
        self.box = tuple(map(float, options["box"].split(","))) if options.get("box") else None

    def places(self) -> list[tuple[int, int]]:
        """Offset and length of every record's contents."""
        index = os.path.splitext(self.path)[0] + ".shx"
        if os.path.isfile(index):
            words = np.fromfile(index, ">i4", offset=HEADER_BYTES).astype(np.int64).reshape(-1, 2)
            return [(2 * at + 8, 2 * n) for at, n in words.tolist()]
        out, at, size = [], HEADER_BYTES, os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            while at + 8 <= size:
                f.seek(at + 4)
                n = 2 * struct.unpack(">i", f.read(4))[0]
                out.append((at + 8, n))
                at += 8 + n
        return out

    def partitions(self) -> list[Records]:
        runs: list[list[tuple[int, int]]] = [[]]
        held = 0
        for at, n in self.places():
            if runs[-1] and held + n > self.task_bytes:
                runs.append([])
                held = 0
            runs[-1].append((at, n))
            held += n
        return [Records(self.path, run) for run in runs]

    def read(self, partition: Records) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for at, n in partition.places:
                f.seek(at - 8)
                head = f.read(8)
                body = f.read(n)
                if len(head) == 8 and len(body) == n:
                    yield from rings_of(struct.unpack(">i", head[:4])[0], body, self.box)


class LandSource(DataSource):
    """Options: ``path``, ``box`` (x0,y0,x1,y1 in degrees), ``taskbytes``."""

    @classmethod
    def name(cls) -> str:
        return "land_polygons"

    def schema(self) -> str:
        return RINGS

    def reader(self, schema) -> LandReader:
        return LandReader(dict(self.options))


def read_rings(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``record, ring, hole, points`` (degrees) of the polygons in a shapefile; records outside ``box`` are skipped by their stored boxes."""
    spark.dataSource.register(LandSource)
    source = spark.read.format(LandSource.name()).option("path", local_path(path) or path).option("taskbytes", task_bytes)
    return (source.option("box", ",".join(map(repr, map(float, box)))) if box else source).load()


def whole_tiles(box: tuple[float, float, float, float], tile: float) -> tuple[float, float, float, float]:
    """The box (x0, y0, x1, y1 in degrees) of the tiles, counted east from 180 W and south from 90 N, that a box touches."""
    x0, y0, x1, y1 = box
    return (float(np.floor((x0 + 180) / tile)) * tile - 180, 90 - (float(np.floor((90 - y0) / tile)) + 1) * tile, (float(np.floor((x1 + 180) / tile)) + 1) * tile - 180, 90 - float(np.floor((90 - y1) / tile)) * tile)


def land_in_tiles(spark: SparkSession, path: str, box: tuple[float, float, float, float], tile: float, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``record, ring, hole, points``: land inside the whole tiles around ``box``, rings clipped to them; rings of fewer than four points and
    what shrinks to nothing are left out."""
    whole = whole_tiles(box, tile)

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cut = [clip_ring_to_box([(p["x"], p["y"]) for p in points], *whole) for points in pdf["points"]]
            pdf = pdf.assign(points=[[{"x": x, "y": y} for x, y in c] for c in cut])
            yield pdf[[len(c) > 2 for c in cut]]

    rings = read_rings(spark, path, whole, task_bytes).filter(F.size("points") >= 4)
    return rings.mapInPandas(clip, RINGS)
