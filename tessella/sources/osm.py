"""Entity extracts in the public protocol-buffer format, read blob by blob.

A Python data source plans one partition for a run of blobs (the driver reads blob headers only); tasks decode their
blobs into entity rows. The job ``ingest`` writes them as Parquet, which everything else reads.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = ("kind string, id bigint, lon int, lat int, refs array<bigint>, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>")
BLOBS_PER_TASK = 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a message: integers, or the bytes of anything with a length."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def numbers(data: bytes, signed: bool = False, running: bool = False) -> list[int]:
    out, at, total = [], 0, 0
    while at < len(data):
        v, at = _varint(data, at)
        v = (v >> 1) ^ -(v & 1) if signed else v
        total = total + v if running else v
        out.append(total)
    return out


def _grouped(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for k, v in fields(data):
        out.setdefault(k, []).append(v)
    return out


def _int64(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def entities(block: bytes) -> Iterator[tuple]:
    """Rows of one decoded primitive block."""
    top = _grouped(block)
    strings = [s.decode("utf-8", "replace") for k, s in fields(top[1][0]) if k == 1]
    step, lat0, lon0 = top.get(17, [100])[0], _int64(top.get(19, [0])[0]), _int64(top.get(20, [0])[0])
    unit = lambda offset, v: (offset + step * v) // 100
    tags = lambda m: dict(zip((strings[i] for i in numbers(b"".join(m.get(2, [])))), (strings[i] for i in numbers(b"".join(m.get(3, []))))))
    for group in top.get(2, []):
        for kind, data in fields(group):
            if kind == 1:
                m = _grouped(data)
                zig = lambda v: (v >> 1) ^ -(v & 1)
                yield "n", zig(m[1][0]), unit(lon0, zig(m[9][0])), unit(lat0, zig(m[8][0])), None, None, tags(m)
            elif kind == 2:
                m = _grouped(data)
                ids, lats, lons = (numbers(m[k][0], True, True) for k in (1, 8, 9))
                words, at = numbers(m[10][0]) if 10 in m else [], 0
                for i, lat, lon in zip(ids, lats, lons):
                    own = {}
                    while at < len(words) and words[at]:
                        own[strings[words[at]]] = strings[words[at + 1]]
                        at += 2
                    at += 1
                    yield "n", i, unit(lon0, lon), unit(lat0, lat), None, None, own
            elif kind == 3:
                m = _grouped(data)
                yield "w", _int64(m[1][0]), None, None, numbers(b"".join(m.get(8, [])), True, True), None, tags(m)
            elif kind == 4:
                m = _grouped(data)
                roles, refs, types = numbers(b"".join(m.get(8, []))), numbers(b"".join(m.get(9, [])), True, True), numbers(b"".join(m.get(10, [])))
                yield "r", _int64(m[1][0]), None, None, None, [{"type": ("node", "way", "relation")[t], "ref": r, "role": strings[s]} for t, r, s in zip(types, refs, roles)], tags(m)


def inflate(blob: bytes) -> bytes:
    m = _grouped(blob)
    return m[1][0] if 1 in m else zlib.decompress(m[3][0])


class Blobs(InputPartition):
    def __init__(self, path: str, places: list[tuple[int, int]]):
        self.path, self.places = path, places


class EntityReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        places = []
        with open(self.path, "rb") as f:
            while head := f.read(4):
                header = _grouped(f.read(struct.unpack(">I", head)[0]))
                size = header[3][0]
                if header[1][0] == b"OSMData":
                    places.append((f.tell(), size))
                f.seek(size, 1)
        return [Blobs(self.path, places[i : i + BLOBS_PER_TASK]) for i in range(0, len(places), BLOBS_PER_TASK)] or [Blobs(self.path, [])]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            for at, size in partition.places:
                f.seek(at)
                yield from entities(inflate(f.read(size)))


class EntitySource(DataSource):
    """``spark.read.format("osmpbf").load(path)``; the file must be on storage that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EntityReader:
        return EntityReader(self.options["path"])


def ingest(spark: SparkSession, path: str, out: str, keep: Column | None = None) -> None:
    """Write ``nodes``, ``ways`` and ``relations`` as Parquet, with the most used keys as columns for pushdown; ``keep``: a condition on
    ``kind`` and ``tags`` that ways and relations have to meet (nodes stay, as ways need them)."""
    spark.dataSource.register(EntitySource)
    rows = spark.read.format("osmpbf").load(path)
    rows = rows if keep is None else rows.filter((F.col("kind") == "n") | F.coalesce(keep, F.lit(False)))
    for key in ("highway", "name", "place", "landuse", "natural", "amenity", "shop"):
        rows = rows.withColumn(key, F.try_element_at("tags", F.lit(key)))
    rows.repartition("kind", F.pmod(F.xxhash64("id"), F.lit(64))).write.partitionBy("kind").parquet(out)


def read_entities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations of an ingested extract."""
    rows = spark.read.parquet(path)
    return (rows.filter("kind = 'n'").select("id", "lon", "lat", "tags"), rows.filter("kind = 'w'").select("id", "refs", "tags"), rows.filter("kind = 'r'").select("id", "members", "tags"))
