"""SimHash near-duplicates, compared as bit planes.

Fingerprints are deduplicated first. Of ``2 * radius`` blocks of bits, two fingerprints within ``radius`` differing
bits agree on ``radius`` blocks at least, so every combination of that many blocks is a bucket key and no link is
lost. Inside a bucket, the pairs' differences stand vertically: plane ``k`` holds bit ``k`` of 64 pairs per machine
word, carry-save counters add up all distances at once, and a block of pairs is abandoned when every counter has
passed the radius. A bucket gives a spanning star for each of its linked groups, never all links; buckets over
``TILE`` fingerprints are dealt out as pairs of tiles. Contraction joins the stars into components.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and links like any other; fewer
words than a shingle form one shingle; repeated rows share their component; an empty table gives an empty result;
a row without an id gets its component but gives none its name; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, join_counted, materialize, shuffled, slices
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints of one bucket that one task compares at once; larger buckets become pairs of tiles.
TILE = 4096
_SMALL = 24


def majority(hashes: np.ndarray) -> int:
    """Signed 64 bits: those that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes.astype("<u8", copy=False), len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the shingles' XXH64, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])], "<u8"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) for every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, fp bigint")


def block_masks(radius: int) -> list[int]:
    """Masks (signed) of all choices of ``radius`` of ``2 * radius`` blocks of the 64 bits; one empty mask for radius 0."""
    if radius == 0:
        return [-1]
    cuts = [round(64 * i / (2 * radius)) for i in range(2 * radius + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(blocks, radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def within_radius(left: np.ndarray, right: np.ndarray, radius: int, block: int = 1 << 15) -> np.ndarray:
    """Whether fingerprints (uint64) of equal places differ in at most ``radius`` bits, by carry-save counting on bit planes."""
    out = np.zeros(len(left), bool)
    width = max(1, radius.bit_length())
    for at in range(0, len(left), block):
        differ = (left[at : at + block] ^ right[at : at + block]).astype("<u8")
        bits = np.unpackbits(differ.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lanes = np.zeros((64, -(-len(differ) // 64) * 64), np.uint8)
        lanes[:, : len(differ)] = bits.T
        lanes[: radius + 1, len(differ) :] = 1  # idle lanes are over at once
        planes = np.packbits(lanes, axis=1, bitorder="little").view("<u8")
        counter, over = [np.zeros(planes.shape[1], np.uint64) for _ in range(width)], np.zeros(planes.shape[1], np.uint64)
        for k in range(64):
            carry = planes[k]
            for digit in range(width):
                counter[digit], carry = counter[digit] ^ carry, counter[digit] & carry
            over |= carry
            if k % 8 == 7 and not (~over).any():
                break
        else:
            beyond, equal = np.zeros_like(over), ~np.zeros_like(over)  # counter > radius, from the highest digit
            for digit in reversed(range(width)):
                if radius >> digit & 1:
                    equal &= counter[digit]
                else:
                    beyond |= equal & counter[digit]
                    equal &= ~counter[digit]
            near = ~(over | beyond)
            out[at : at + block] = np.unpackbits(near.view(np.uint8), bitorder="little")[: len(differ)].astype(bool)
    return out


def _link(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and labels (places too) of the linked rows; ``group`` is sorted and only equal groups are compared."""
    n = len(fps)
    label = np.arange(n)
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff(starts, append=n)
    lefts, rights = [], []

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        near = within_radius(fps[a], fps[b], radius)
        lefts.append(a[near])
        rights.append(b[near])

    longest = int(sizes[sizes <= _SMALL].max(initial=0))
    small = np.repeat(sizes <= _SMALL, sizes)
    for step in range(1, longest):
        a = np.flatnonzero((group[:-step] == group[step:]) & small[:-step])
        if len(a):
            compare(a, a + step)
    for start, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
        for step in range(1, size):
            a = np.arange(start, start + size - step)
            compare(a, a + step)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def _stars(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(table: pa.Table) -> pa.RecordBatch:
            fps = table.column("fp").to_numpy().view(np.uint64)
            keys = [table.column(c).to_numpy() for c in ("band", "key", "lo", "hi")]
            group = np.cumsum(np.any([np.diff(k, prepend=k[0]) != 0 for k in keys], axis=0))
            at, to = _link(fps, group, radius)
            return pa.RecordBatch.from_arrays([pa.array(fps[at].view(np.int64)), pa.array(fps[to].view(np.int64))], ["a", "b"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            same = np.all([table.column(c).to_numpy() == table.column(c)[-1].as_py() for c in ("band", "key", "lo", "hi")], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last group may go on
            held = table.slice(cut)
            if cut:
                yield stars(table.slice(0, cut).combine_chunks())
        if held is not None and held.num_rows:
            yield stars(held.combine_chunks())
    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: a spanning star for each linked group of each bucket of the distinct fingerprints ``fp``."""
    masks = block_masks(radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "key"))
    tiles = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1").select("band", "key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = (keyed.join(shuffled(tiles), ["band", "key"])
             .withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("band", "key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "fp"))
    dealt = dealt.repartition("band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi")
    return dealt.mapInArrow(_stars(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id reachable over links of at most ``radius`` differing bits."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("_n")), "distinct")
    labels = components(links(distinct, radius, tile))
    named = distinct.join(shuffled(labels.withColumnRenamed("node", "fp")), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = named.join(shuffled(least), "label").select("fp", "component_id", "_n")
    # one fingerprint (that of wordless texts, or of mass copies) may hold a third of the rows
    return join_counted(prints, classes, "fp", prints.count(), F.xxhash64("doc_id"), "inner").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with all its columns: of those with the smallest id, one with the smallest text. Rows without an id stay."""
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])  # so that no name of the input clashes
    keyed = docs.filter(docs[id_col].isNotNull()).select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), row.alias("row"))
    found = near_duplicates(keyed, radius, shingle)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    # rows of one id are few; the hash of their text picks one
    kept = keyed.join(shuffled(first), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", F.struct(F.xxhash64("text"), "text")).alias("row"))
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]).unionByName(docs.filter(docs[id_col].isNull()))
