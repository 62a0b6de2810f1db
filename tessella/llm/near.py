"""Near-duplicates by the Jaccard similarity of their five-word shingles, each link checked exactly.

Equal texts are one unit. Units whose fingerprints (of the distinct shingles) differ in at most three bits are found by the bit-sliced
comparison of ``simhash``. For the others ``BANDS`` keys of ``ROWS`` min-hashes make buckets: a pair at similarity 0.8 shares no bucket
with a chance of (1 - 0.8 ** ROWS) ** BANDS = 5e-8, nearer pairs with less. Units are linked if their shingle sets have a
similarity of at least 4/5 (counted in whole numbers). First every unit meets those that the fingerprints name and the centre of its
buckets, the unit that meets most others; that joins nearly all that belongs together, with one comparison a unit and bucket. Buckets that still hold
several classes go to tasks with their shingle sets, large ones as pairs of tiles of ``TILE`` units; there all sets are compared at
once, as products of incidence matrices, and a spanning set of the links between classes comes out. So rows grow with the units,
never with the pairs, and nothing is capped. Joins go by shuffle, so that the driver gets none of these tables.

The bit-sliced comparison alone can't do this job: at similarity 0.8 fingerprints differ in 8 to 10 of 64 bits, and 2r blocks for
r = 8 are 12,870 bucket keys a document.

Defined cases: words are split at white space, A-Z lower-cased; fewer words than a shingle form one shingle; texts without
words (null, empty, white space) are alike; rows without an id stay and take part in nothing; of repeated rows one stays; columns
of any name pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import drop_table, join_counted, materialize, shuffled, slices
from .components import components

SHINGLE, BANDS, ROWS = 5, 32, 4
#: Units of one bucket whose sets meet in one task; larger buckets become pairs of tiles.
TILE = 512
#: Shingles that are compared at once.
_COLUMNS = 4096
_FACTORS = np.random.default_rng(51).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(52).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        x = (hashes[at : at + 2048, None] ^ _SHIFTS) * _FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(0), out=least)
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[b * 8 * ROWS : (b + 1) * 8 * ROWS], b) - (1 << 63) for b in range(BANDS)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 1)):
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        prints = pa.array([simhash.majority(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints, pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))], ["unit", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], ["unit", "s"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: the pairs with a similarity of at least 4/5."""
    of = lambda c, s: shuffled(sets.select(F.col("unit").alias(c), F.col("s").alias(s)))
    both = pairs.join(of("a", "sa"), "a").join(of("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(9 * common >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def _unit(docs: DataFrame, text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(docs[text_col].cast("string"), F.lit(""))))


def _compare(units: list[bytes], labels: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """Links that join the classes of one tile between which a link leads."""
    n = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count[column] > 1  # the others add to no pair
    column, owner = np.unique(column[common], return_inverse=True)[1], owner[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        at = slice(*np.searchsorted(column, (low, low + _COLUMNS)))
        block = np.zeros((len(sets), _COLUMNS), np.float32)
        block[owner[at], column[at] - low] = 1
        both += block @ block.T
    _, group = np.unique(np.array(labels, object), return_inverse=True)
    a, b = np.nonzero(np.triu((9 * both >= 4 * (n[:, None] + n)) & (group[:, None] != group), 1))
    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        if group[i] != group[j]:
            group[group == group[j]] = group[i]
            out.append((units[i], units[j]))
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, lo, hi, unit, label, s`` sorted by the first three in, links out."""
    held, last = [], None

    def done() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            found = _compare(*map(list, zip(*held)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        for i, key in enumerate(keys):
            if key != last:
                yield from done()
                held, last = [], key
            held.append((batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), batch.column(5)[i].values.to_numpy(zero_copy_only=False)))
    yield from done()


def bit_pairs(prints: DataFrame) -> DataFrame:
    """``a, b``: stars of units (``unit, fp``, distinct) whose fingerprints are equal or linked within three bits, by the bit-sliced comparison."""
    first = materialize(prints.groupBy("fp").agg(F.min("unit").alias("first"), F.count("*").alias("_n")), "fingerprints")
    same = join_counted(prints, first, "fp", prints.count(), F.xxhash64("unit"), "inner").select(F.col("first").alias("a"), F.col("unit").alias("b"))
    of = lambda c: shuffled(first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_unit")))
    near = simhash.links(first.select("fp")).distinct().join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(near.select(F.col("b_unit").alias("a"), F.col("a_unit").alias("b"))).filter("a <> b")


def near_links(docs: DataFrame, text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``a, b`` (digests of texts): links that join all texts between which a chain of pairs at similarity 0.8 or more leads."""
    texts = docs.select(_unit(docs, text_col).alias("unit"), docs[text_col].cast("string").alias("_text"))
    sketches = materialize(texts.mapInArrow(_sketch, "unit binary, fp bigint, keys array<bigint>"), "sketches")
    prints = materialize(sketches.select("unit", "fp").distinct(), "prints")
    proposed = materialize(bit_pairs(prints), "bit_pairs")
    keyed = sketches.select("unit", F.explode("keys").alias("key"))  # the band is in the key's hash
    buckets = keyed.groupBy("key").agg(F.min("unit").alias("_least"), F.max("unit").alias("_most"), F.count("*").alias("m")).filter("_least <> _most").select("key", "m")
    members = materialize(keyed.join(shuffled(buckets), "key").distinct(), "buckets")
    drop_table(sketches)
    wanted = materialize(members.groupBy("unit").agg(F.sum("m").alias("meets")), "units_met")
    met = wanted.select("unit").unionByName(proposed.select(F.explode(F.array("a", "b")).alias("unit"))).distinct()
    sets = materialize(texts.join(shuffled(met), "unit", "left_semi").dropDuplicates(["unit"]).mapInArrow(_sets, "unit binary, s array<bigint>"), "shingle_sets")
    centres = members.join(shuffled(wanted), "unit").groupBy("key").agg(F.max(F.struct("meets", "unit")).getField("unit").alias("centre"))
    stars = members.join(shuffled(centres), "key").filter("unit <> centre").select(F.col("centre").alias("a"), F.col("unit").alias("b")).unionByName(proposed).distinct()
    near = materialize(_alike(stars, sets), "near_first")
    label = components(near).withColumnRenamed("node", "unit") if not near.isEmpty() else wanted.select("unit", F.col("unit").alias("label"))
    named = members.join(shuffled(label), "unit", "left").select("key", "unit", F.coalesce("label", "unit").alias("label"))
    split = named.groupBy("key").agg(F.min("label").alias("_l"), F.max("label").alias("_m"), F.count("*").alias("m")).filter("_l <> _m").select("key", F.ceil(F.col("m") / tile).cast("int").alias("tiles"))
    open_ = named.join(shuffled(split), "key").withColumn("_tile", F.pmod(F.xxhash64("unit"), "tiles").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    open_ = materialize(open_.select("key", F.least("_tile", "_other").alias("lo"), F.greatest("_tile", "_other").alias("hi"), "unit", "label"), "buckets_left")
    dealt = open_.join(shuffled(sets), "unit").select("key", "lo", "hi", "unit", "label", "s").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    more = materialize(dealt.mapInArrow(_tiles, "a binary, b binary"), "near_more")
    for done in (prints, proposed, members, wanted, sets, open_):
        drop_table(done)
    return near.unionByName(more)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id, with all its columns. Rows without an id stay."""
    with_id = docs.filter(docs[id_col].isNotNull())
    rows = materialize(with_id.select(docs[id_col].alias("_id"), _unit(docs, text_col).alias("unit")), "units")
    labels = components(near_links(with_id, text_col)).withColumnRenamed("node", "unit")
    firsts = rows.groupBy("unit").agg(F.min("_id").alias("_id")).join(shuffled(labels), "unit", "left")
    best = firsts.groupBy(F.coalesce("label", "unit").alias("label")).agg(F.min(F.struct("_id", "unit")).alias("x")).select(F.col("x._id").alias("_id"), F.col("x.unit").alias("_unit"))
    best = materialize(best, "firsts")
    # one column with the whole row, so that no name of the input clashes
    keyed = with_id.select(docs[id_col].alias("_id"), _unit(docs, text_col).alias("_unit"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    kept = keyed.join(shuffled(best), ["_id", "_unit"], "left_semi").dropDuplicates(["_id", "_unit"]).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return kept.unionByName(docs.filter(docs[id_col].isNull()))
