"""Exact substring deduplication with longest-previous-factor arrays.

A byte string of ``length`` bytes that starts in two places has the same smallest ``GRAM``-byte gram (by hash) in both.
So every document is cut into runs of windows that share their smallest gram, grams that occur once are dropped, and
only the runs of repeated grams travel, to the task of their gram. There the distinct runs form one text with a suffix
array (prefix doubling up to ``length``). In suffix order, windows with a common prefix of ``length`` are neighbours;
the smaller positions before and after a window among them are its earlier matches, which is where its longest previous
factor reaches ``length``. With ``keep_first`` the windows with an earlier match go, else also those with a later one.

No array covers more than about ``ARRAY_BYTES``. A gram with more than ``GROUP_RUNS`` runs (a passage in a third of all
documents) is taken apart by the bytes around it: equal runs are counted as one, the windows of what is left are dealt
out by their place relative to the gram, ``WIDTHS`` of them at a time, and meet by all bytes that such neighbours share. Each
of the smaller groups goes through the same factor arrays, or is taken apart again, down to single windows.
Texts travel compressed. Equal texts (by MD5) are one unit, so copies add no work beyond the first passes.

Defined cases: null is the empty text; texts shorter than ``length`` lose nothing; repeated rows are copies of each
other; with ``keep_first`` the copy with the smallest id is the first (rows of equal id and text are all first); ids are
numbers or strings; rows without an id come last; cuts inside a character drop its remaining bytes from ``text`` but not
from ``kept``; columns of any name pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, materialize, slices

LENGTH, GRAM = 200, 32
#: Runs of one gram that meet in one task; the runs of more frequent grams are taken apart.
GROUP_RUNS = 2000
#: Bytes of distinct runs under one suffix array; its rows are at most an eightieth of that.
ARRAY_BYTES = 800_000
#: Equal runs are common if they are more than one in so many; then all tasks know them.
COMMON = 10_000
#: Neighbouring windows that stay together when a frequent gram's runs are taken apart, and again and again.
WIDTHS = (43, 11, 3, 1)

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class _Powers:
    """Powers of the rolling hash's multiplier and of its inverse, as far as texts have been long."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            for name, factor in (("up", _MULTIPLIER), ("down", _INVERSE)):
                x = np.full(size, factor, np.uint64)
                x[0] = 1
                setattr(cls, name, np.cumprod(x))
        return cls.up[:n], cls.down[:n]


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Mixed 64-bit hashes of all grams of a text."""
    up, down = _Powers.of(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def window_runs(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest gram, first window and number of windows of each run of windows whose leftmost smallest gram stands in one place."""
    grams = gram_hashes(raw, gram)
    least = sliding_minimum(grams, length - gram + 1)
    # the next window has another gram if a smaller one enters or the present one leaves; so no run holds equal windows
    starts = np.concatenate([[0], np.flatnonzero((least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])) + 1])
    return least[starts].view(np.int64), starts.astype(np.int32), np.diff(starts, append=len(least)).astype(np.int32)


def suffix_classes(text: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the positions ``at`` by their first ``length`` bytes, and class numbers (equal prefixes) in that order."""
    n, known = len(text), min(8, length)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    packed = np.zeros(n, np.uint64)
    for k in range(known):
        packed = packed << np.uint64(8) | padded[k : n + k]
    pair = packed
    while known < length:
        _, rank = np.unique(pair, return_inverse=True)
        step = min(known, length - known)
        follows = np.zeros(n, np.int64)
        follows[: n - step] = rank[step:] + 1
        pair = rank.astype(np.int64) * np.int64(n + 1) + follows
        known += step
    pair = pair[at]
    order = np.argsort(pair)
    pair = pair[order]
    return order, np.cumsum(np.concatenate([[False], pair[1:] != pair[:-1]]))


def earlier_and_later(order: np.ndarray, classes: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window: whether its longest previous (next) factor has full length.

    Among the neighbours in suffix order that share the prefix, the least position before (previous smaller) or after
    (next smaller) a window is less than its own exactly if it has an earlier match; the mirror image finds later ones."""
    n = len(order)
    first = np.flatnonzero(np.diff(classes, prepend=-1))
    own = position[order]
    least, most = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
    which = np.repeat(np.arange(len(first)), np.diff(first, append=n))
    earlier, later = np.zeros(n, bool), np.zeros(n, bool)
    earlier[order], later[order] = least[which] < own, most[which] > own
    return earlier, later


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def _order(docs: DataFrame, id_col: str) -> Column:
    """The id as a number or string in which rows without one come last."""
    if isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1))
    return F.coalesce(docs[id_col].cast("string"), F.lit("\U0010ffff" * 8))


def _units(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """``unit`` (digest of the text), ``_order`` (id), ``z`` (compressed text) and the columns to keep as ``k_0, k_1, ...``."""
    text = _text(docs, text_col)
    rows = docs.select(F.unhex(F.md5(text)).alias("unit"), _order(docs, id_col).alias("_order"), F.encode(text, "UTF-8").alias("z"), *[docs[c].alias(f"k_{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in (part for whole in batches for part in slices(whole, 2)):
            z = pa.array([pack(t.as_buffer()) for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], z, *batch.columns[3:]], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _anchors(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """``key, unit, n``: the grams that stand for windows of a text, and how many runs of windows each has there."""
    rows = docs.select(_text(docs, text_col).alias("_text")).filter(F.octet_length("_text") >= length)
    rows = rows.select(F.unhex(F.md5("_text")).alias("unit"), F.encode("_text", "UTF-8").alias("_raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for unit, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                key, n = np.unique(window_runs(np.frombuffer(raw.as_buffer(), np.uint8), length)[0], return_counts=True)
                held.append((key, unit, n))
                size += len(key)
                if size > 100_000:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

    def batch_of(held) -> pa.RecordBatch:
        units = pa.array([h[1] for h in held], pa.binary()).take(pa.array(np.repeat(np.arange(len(held)), [len(h[0]) for h in held])))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[0] for h in held])), units, pa.array(np.concatenate([h[2] for h in held]).astype(np.int32))], ["key", "unit", "n"])

    return rows.mapInArrow(run, "key bigint, unit binary, n int")


def _contents(units: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``key, rep, unit, starts, content, wide``: the runs of the grams in ``wanted`` (``unit, rep, keys, wide``), equal runs of a text once."""
    joined = units.select("unit", F.col("_order").alias("rep"), "z").join(wanted, ["unit", "rep"]).select("unit", "rep", "z", "keys", "wide")
    rep_type = joined.schema["rep"].dataType.simpleString()
    kinds = [pa.int64(), pa.string() if rep_type == "string" else pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.bool_()]
    names = ["key", "rep", "unit", "starts", "content", "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                unit, rep, z, keys, wide = (batch.column(k)[i].as_py() for k in range(5))
                text = unpack(z)
                key, s, n = window_runs(np.frombuffer(text, np.uint8), length)
                of = np.flatnonzero(np.isin(key, np.array(keys, np.int64)))
                found: dict[tuple[int, bytes], list[int]] = {}
                for k, a, m in zip(key[of].tolist(), s[of].tolist(), n[of].tolist()):
                    found.setdefault((k, text[a : a + m + length - 1]), []).append(a)
                for (k, content), starts in found.items():
                    out.append((k, rep, unit, starts, content, wide))
                    size += len(content)
                    if size > 4_000_000:
                        yield batch_of(out)
                        out, size = [], 0
            if out:
                yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return joined.mapInArrow(run, f"key bigint, rep {rep_type}, unit binary, starts array<int>, content binary, wide boolean")


def repeated_windows(contents: list[bytes], order: np.ndarray, length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For distinct runs (``order``: rank of their first occurrence) the flags of windows with earlier and with later matches in others."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    windows = sizes - (length - 1)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(begins, windows) + offset
    sa, classes = suffix_classes(np.frombuffer(b"".join(contents), np.uint8), at, length)
    earlier, later = earlier_and_later(sa, classes, np.repeat(order, windows) * int(windows.max()) + offset)
    cut = np.cumsum(windows)[:-1]
    return np.split(earlier, cut), np.split(later, cut)


def _sort_in_task(length: int, keep_first: bool, array_bytes: int):
    """Runs (``key, content, rep, unit, starts``) sorted by gram and content in; out, for each run that has any, the ranges of
    windows to remove: ``unit, run`` (where the run starts), ``a, b`` (arrays)."""
    def solve(members: list[tuple]) -> pa.RecordBatch:
        groups: dict[tuple, list[tuple]] = {}
        for m in members:
            groups.setdefault(m[:2], []).append(m[2:])
        firsts = [min(g) for g in groups.values()]
        rank = np.empty(len(firsts), np.int64)
        rank[sorted(range(len(firsts)), key=firsts.__getitem__)] = np.arange(len(firsts))
        earlier, later = repeated_windows([content for _, content in groups], rank, length)
        out = []
        for (_, content), group, first, before, after in zip(groups, groups.values(), firsts, earlier, later):
            whole, n = sum(len(starts) for _, _, starts in group) > 1, len(content) - length + 1
            flags = _runs(before if keep_first else before | after)
            for m in group:
                for at in m[2]:
                    if whole and not (keep_first and m == first and at == m[2][0]):  # by value: rows of equal id and text are all first
                        out.append((m[1], at, [at], [at + n]))
                    elif flags:
                        out.append((m[1], at, [at + x for x, _ in flags], [at + y for _, y in flags]))
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())))], ["unit", "run", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending, size, last = [], [], 0, None  # held: finished grams; pending: rows of the last one
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for row in zip(*(part.column(i).to_pylist() for i in range(5))):
                    if row[0] != last:
                        if len(pending) > 1 or pending and len(pending[0][4]) > 1:
                            held += pending
                        pending, last = [], row[0]
                        if held and (size > array_bytes // 2 or len(held) > array_bytes // 80):
                            yield solve(held)
                            held, size = [], 0
                    if pending and pending[-1][1] == row[1]:
                        row = (row[0], pending[-1][1], *row[2:])  # equal runs share their bytes
                    else:
                        size += len(row[1])
                    pending.append(row)
        if len(pending) > 1 or pending and len(pending[0][4]) > 1:
            held += pending
        if held:
            yield solve(held)
    return run


def _solved(runs: DataFrame, length: int, keep_first: bool, array_bytes: int) -> DataFrame:
    """``unit, run, a, b`` of grams whose runs meet in one task."""
    sorted_ = runs.select("key", "content", "rep", "unit", "starts").repartition("key").sortWithinPartitions("key", "content")
    return sorted_.mapInArrow(_sort_in_task(length, keep_first, array_bytes), "unit binary, run int, a array<int>, b array<int>")


def _take_apart(length: int, width: int, gram: int = GRAM):
    """Runs (``content, rep, unit, s``) in, their pieces of ``width`` windows at most out, dealt by place relative to the gram; the
    key is a hash of the bytes that all such windows hold, so equal windows of all runs meet."""
    names = ["key", "content", "rep", "unit", "s", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for content, rep, unit, s in zip(*(part.column(i).to_pylist() for i in range(4))):
                    n = len(content) - length + 1
                    p = int(gram_hashes(np.frombuffer(content[:length], np.uint8), gram).argmin())  # where the gram stands
                    for q in range((p - n + 1) // width, p // width + 1):
                        low, high = max(p - n + 1, q * width), min(p, q * width + width - 1)  # bytes from window to gram
                        core = content[p - q * width : p - q * width - width + 1 + length]
                        out.append((xxhash.xxh64_intdigest(core, q) - (1 << 63), content[p - high : p - low + length], rep, unit, s + p - high, s))
                kinds = [pa.int64(), pa.binary(), part.schema.field(1).type, pa.binary(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names)
    return run


def _solved_apart(members: DataFrame, length: int, keep_first: bool, array_bytes: int, used: list[DataFrame], widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``unit, run, a, b`` as ``_solved`` for grams of any frequency. ``members``: ``key, content, rep, unit, starts`` (first
    windows of the equal runs of a text) and ``run`` (the run that the windows come from); ``used`` takes the tables to delete afterwards."""
    place = F.struct("rep", "unit", F.get("starts", 0).alias("s"), "run")
    runs = materialize(members.groupBy("key", "content").agg(F.sum(F.size("starts")).alias("times"), F.min(place).alias("first")), "frequent_runs")
    sizes = runs.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes")).filter("n > 1")
    met = runs.select("key", "content", "first.rep", "first.unit", "first.s").join(sizes, "key")
    fits = F.col("bytes") <= array_bytes
    found = _solved(met.filter(fits if widths else F.lit(True)).withColumn("starts", F.array("s")), length, keep_first, array_bytes)
    if widths:
        many = materialize(met.filter(~fits).select("content", "rep", "unit", "s"), "frequent_groups")
        if not many.isEmpty():
            rep_type = many.schema["rep"].dataType.simpleString()
            pieces = many.mapInArrow(_take_apart(length, widths[0]), f"key bigint, content binary, rep {rep_type}, unit binary, s int, run int")
            pieces = materialize(pieces.withColumn("starts", F.array("s")).drop("s"), "frequent_pieces")
            used.append(pieces)
            found = found.unionByName(_solved_apart(pieces, length, keep_first, array_bytes, used, widths[1:]))
        used.append(many)
    used.append(runs)
    # runs that occur once, and with keep_first the first ones, lose what matches other runs
    own = runs.filter(F.lit(True) if keep_first else F.col("times") == 1).select("first.unit", F.col("first.s").alias("run"), F.col("first.run").alias("_run"))
    firsts = found.join(own, ["unit", "run"]).select("unit", F.col("_run").alias("run"), "a", "b")
    # the others go whole: the most common ones are known to all tasks, the rest meets by digest
    several = runs.filter("times > 1").select("times", "first", F.md5("content").alias("digest"))
    several = materialize(several, "frequent_copies")
    used.append(several)
    total = runs.agg(F.sum("times")).first()[0] or 0
    common = several.filter(F.col("times") * COMMON > total).collect()  # fewer than COMMON rows
    n = F.octet_length("content") - length + 1
    spots = members.select("unit", "run", "starts", n.alias("n"), F.md5("content").alias("digest"), place.alias("place"))
    known = F.col("digest").isin([r.digest for r in common])
    at_once, rest = spots.filter(known), spots.filter(~known).join(several.filter(F.col("times") * COMMON <= total).drop("times"), "digest")
    if keep_first:  # the first of all stays
        spot = F.concat_ws(":", F.hex("unit"), F.get("starts", 0), "run")
        others = lambda first: F.when(first, F.slice("starts", 2, F.size("starts"))).otherwise(F.col("starts"))
        at_once = at_once.withColumn("starts", others(spot.isin([f"{bytes(r.first.unit).hex().upper()}:{r.first.s}:{r.first.run}" for r in common])))
        rest = rest.withColumn("starts", others(F.col("place") == F.col("first")))
    whole = lambda df: df.filter(F.size("starts") > 0).select("unit", "run", F.col("starts").alias("a"), F.transform("starts", lambda x: x + F.col("n")).alias("b"))
    return firsts.unionByName(whole(at_once)).unionByName(whole(rest))


RESULTS = "n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _find(docs: DataFrame, length: int, keep_first: bool, id_col: str, text_col: str, keep: list[str], group_runs: int, array_bytes: int) -> DataFrame:
    """A row for every row: the columns ``keep`` as ``k_0, k_1, ...`` and then ``RESULTS``."""
    anchors = materialize(_anchors(docs, text_col, length), "anchors")
    # a table, so that the join below shuffles both sides and splits the grams of very common lines
    grams = materialize(anchors.groupBy("key").agg(F.sum("n").alias("n_runs")).filter("n_runs > 1").select("key", (F.col("n_runs") > group_runs).alias("wide")), "grams")
    units = _units(docs, id_col, text_col, keep)
    copies = docs.select(F.unhex(F.md5(_text(docs, text_col))).alias("unit"), _order(docs, id_col).alias("_order")).groupBy("unit").agg(F.count("*").alias("copies"), F.min("_order").alias("rep"))
    copies = materialize(copies, "units")
    candidates = anchors.join(grams, "key").select("unit", "key", "wide")
    by_unit = candidates.groupBy("unit", "wide").agg(F.collect_set("key").alias("keys"))  # a text's grams
    wanted = materialize(by_unit.join(copies, "unit"), "grams_of_texts").drop("copies")
    drop_table(anchors)
    drop_table(grams)
    # one pass over the texts writes the runs of all repeated grams
    members = materialize(_contents(units, wanted, length), "contents")
    drop_table(wanted)
    found = _solved(members.filter(~F.col("wide")), length, keep_first, array_bytes)
    frequent = members.filter("wide").select("key", "content", "rep", "unit", "starts", F.get("starts", 0).alias("run"))
    used = [members]
    if not frequent.isEmpty():
        found = found.unionByName(_solved_apart(frequent, length, keep_first, array_bytes, used))
    spans = materialize(found.groupBy("unit").agg(F.flatten(F.collect_list(F.arrays_zip("a", "b"))).alias("windows")), "windows")  # a text's spans
    for table in used:
        drop_table(table)

    columns = [f"k_{i}" for i in range(len(keep))]
    rest = units.join(copies, "unit").join(spans, "unit", "left")
    copy = (F.col("copies") > 1) & (F.lit(True) if not keep_first else F.col("_order") > F.col("rep"))
    rest = rest.select("z", "windows.a", "windows.b", copy.alias("copy"), *columns)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield finished(batch.slice(at, 500))

    def finished(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack, out = zstandard.ZstdDecompressor().decompress, []
        for z, a, b, copy in zip(*(batch.column(i).to_pylist() for i in range(4))):
            raw = unpack(z)
            ranges = [(0, len(raw))] if copy and len(raw) >= length else merged([(x, y + length - 1) for x, y in zip(a or (), b or ())])
            cuts = [0, *(x for r in ranges for x in r), len(raw)]
            kept = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
            out.append((len(raw), len(raw) - len(kept), len(ranges), [{"start": x, "end": y} for x, y in ranges], kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.RecordBatch.from_arrays([*batch.columns[4:], *(pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds))], [*columns, *_NAMES])

    kinds = "".join(f"k_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    return rest.mapInArrow(finish, kinds + RESULTS)


_NAMES = [x.split()[0] for x in RESULTS.split(", ")]


def find_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text",
                 group_runs: int = GROUP_RUNS, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """For every row its id and ``n_bytes, n_removed, n_spans, spans`` (byte ranges, end exclusive) and ``kept`` (bytes)."""
    found = _find(docs, length, keep_first, id_col, text_col, [id_col], group_runs, array_bytes)
    return found.select(F.col("k_0").alias(id_col), *_NAMES)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that ranges cover; ranges that touch join."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   group_runs: int = GROUP_RUNS, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """``docs`` with all columns, later copies of repeated strings cut out of the text; a null text becomes empty."""
    others = [c for c in docs.columns if c != text_col]
    found = _find(docs, length, True, id_col, text_col, others, group_runs, array_bytes)
    own = {c: F.col(f"k_{i}") for i, c in enumerate(others)} | {text_col: F.decode("kept", "UTF-8")}
    return found.select(*[own[c].alias(c) for c in docs.columns])
