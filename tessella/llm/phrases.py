"""Phrases whose words stand together more often than chance, counted on a prefix-free parse.

Texts are cut into chunks at content: where a hash of the next ``LONGEST - 1`` words is divisible by ``PERIOD``, a chunk begins,
and the one before it ends after those words. Chunks thus overlap by ``LONGEST - 1`` words, which are the same wherever a passage
stands, so copies and repeated passages give the same chunks. These form a dictionary with the frequency of each in the parse; it is
all that is read from then on, and texts are read once. A phrase counts in the chunk in which it starts before the overlap, so
every occurrence counts once, times the chunk's frequency.

Of the phrases only frequent ones matter, for a part of a frequent phrase is frequent, too. Phrases are counted by their
64-bit hashes first: words, then pairs of words that may be frequent, then longer ones whose pairs all may, by bitmaps of at most
``MOST_BITS``. Equal hashes can only let too much through. The last pass over the dictionary spells what is left, and counts and
filters it by its words. All keys are summed in tasks before they are shuffled.

Defined cases: a null text is empty; a null language is ``und``; repeated rows count again; texts without words count nothing; other
columns are not read; an empty table gives an empty result; ties end in the byte order of the phrases, which are distinct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_table, join_counted, materialize, slices

LONGEST, LEAST_COUNT, TOP = 5, 100, 2000
#: Mean number of words between the starts of chunks in a long piece.
PERIOD = 16
#: Share (of 100) of a phrase's occurrences that lie inside a longer one from which on it is dropped.
INSIDE = 100
#: Bits, as a power of two, of the bitmap of hashes that may be frequent: 16 for each that is, 32 MB at most.
LEAST_BITS, MOST_BITS = 16, 28
#: Bytes of chunks that a task looks at together, and hashes that it sorts at once.
BATCH, SORT = 2_000_000, 2_000_000
#: Phrases that a task sums before it hands them on.
HELD = 400_000
#: Parts in which a language's best phrases are found first.
PARTS = 64

_BLANKS, _BREAKS = b" \t", b".,;:!?\n\v\f\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)], _KIND[list(_BREAKS)] = 1, 2
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_NUMBERS = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NUMBERS[:, 32] = 0
_PLACES = np.cumprod(np.array([[1] + [x] * 255 for x in _SEEDS], np.uint64), axis=1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ x >> np.uint64(32)


def word_hashes(clean: np.ndarray, starts: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words that stand in order, each with one blank after it: sums of a number for each byte times one for its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    within = np.arange(len(clean), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(starts, append=len(clean)))
    numbers = _NUMBERS[seed]
    if within.max() >= len(numbers):
        places = np.full(int(within.max()) + 1, _SEEDS[seed], np.uint64)
        places[0] = 1
        places = np.cumprod(places)
    else:
        places = _PLACES[seed]
    mixed = numbers[clean]
    mixed *= places[within]
    return _mix(np.add.reduceat(mixed, starts))


def _longer(h: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of phrases of ``k`` words from those of ``k - 1`` and of words; the last ones are of no use."""
    after = np.zeros_like(words)
    after[: max(0, len(words) - k + 1)] = words[k - 1 :]
    return _mix(h * np.uint64(_SEEDS[1]) + after)


def parse(texts: list[bytes], period: int = PERIOD, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parse of texts: bytes of all chunks (each word with a blank after it), their offsets, whether each ends its piece, and the
    number of its text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    kind = _KIND[raw]
    word = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    n, lap = len(starts), longest - 1
    if not n:
        return raw[:0], np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    piece = np.cumsum(kind == 2)[starts]
    first = np.diff(piece, prepend=-1) != 0
    clean, kept = raw, word
    clean[ends], kept[ends] = 32, True
    place = np.cumsum(kept) - kept
    clean = clean[kept]
    h = window = word_hashes(clean, place[starts])
    for k in range(2, lap + 1):
        window = _longer(window, h, k)
    fits = np.zeros(n, bool)
    fits[: max(0, n - lap + 1)] = piece[: max(0, n - lap + 1)] == piece[lap - 1 :]
    opens = np.flatnonzero(first | (fits & (window % np.uint64(period) == 0)))
    heads = np.append(np.flatnonzero(first), n)
    end = heads[np.searchsorted(heads, opens, "right")]
    after = np.append(opens[1:], n)
    last = after == end
    stop = np.where(last, end, after + lap)
    begins, sizes = place[starts[opens]], place[ends[stop - 1]] + 1 - place[starts[opens]]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    gather = np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])
    text_of = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in texts]), starts[opens], "right") - 1
    return clean[gather], offsets, last, text_of


def _string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", period: int = PERIOD, longest: int = LONGEST) -> DataFrame:
    """``lang, chunk, last, times``: the distinct chunks of each language with their frequency in the parse."""
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            data, offsets, last, text_of = parse([t.as_buffer().to_pybytes() for t in batch.column(1)], period, longest)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text_of)), _string_array(data, offsets), pa.array(last)], ["lang", "chunk", "last"])

    return rows.mapInArrow(run, "lang string, chunk string, last boolean").groupBy("lang", "chunk", "last").agg(F.count("*").alias("times"))


class _Chunks:
    """The words of a batch of the dictionary as arrays."""

    def __init__(self, batch: pa.RecordBatch, longest: int) -> None:
        offsets = _offsets(batch.column("chunk"))
        self.raw = np.frombuffer(batch.column("chunk").buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        self.ends = np.flatnonzero(self.raw == 32)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        behind = np.searchsorted(self.ends, offsets[1:] - offsets[0])
        self.row = np.repeat(np.arange(batch.num_rows), np.diff(behind, prepend=0))
        self.lang = batch.column("lang").dictionary_encode()
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), seed=7) for x in self.lang.dictionary.to_pylist()], np.uint64)
        #: Words from each one to its chunk's end, and times that the chunk stands in the parse.
        self.left = behind[self.row] - np.arange(len(self.row))
        self.times = batch.column("times").to_numpy(zero_copy_only=False)[self.row]
        last = batch.column("last").to_numpy(zero_copy_only=False)
        self.own = self.left > np.where(last, 0, longest - 1)[self.row]
        self.words = word_hashes(self.raw, self.starts)
        self.first = _mix(self.words ^ seeds[self.lang.indices.to_numpy()][self.row])


def _offsets(text: pa.Array) -> np.ndarray:
    return np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes of chunks, one row at least."""
    held, size = [], 0
    for whole in batches:
        if not whole.num_rows:
            continue
        offsets = _offsets(whole.column("chunk"))
        cuts = np.unique(np.concatenate([[0], np.searchsorted(offsets, offsets[0] + np.arange(most, offsets[-1] - offsets[0], most)), [whole.num_rows]]))
        for a, b in zip(cuts, cuts[1:]):
            if held and size + offsets[b] - offsets[a] > most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(whole.slice(a, b - a))
            size += offsets[b] - offsets[a]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _summed(h: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h = h[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[new], np.add.reduceat(times[order], new)


def _passes(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set."""
    bits = int(bitmap.size * 64).bit_length() - 1
    at = h >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def frequent_hashes(chunks: DataFrame, sizes: range, shorter: np.ndarray | None, least: int, longest: int) -> DataFrame:
    """``h``: hashes of the phrases of ``sizes`` words that may stand ``least`` times. ``shorter``: bitmap of those a word shorter than the
    first size; all their like in a phrase must be in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _gathered(batches):
            c = _Chunks(batch, longest)
            h, ahead = c.first, None
            for k in range(2, sizes[0] + 1):
                ahead, h = h, _longer(h, c.words, k)
            if shorter is None:
                at = np.flatnonzero(c.own)
            else:  # both parts of the first size, and for each further word one more
                may = _passes(shorter, ahead)
                at = np.flatnonzero(c.own[:-1] & (c.left[:-1] >= sizes[0]) & may[:-1] & may[1:])
            for k in sizes:
                if k > sizes[0]:
                    h = _longer(h, c.words, k)
                    at = at[c.left[at] >= k]
                    at = at[may[at + k - sizes[0] + 1]]
                held.append((h[at], c.times[at]))
                size += len(at)
            if size >= SORT:
                yield batch_of(held)
                held, size = [], 0
        if size:
            yield batch_of(held)

    def batch_of(held: list) -> pa.RecordBatch:
        h, times = _summed(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], ["h", "times"])

    rows = chunks.mapInArrow(run, "h long, times long")
    return rows.groupBy("h").agg(F.sum("times").alias("times")).filter(F.col("times") >= least).select("h")


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash of a written table, by its first bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * hashes.count()).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - bits}) & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def frequent_phrases(chunks: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST) -> DataFrame:
    """``lang, phrase, words, f`` of all phrases of 1 to ``longest`` words that stand ``least`` times or more; ``chunks``: a written dictionary.

    Words are counted first, then pairs of them, then all longer phrases together."""
    bitmaps: list[np.ndarray] = []
    for sizes in (range(1, 2), range(2, min(3, longest + 1)), range(3, longest + 1)):
        if sizes and (not bitmaps or bitmaps[-1].any()):
            hashes = materialize(frequent_hashes(chunks, sizes, bitmaps[-1] if bitmaps else None, least, longest), "frequent")
            bitmaps.append(bitmap_of(hashes))
            drop_table(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _gathered(batches):
            held += found(_Chunks(batch, longest))
            if sum(b.num_rows for b in held) >= HELD:
                held = summed(held)
                if sum(b.num_rows for b in held) >= HELD // 2:
                    yield from held
                    held = []
        yield from summed(held)

    def summed(held: list) -> list[pa.RecordBatch]:
        if not held:
            return []
        table = pa.Table.from_batches(held).group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("f", "sum")])
        return table.rename_columns(["lang", "phrase", "words", "f"]).combine_chunks().to_batches()

    def found(c: _Chunks) -> Iterator[pa.RecordBatch]:
        check_words = word_hashes(c.raw, c.starts, 1)
        h, check, at = c.first, check_words, np.arange(len(c.own))
        for k in range(1, min(longest, len(bitmaps) if len(bitmaps) < 3 else longest) + 1):
            if k > 1:
                h, check = _longer(h, c.words, k), _longer(check, check_words, k)
            at = at[c.left[at] >= k]
            at = at[_passes(bitmaps[min(k, 3) - 1], h[at])]
            own = at[c.own[at]]
            if not len(own):
                continue
            order = own[np.argsort(h[own])]
            new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
            if (check[order][1:] != check[order][:-1])[~new[1:]].any():  # two phrases with one hash
                order = own[np.lexsort((check[own], h[own]))]
                new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])])
            new = np.flatnonzero(new)
            times, shown = np.add.reduceat(c.times[order], new), order[new]
            begins, sizes = c.starts[shown], c.ends[shown + k - 1] - c.starts[shown]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            data = c.raw[np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])]
            lang = c.lang.take(pa.array(c.row[shown])).dictionary_decode()
            yield pa.RecordBatch.from_arrays([lang, _string_array(data, offsets), pa.array(np.full(len(shown), k, np.int32)), pa.array(times)], ["lang", "phrase", "words", "f"])

    rows = chunks.mapInArrow(run, "lang string, phrase string, words int, f long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def word_totals(chunks: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``lang, n``: occurrences of words."""
    words = F.length("chunk") - F.length(F.replace("chunk", F.lit(" "), F.lit(""))) - F.when(F.col("last"), 0).otherwise(longest - 1)
    return chunks.groupBy("lang").agg(F.sum(words * F.col("times")).alias("n"))


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, k, l, r, n, score``: the weakest cut of every phrase of two words or more; tables as written before.

    Products are decimals of 38 digits, and the division drops what is after the point."""
    long = frequent.filter("words > 1")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    first = F.expr("substring_index(phrase, ' ', k)")
    cuts = cuts.withColumn("first", first).withColumn("rest", F.expr("substring(phrase, length(first) + 2)")).withColumnRenamed("f", "a")
    part = lambda side, f: frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    met = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    by_lang = long.groupBy("lang").agg(F.count("*").alias("_n")).join(totals, "lang")
    met = join_counted(met, by_lang, "lang", long.count(), F.xxhash64("phrase"), "inner")
    d = lambda c: F.col(c).cast("decimal(19,0)")
    met = met.withColumn("_over", (d("a") * 1000 * d("n")).cast("decimal(38,0)")).withColumn("_under", (d("l") * d("r")).cast("decimal(38,0)")).withColumn("score", F.expr("_over div _under"))
    return met.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "words", "a", "n", "m.*")


def outside(frequent: DataFrame, inside: int = INSIDE) -> DataFrame:
    """``lang, phrase`` of the phrases that a longer frequent one holds in ``inside`` hundredths of their occurrences, or more."""
    at = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    held = frequent.filter("words > 2").withColumn("w", F.split("phrase", " ")).select("lang", F.explode(at).alias("phrase"), F.col("f").alias("longer"))
    most = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return frequent.join(most, ["lang", "phrase"]).filter(F.col("longer") * 100 >= F.col("f") * inside).select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST_COUNT, longest: int = LONGEST, top: int = TOP, period: int = PERIOD) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    Of a phrase that stands ``a`` times, cut into parts that stand ``l`` and ``r`` times, the score is ``1000 * a * n / (l * r)``, rounded down, for
    the cut (the first of them) where it is least. Phrases that a longer one holds wherever they stand are dropped."""
    chunks = materialize(dictionary(docs, text_col, lang_col, period, longest), "chunks")
    frequent = materialize(frequent_phrases(chunks, least, longest), "phrases")
    best = scored(frequent, word_totals(chunks, longest)).join(outside(frequent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows by DuckDB.
ORACLE = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
h AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM g, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k AS words, phrase, count(*) AS a FROM h GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS k FROM f WHERE words > 1)),
s AS (SELECT c.lang, c.phrase, c.words, c.a, c.k, x.a AS l, y.a AS r, n.n, CAST((1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN n ON n.lang = c.lang),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
b AS (SELECT * FROM m WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = m.lang AND q.words > m.words AND contains(' ' || q.phrase || ' ', ' ' || m.phrase || ' ') AND 100 * q.a >= 100 * m.a)),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000"""
