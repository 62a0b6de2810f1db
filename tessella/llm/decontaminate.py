"""Benchmark decontamination with suffix arrays over shards of the training text.

A run of documents with about ``SHARD_BYTES`` of text is one shard. Its words become integers (words that occur in no benchmark item become
0), every position from which a benchmark window could still match is a suffix, the suffixes are sorted, and each
test suffix is binary-searched in that array. The ranges found give all verbatim occurrences and their places;
consecutive occurrences on one diagonal join into the longest verbatim matches (of a window at least). No shuffle is
needed: shards are independent. The benchmark goes to them in blocks of ``BLOCK_CHARS``, one broadcast at a time: a block is
read, sent out, searched in a pass over the documents, and given up before the next one is read. The usual benchmark is one block.

Defined cases: a null or wordless text has no words and is never contaminated; an item without words never matches;
an item with fewer words than the window is one window; items that share a window are all reported; an item without an id
marks words and documents like any other, but isn't listed; ids are numbers or strings; an empty benchmark leaves every document
clean; repeated rows are judged one by one; other columns, of any name, pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices

WINDOW = 10
#: Bytes of training text under one suffix array, or one text.
SHARD_BYTES = 8_000_000
#: Benchmark text that one pass over the documents carries to the tasks; more text means more passes.
BLOCK_CHARS = 16_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Words of a text after A-Z are lower-cased, as UTF-8."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class TestSuffixes:
    """The windows of one block of benchmark items as sorted fixed-width keys."""

    __test__ = False

    def __init__(self, items: list[tuple[int | str | None, str | None]], window: int):
        self.window, self.vocabulary = window, {}
        found: dict[tuple[int, ...], list[tuple[int | str | None, int]]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                found.setdefault(tuple(ids[at : at + size]), []).append((item_id, at))
        self.keys = list(found)
        self.sizes = np.array([len(k) for k in self.keys], np.int64)
        self.sources = list(found.values())
        self.shortest = int(self.sizes.min()) if self.keys else 0
        self.low = np.array([_key(k, window, 0) for k in self.keys], f"S{4 * window}")
        self.high = np.array([_key(k, window, 255) for k in self.keys], f"S{4 * window}")


def _key(ids: tuple[int, ...], window: int, fill: int) -> bytes:
    return np.array(ids, ">u4").tobytes() + bytes([fill]) * (4 * (window - len(ids)))


def search_shard(texts: list[str | None], tests: TestSuffixes) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Number of words per text, and the occurrences (text number, first word, number of the test suffix)."""
    counts, ids, starts, total = np.zeros(len(texts), np.int64), [], np.zeros(len(texts) + 1, np.int64), 0
    known = tests.vocabulary.get
    for i, text in enumerate(texts):
        found = words(text)
        counts[i] = len(found)
        ids.append(np.fromiter(map(known, found, repeat(0)), np.uint32, len(found)))
        ids.append(np.zeros(1, np.uint32))
        total += len(found) + 1
        starts[i + 1] = total
    if not tests.keys or not texts:
        return counts, []
    flat = np.concatenate(ids)
    gaps = np.flatnonzero(flat == 0)
    run = np.repeat(gaps, np.diff(gaps, prepend=-1)) - np.arange(len(flat))  # known words from here on
    suffix = np.flatnonzero(run >= max(tests.shortest, 1))
    if not len(suffix):
        return counts, []
    padded = np.concatenate([flat, np.zeros(tests.window, np.uint32)])
    table = padded[suffix[:, None] + np.arange(tests.window)]
    table[np.arange(tests.window) >= run[suffix][:, None]] = 0
    keys = np.ascontiguousarray(table.astype(">u4")).view(f"S{4 * tests.window}").ravel()
    order = np.argsort(keys, kind="stable")  # the shard's suffix array
    keys, suffix = keys[order], suffix[order]
    low, high = np.searchsorted(keys, tests.low, "left"), np.searchsorted(keys, tests.high, "right")
    hits = []
    for test in np.flatnonzero(high > low):
        places = suffix[low[test] : high[test]]
        owner = np.searchsorted(starts, places, "right") - 1
        hits += zip(owner.tolist(), (places - starts[owner]).tolist(), repeat(int(test)))
    return counts, hits


def longest_matches(hits: list[tuple[int, int]], tests: TestSuffixes) -> list[dict]:
    """Join (first word, test) occurrences of one document along diagonals into maximal verbatim matches."""
    diagonals: dict[tuple[int | str | None, int], list[tuple[int, int]]] = {}
    for at, test in hits:
        for item_id, item_at in tests.sources[test]:
            diagonals.setdefault((item_id, at - item_at), []).append((at, int(tests.sizes[test])))
    spans = []
    for (item_id, shift), found in diagonals.items():
        found.sort()
        first, last = found[0][0], found[0][0] + found[0][1]
        for at, size in found[1:]:
            if at > last:
                spans.append((item_id, first - shift, first, last - first))
                first = at
            last = max(last, at + size)
        spans.append((item_id, first - shift, first, last - first))
    return [dict(zip(("item_id", "item_word", "doc_word", "n_words"), s)) for s in sorted(spans, key=lambda s: (s[2], str(s[0]), s[1]))]


def _id_type(benchmark: DataFrame, item_col: str) -> str:
    return "bigint" if isinstance(benchmark.schema[item_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "string"


class _Blocks:
    """The benchmark dealt into blocks of about ``block_chars`` characters (more only if one text is longer)."""

    def __init__(self, benchmark: DataFrame, block_chars: int, item_col: str, text_col: str):
        text = benchmark[text_col].cast("string")
        self.items = benchmark.select(benchmark[item_col].cast(_id_type(benchmark, item_col)).alias("item"), text.alias("text")).filter("text IS NOT NULL")
        self.n = max(1, -(-(self.items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))

    def read(self, number: int):
        rows = self.items.filter(F.pmod(F.xxhash64("text"), F.lit(self.n)) == number).collect()  # one block
        return self.items.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in rows])

    def passes(self, state: DataFrame, step, name: str) -> DataFrame:
        """``step(state, block, number)`` for every block; all but the last are written, so that one block at a time is held."""
        for number in range(self.n):
            block = self.read(number)
            state = step(state, block, number)
            if number < self.n - 1:
                state = materialize(state, name)
                block.destroy()
        return state


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS,
             id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, item_ids`` (sorted as strings) and ``matches`` (longest verbatim
    matches: item, word in the item, word in the document, words)."""
    id_type, kind = docs.schema[id_col].dataType.simpleString(), _id_type(benchmark, item_col)
    # the text goes along from block to block; a single block, the usual case, returns right away
    schema = f"doc_id {id_type}, _text string, n_words bigint, hit array<int>, item_ids array<{kind}>, matches array<struct<item_id:{kind},item_word:int,doc_word:int,n_words:int>>"
    state = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("_text"))
    blocks = _Blocks(benchmark, block_chars, item_col, item_text_col)
    state = blocks.passes(state, lambda df, block, number: df.mapInArrow(_annotator(block, window, kind, number == 0, number == blocks.n - 1), schema), "annotated")
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return state.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.transform(ids, lambda i: i.cast(kind)).alias("item_ids"), "matches")


def _annotator(block, window: int, kind: str, first: bool, last: bool):
    item = pa.int64() if kind == "bigint" else pa.string()
    span = pa.struct([("item_id", item), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSuffixes(block.value, window)
        for batch in (part for whole in batches for part in slices(whole, 1, SHARD_BYTES)):
            texts = batch.column(1).to_pylist()
            counts, hits = search_shard(texts, tests)
            by_text: dict[int, list[tuple[int, int]]] = {}
            for i, at, test in hits:
                by_text.setdefault(i, []).append((at, test))
            covered: list[list[int]] = [[] for _ in texts] if first else batch.column(3).to_pylist()
            found: list[list] = [[] for _ in texts] if first else batch.column(4).to_pylist()
            spans: list[list[dict]] = [[] for _ in texts] if first else batch.column(5).to_pylist()
            for i, own in by_text.items():
                hit = set(covered[i])
                for at, test in own:
                    hit.update(range(at, at + int(tests.sizes[test])))
                covered[i] = sorted(hit)
                found[i] = sorted({*found[i], *(x for _, test in own for x, _ in tests.sources[test] if x is not None)})
                spans[i] = spans[i] + longest_matches(own, tests)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.nulls(len(texts), pa.string()) if last else batch.column(1), pa.array(counts, pa.int64()),
                pa.array(covered, pa.list_(pa.int32())), pa.array(found, pa.list_(item)), pa.array(spans, pa.list_(span))],
                ["doc_id", "_text", "n_words", "hit", "item_ids", "matches"])
    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS,
                        text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns and no shuffle."""
    where = docs.columns.index(text_col)
    blocks = _Blocks(benchmark, block_chars, item_col, item_text_col)
    return blocks.passes(docs, lambda df, block, _: df.mapInArrow(_filter(block, window, where), docs.schema), "clean")


def _filter(block, window: int, where: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSuffixes(block.value, window)
        for batch in (part for whole in batches for part in slices(whole, where, SHARD_BYTES)):
            _, hits = search_shard(batch.column(where).to_pylist(), tests)
            keep = np.ones(batch.num_rows, bool)
            keep[[i for i, _, _ in hits]] = False
            yield batch.filter(pa.array(keep))
    return run
